"""Position-specific profiles of peptides: counted from panels, or given as probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import AA20

RESIDUES = list(AA20)


def empirical_profile(panel: DataFrame, pseudocount: float = 0.5, group: str = "hla") -> DataFrame:
    """group, length, position, amino_acid, count, frequency, log2_odds, n_peptides over distinct peptides of each group.

    The grid of positions and residues is dense: what isn't seen has its
    pseudocount.  Null groups are a group of their own.
    """
    if isinstance(pseudocount, bool) or not 0 < pseudocount < float("inf"):
        raise ValueError("the pseudocount is a positive number")
    peptides = panel.select(F.col(group), "peptide").distinct().withColumn("length", F.length("peptide"))
    groups = peptides.groupBy(group, "length").agg(F.count("*").alias("n_peptides"))
    grid = groups.select(group, "length", "n_peptides", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("position")).withColumn("amino_acid", F.explode(F.array(*map(F.lit, RESIDUES))))
    seen = peptides.select(group, "length", F.posexplode(F.split("peptide", "(?!^)")).alias("place", "residue")).groupBy(group, "length", "place", "residue").agg(F.count("*").alias("seen"))
    seen = seen.select(F.col(group).alias("_g"), F.col("length").alias("_l"), (F.col("place") + 1).alias("_p"), F.col("residue").alias("_r"), "seen")
    on = grid[group].eqNullSafe(seen["_g"]) & (grid["length"] == seen["_l"]) & (grid["position"] == seen["_p"]) & (grid["amino_acid"] == seen["_r"])
    counted = grid.join(seen, on, "left").drop("_g", "_l", "_p", "_r").withColumn("count", F.coalesce("seen", F.lit(0)).cast("long")).drop("seen")
    frequency = (F.col("count") + pseudocount) / (F.col("n_peptides") + 20 * pseudocount)
    return counted.withColumn("frequency", frequency).withColumn("log2_odds", F.log2(F.col("frequency") * 20))


def unpivoted(profile: DataFrame, *ids: str) -> DataFrame:
    """A wide profile (position and twenty residue columns) as rows of position, amino_acid, probability."""
    return profile.unpivot([F.col(c) for c in (*ids, "position")], [F.col(a) for a in RESIDUES], "amino_acid", "probability")


def pssm(long_profile: DataFrame, floor: float = 1e-12, background: float = 0.05) -> DataFrame:
    """log2 odds of probabilities against an even background, floored, with a flag where the floor was needed."""
    if not 0 < floor <= background:
        raise ValueError("the floor is above 0 and at most the background")
    p = F.greatest(F.col("probability"), F.lit(floor))
    return long_profile.withColumns({"background": F.lit(background), "log2_odds": F.log2(p / background), "floor_applied": F.col("probability") < floor})


def bad_rows(profile: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Rows of a wide profile that are no distribution."""
    values = [F.col(a) for a in RESIDUES]
    known = F.lit(True)
    for v in values:
        known = known & F.coalesce((v >= 0) & ~F.isnan(v), F.lit(False))
    total = sum(values[1:], values[0])
    return profile.filter(~(known & F.coalesce(F.abs(total - 1) <= tolerance, F.lit(False))))


def information_content(long_profile: DataFrame, *ids: str) -> DataFrame:
    """bits of each position, and its consensus residue (X where two tie)."""
    p = F.col("probability")
    term = F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    best = long_profile.groupBy(*ids, "position").agg(
        F.greatest(F.lit(0.0), F.log2(F.lit(20.0)) + F.sum(term)).alias("bits"), F.max("probability").alias("top"), F.array_sort(F.collect_list(F.struct("probability", "amino_acid"))).alias("all")
    )
    ties = F.filter("all", lambda x: F.abs(x["probability"] - F.col("top")) <= 1e-12)
    return best.select(*ids, "position", "bits", F.when(F.size(ties) == 1, ties[0]["amino_acid"]).otherwise("X").alias("consensus"))


def probability_band(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= 0.5, 4).when(p >= 0.25, 3).when(p >= 0.1, 2).when(p >= 0.05, 1).otherwise(0)


def ic50(raw: str | Column) -> Column:
    """Nanomolar affinity of a predictor's 0 to 1 output."""
    return F.pow(F.lit(50000.0), 1 - (F.col(raw) if isinstance(raw, str) else raw))
