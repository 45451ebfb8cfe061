"""Where evidence and scores go: one pass writes them and counts, bounded tables tell what reports need.

Counters are sums beside the write, so they merge over tasks and cost no second
reading.  Evidence is ranked within its receptor with candidates first, so a
receptor has a candidate exactly when its row of rank 1 is one: distinct
receptors are counted without a distinct.  Previews and lists of contexts are
bounded by what they are asked for: each task hands on so many rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import hla
from .ranking import finite

PREVIEW_ROWS, CONTEXTS = 200, 20
#: Residues that each family of affinity predictors takes.
BOUNDS = {"class_i": (8, 15), "class_ii": (13, 25)}
ROUTES = ["unrouted", "unsupported_length", "no_model", "failed_score", "predicted"]


def evidence_counters() -> dict[str, Column]:
    first, candidate = F.col("evidence_rank") == 1, F.col("status") == "Candidate"
    return {
        "evidence_rows": F.count("*"),
        "candidate_rows": F.count_if(candidate),
        "unresolved_rows": F.count_if(~candidate),
        "receptors": F.count_if(first),
        "receptors_with_candidates": F.count_if(first & candidate),
        "receptors_without_evidence": F.count_if(first & (F.col("evidence_type") == "none")),
    }


def summary(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """counter, n: one scan, a row a counter."""
    sums = df.agg(*[c.alias(name) for name, c in counters.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in counters])))


def write_evidence(evidence: DataFrame, path: str, order: list[Column] | None = None, preview: int = PREVIEW_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """Writes evidence to path, and returns a preview of its first rows and the counters of the same pass."""
    seen = Observation()
    evidence.observe(seen, *[c.alias(name) for name, c in evidence_counters().items()]).write.option("compression", "zstd").parquet(path)
    back = evidence.sparkSession.read.schema(evidence.schema).parquet(path)
    return back.orderBy(*(order or [F.col("receptor_id"), F.col("evidence_rank")])).limit(preview), dict(seen.get)


def first_contexts(df: DataFrame, context: list[str], n: int = CONTEXTS) -> DataFrame:
    """The first n contexts, in order, with their rows and how many of these have a score."""
    return df.groupBy(*context).agg(F.count("*").alias("rows"), F.count_if(finite("score")).alias("scored")).orderBy(*context).limit(n)


def routes(rows: DataFrame, models: DataFrame, bounds: dict[str, tuple[int, int]] = BOUNDS) -> DataFrame:
    """rows (hla, peptide, score) with `predictor` and `route`: the first of ROUTES that holds.

    A molecule goes to the family that takes it; a peptide must be within the
    family's bounds, and the model (models: predictor, hla) must know the very
    molecule: none is put in another's place.
    """
    named = hla.routed(rows, "hla", "predictor")
    known = models.select("predictor", "hla").distinct().withColumn("_model", F.lit(True))
    both = named.join(known, ["predictor", "hla"], "left")
    fits = F.lit(False)
    for name, (least, most) in bounds.items():
        fits = fits | ((F.col("predictor") == name) & F.length("peptide").between(least, most))
    route = F.when(F.col("predictor").isNull(), ROUTES[0]).when(~F.coalesce(fits, F.lit(False)), ROUTES[1]).when(F.col("_model").isNull(), ROUTES[2]).when(~finite("score"), ROUTES[3]).otherwise(ROUTES[4])
    return both.withColumn("route", route).select(*rows.columns, "predictor", "route")


def routing_counters(routed: DataFrame) -> DataFrame:
    """predictor (null: none takes the molecule), routed, and the rows of each route."""
    return routed.groupBy("predictor").agg(F.count_if(F.col("predictor").isNotNull()).alias("routed"), *[F.count_if(F.col("route") == r).alias(r) for r in ROUTES])
