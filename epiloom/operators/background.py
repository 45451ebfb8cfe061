"""Random peptide backgrounds by hashes of counters: every letter follows from the sampler's name, the seed, its context, its number and its place alone.

So draws are the same whatever the order of rows and partitions, any of them can
be made again alone, and all of it is expressions: no generator has a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import AA20, InputError, length_prefixed

MOST_ROWS = 100_000
RESIDUES = "".join(sorted(AA20))
COLUMNS = ["receptor_id", "hla", "peptide_length", "peptide", "background_id"]


def background_groups(contexts: DataFrame, peptides: int = 1000, max_rows: int = MOST_ROWS) -> DataFrame:
    """Distinct contexts, once it is certain that peptides for all of them may be drawn."""
    if isinstance(peptides, bool) or not 0 <= peptides <= MOST_ROWS:
        raise InputError(f"peptides is a whole number from 0 to {MOST_ROWS}")
    if "receptor_id" not in contexts.columns:
        contexts = contexts.withColumn("receptor_id", F.lit(None).cast("string"))
    groups = contexts.select("receptor_id", "hla", F.col("peptide_length").cast("int").alias("peptide_length")).distinct()
    n, bad = groups.agg(F.count("*"), F.count_if(~F.coalesce(F.col("hla").isNotNull() & F.col("peptide_length").between(1, 50), F.lit(False)))).first()
    if bad:
        raise InputError("a context needs a molecule and a length from 1 to 50")
    if n * peptides > max_rows:
        raise InputError(f"{n} contexts x {peptides} peptides exceed {max_rows} rows")
    return groups


def drawn(groups: DataFrame, sampler: str, seed: int, peptides: int) -> DataFrame:
    """groups with `digest` of the context and a row for each `number` below peptides."""
    context = F.concat(F.lit(f"{sampler}:{seed}:"), length_prefixed("receptor_id", "hla", F.col("peptide_length").cast("string")))
    numbers = F.sequence(F.lit(0), F.lit(peptides - 1)) if peptides else F.array().cast("array<int>")
    return groups.withColumn("digest", F.sha2(context.cast("binary"), 256)).withColumn("number", F.explode(numbers))


def counter(place: Column) -> Column:
    """32 even bits of a context's draw at a place."""
    text = F.concat_ws(":", F.col("digest"), F.col("number").cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def named(df: DataFrame, peptide: Column) -> DataFrame:
    name = F.concat(F.lit("background_"), F.substring("digest", 1, 24), F.lit("_"), F.col("number").cast("string"))
    return df.select("receptor_id", "hla", "peptide_length", peptide.alias("peptide"), name.alias("background_id"))


def random_panel(contexts: DataFrame, peptides: int = 1000, seed: int = 0, max_rows: int = MOST_ROWS) -> DataFrame:
    """Even draws from the twenty residues for each context."""
    _check_seed(seed)
    rows = drawn(background_groups(contexts, peptides, max_rows), "uniform", seed, peptides)
    letter = lambda i: F.substring(F.lit(RESIDUES), (counter(i) % 20 + 1).cast("int"), F.lit(1))
    return named(rows, F.array_join(F.transform(F.sequence(F.lit(1), F.col("peptide_length")), letter), ""))


def inverse_profiles(profiles: DataFrame) -> DataFrame:
    """hla, peptide_length, upto: for each position, in order, the shares of all residues up to each; only of complete profiles that add up to 1."""
    whole = profiles.filter(F.col("amino_acid").isin(*RESIDUES) & (F.col("probability") >= 0) & F.col("position").between(1, F.col("peptide_length")))
    at = ["hla", "peptide_length", "position"]
    upto = F.sum("probability").over(W.partitionBy(*at).orderBy("amino_acid").rowsBetween(W.unboundedPreceding, W.currentRow))
    steps = whole.withColumn("upto", upto).groupBy(*at).agg(F.count("*").alias("n"), F.countDistinct("amino_acid").alias("kinds"), F.array_sort(F.collect_list(F.struct("amino_acid", "upto"))).alias("steps"), F.sum("probability").alias("total"))
    good = steps.filter("n = 20 AND kinds = 20 AND abs(total - 1) <= 1e-5")
    shares = F.transform("steps", lambda s: s["upto"] / F.element_at("steps", -1)["upto"])
    places = good.groupBy("hla", "peptide_length").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", shares.alias("shares")))).alias("places"))
    return places.filter("n = peptide_length").select("hla", "peptide_length", F.transform("places", lambda x: x["shares"]).alias("upto"))


def profile_panel(contexts: DataFrame, profiles: DataFrame, peptides: int = 1000, seed: int = 0, max_rows: int = MOST_ROWS) -> DataFrame:
    """Draws from each (hla, length)'s profile (hla, peptide_length, position, amino_acid, probability), the same for all its receptors.

    A context without a complete profile gets a row with null peptide: a failure is told, nothing falls back.
    """
    _check_seed(seed)
    groups = background_groups(contexts, peptides, max_rows)
    keys = groups.select(F.lit(None).cast("string").alias("receptor_id"), "hla", "peptide_length").distinct().join(inverse_profiles(profiles), ["hla", "peptide_length"], "left")
    # the first residue whose share up to it exceeds the draw
    place = lambda i: F.size(F.filter(F.slice(F.get("upto", i - 1), 1, 19), lambda share: share <= counter(i) / F.lit(2.0**32))) + 1
    letter = lambda i: F.substring(F.lit(RESIDUES), place(i), F.lit(1))
    peptide = F.array_join(F.transform(F.sequence(F.lit(1), F.col("peptide_length")), letter), "")
    made = named(drawn(keys.filter("upto IS NOT NULL"), "profile", seed, peptides), peptide)
    failed = keys.filter("upto IS NULL").select("receptor_id", "hla", "peptide_length", *[F.lit(None).cast("string").alias(c) for c in ("peptide", "background_id")])
    return groups.join(made.unionByName(failed).drop("receptor_id"), ["hla", "peptide_length"]).select(*COLUMNS)


def _check_seed(seed: int) -> None:
    if isinstance(seed, bool) or not 0 <= seed < 2**32:
        raise InputError("the seed is a whole number below 2^32")
