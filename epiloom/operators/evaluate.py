"""AUROC, average precision and coverage of scores against labels that may be missing or contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hla
from ..functions.text import AA20, InputError, clean
from .ranking import finite

KEYS = ["receptor_id", "peptide", "hla"]


def normalized_keys(df: DataFrame) -> DataFrame:
    """df with receptor_id and molecule trimmed, the peptide in upper case and the molecule's canonical name, so that spellings don't part a score from its label.

    A missing identity, a peptide of other letters and a name that can't be read are errors, told by one job.
    """
    if missing := [c for c in KEYS if c not in df.columns]:
        raise InputError(f"evaluation needs the columns {', '.join(missing)}")
    if odd := [c for c in KEYS if dict(df.dtypes)[c] != "string"]:
        raise InputError(f"{', '.join(odd)} must be text")
    named = hla.normalized(df.withColumns({"receptor_id": clean("receptor_id"), "peptide": F.upper(clean("peptide")), "hla": clean("hla")}), "hla", "_name")
    letters = F.coalesce(F.col("peptide").rlike(rf"\A[{AA20}]+\z"), F.lit(False))
    problem = F.coalesce(F.when(F.col("receptor_id").isNull() | F.col("peptide").isNull() | F.col("hla").isNull(), "an identity is missing"), F.when(~letters, "a peptide has other letters than the twenty residues"), F.col("_name_error"))
    if bad := named.select(problem.alias("p")).filter("p IS NOT NULL").limit(1).collect():
        raise InputError(bad[0][0])
    return named.withColumn("hla", F.col("_name")).drop("_name", "_name_error", "_name_abstains")


def fold_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, n_labels: one label a key if all agree; contradicting ones leave none."""
    folded = labels.groupBy(*keys).agg(F.countDistinct("label").alias("n_labels"), F.min("label").alias("label"))
    return folded.withColumn("label", F.when(F.col("n_labels") == 1, F.col("label")))


def threshold_metrics(df: DataFrame, context: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """context, auroc, average_precision over rows with finite score and label 0 or 1; equal scores are one threshold.

    Rows collapse to one a score before any window, so a context's window holds
    distinct scores only.
    """
    y = F.col(label).cast("long")
    steps = df.filter(finite(score) & F.col(label).isin(0, 1)).groupBy(*context, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    down = W.partitionBy(*context).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "all_p": F.sum("p").over(W.partitionBy(*context)), "all_n": F.sum("n").over(W.partitionBy(*context))})
    area = F.sum(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("n") / F.col("all_n") * (2 * F.col("tp") - F.col("p")) / (2 * F.col("all_p"))))
    precision = F.sum(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    return steps.groupBy(*context).agg(area.alias("auroc"), precision.alias("average_precision"))


def evaluate(scores: DataFrame, labels: DataFrame, keys: list[str], context: list[str], higher_is_better: bool = True) -> DataFrame:
    """Metrics and coverage of each context; keys include the context's columns and are unique in scores."""
    if scores.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("a key is scored twice")
    if labels.filter(~F.col("label").isin(0, 1)).limit(1).count():
        raise ValueError("labels are 0, 1 or missing")
    signed = scores if higher_is_better else scores.withColumn("score", -F.col("score"))
    both = fold_labels(labels, keys).join(signed.select(*keys, "score"), keys, "full_outer")
    both = both.withColumn("usable", F.col("label").isNotNull() & finite("score"))
    of = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    counts = both.groupBy(*context).agg(
        F.count("*").alias("n_keys"), of(F.col("n_labels") == 1).alias("n_known"), of(F.col("n_labels") > 1).alias("n_conflicting"), of(F.coalesce(F.col("n_labels"), F.lit(0)) == 0).alias("n_unknown"),
        of(F.col("usable")).alias("n_scored"), of(F.col("usable") & (F.col("label") == 1)).alias("n_positive"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    counts = counts.withColumns({"coverage": share("n_scored", "n_known"), "prevalence": share("n_positive", "n_scored")})
    found = counts.join(threshold_metrics(both.filter("usable"), context), context, "left")
    return found.withColumn("status", F.when(F.col("auroc").isNull(), "Unresolved").otherwise("Evaluated"))
