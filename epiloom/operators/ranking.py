"""Ranks, percentiles, top lists and histograms of scores; unknown scores stay unranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def rank_in_context(df: DataFrame, context: list[str], score: str = "score", out: str = "rank") -> DataFrame:
    """1 for the highest score of a context, equal scores share the smaller rank; no finite score, no rank."""
    known = finite(score)
    order = W.partitionBy(*context, known).orderBy(F.desc_nulls_last(score))
    return df.withColumn(out, F.when(known, F.rank().over(order)))


def top_distinct(df: DataFrame, context: list[str], item: str, n: int, score: str = "score") -> DataFrame:
    """The n best distinct items of each context, by best score, then item."""
    best = df.filter(finite(score)).groupBy(*context, item).agg(F.max(score).alias(score))
    place = F.row_number().over(W.partitionBy(*context).orderBy(F.desc(score), item))
    return best.withColumn("place", place).filter(F.col("place") <= n)


def rank_distinct(df: DataFrame, context: list[str], item: str, score: str = "score") -> DataFrame:
    """Ranks over distinct items, given back to every row that repeats one."""
    firsts = rank_in_context(df.groupBy(*context, item).agg(F.max(score).alias(score)), context, score)
    return df.join(firsts.select(*context, item, "rank"), [*context, item], "left")


def background_percentile(tested: DataFrame, background: DataFrame, context: list[str], score: str = "score") -> DataFrame:
    """tested with background_n and background_percentile: 100 (1 + #{b >= x}) / (n + 1), over the background of its context.

    One window over both; a context's rows are sorted on disk, not gathered.
    """
    cols = list(tested.columns)
    both = tested.withColumn("_bg", F.lit(0)).unionByName(background.select(*context, score).withColumn("_bg", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_known", finite(score)).withColumn("_b", F.when(F.col("_known"), F.col("_bg")).otherwise(0))
    above = W.partitionBy(*context, "_known").orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumns({"_above": F.sum("_b").over(above), "background_n": F.sum("_b").over(W.partitionBy(*context))})
    share = F.when(F.col("_known") & (F.col("background_n") > 0), 100.0 * (1 + F.col("_above")) / (F.col("background_n") + 1))
    return both.withColumn("background_percentile", share).filter("_bg = 0").select(*cols, "background_n", "background_percentile")


def histogram(df: DataFrame, value: str, series: str | None = None, bins: int = 24) -> DataFrame:
    """series, bin, n, share: equal bins over the range of all finite values, the last one closed; one value alone is padded by 0.5 each way."""
    known = df.filter(finite(value)).select((F.col(series) if series else F.lit("all")).alias("series"), F.col(value).cast("double").alias("v"))
    edge = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edge = edge.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = known.crossJoin(F.broadcast(edge))  # one row
    at = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy("series", at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("series")))


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates would take any)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def preview(df: DataFrame, order: list[Column], n: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(n)
