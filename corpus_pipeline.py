"""The corpus pipeline: documents through five operators of epiloom.llm, each stage written and read by the next.

1. toxicity: documents that score at least the threshold go.
2. line dedup: lines that many documents repeat go, but for the last document's.
3. n-gram Jaccard join: of each group of near copies the row with the smallest doc_id stays.
4. benchmark decontamination: documents that hold a copy of a test item go.
5. best-fit packing: the rest, cut into pieces and dealt into sequences.

Every stage works on all rows that the one before kept.  Stages 1 to 4 return
the columns of documents; where a stage changes texts, n_chars follows them.
Stages 3 and 4 decide on rows, not on doc_ids, so that rows without doc_id and
rows that share one stay or go each for its own text.  A null doc_id is larger
than any other; of rows with the same doc_id in one group any one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiloom.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from epiloom.llm.common import table, written

#: The column that numbers a stage's rows.
ROW = "_row"


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).filter("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedupe_lines(docs)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row's own, written once so that every reading finds the same."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, ROW, "left_anti").drop(ROW)


def by_row(docs: DataFrame) -> DataFrame:
    """What the operators read, under the row's number instead of its doc_id."""
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays; those without any shingle are no copies of anything."""
    rows = numbered(docs)
    groups = ngram_join.near_duplicates(by_row(rows)).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    members = written(groups.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW))
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("stays"))
    return without(rows, members.join(first, "group").filter(F.col(ROW) != F.col("stays")).select(ROW)).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    gone = decontamination.contaminated(by_row(rows), table(spark, sf_dir, "benchmark"))
    return without(rows, gone.select(F.col("doc_id").alias(ROW)).distinct()).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = packing.packed(packing.pieces(docs))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", keep_clean),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
#: SQL can express neither boosted trees nor alignment nor packing; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
