"""Delimited tables read as text, with their rows numbered; reference, panel and donor tables validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hla
from ..functions.text import AA20, InputError, clean

REFERENCE, PANEL, DONORS = ("reference_id", "peptide", "source", "evidence"), ("peptide",), ("donor_id", "hla")


def header_of(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path).limit(1).collect()
    if not lines:
        raise InputError(f"{path} is empty")
    return lines[0][0].lstrip("﻿")


def delimiter_of(header: str, rule: str, path: str = "") -> str:
    """receptors: more tabs than commas; dimension: any tab; suffix: by the file's name; comma: always a comma."""
    return {"receptors": lambda: "\t" if header.count("\t") > header.count(",") else ",", "dimension": lambda: "\t" if "\t" in header else ",", "suffix": lambda: "\t" if path.endswith(".tsv") else ",", "comma": lambda: ","}[rule]()


def read_table(spark: SparkSession, path: str, rule: str = "receptors", allow_empty: bool = False) -> DataFrame:
    """All columns as text, "" as null, and source_row counting from 2 (the header is row 1)."""
    header = header_of(spark, path)
    sep = delimiter_of(header, rule, path)
    names = [n.strip('"') for n in header.rstrip("\r\n").split(sep)]
    if any(not n.strip() or n != n.strip() for n in names):
        raise InputError(f"{path}: blank or padded column names")
    if len(set(names)) != len(names):
        raise InputError(f"{path}: a column name occurs twice")
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, nullValue="", emptyValue="", encoding="UTF-8", multiLine=False, enforceSchema=True, mode="FAILFAST", quote='"', escape='"')
    df = numbered(df.toDF(*names))
    if not allow_empty and not df.limit(1).count():
        raise InputError(f"{path} has no rows")
    return df


def numbered(df: DataFrame, first: int = 2, name: str = "source_row") -> DataFrame:
    """Rows numbered in file order: the scan's own ids, moved together by the sizes of the partitions before (one number a partition)."""
    ids = df.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.p: r.n for r in ids.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return ids.withColumn(name, F.lit(0).cast("long")).drop("_id")
    start = df.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")  # a row a partition
    return ids.withColumn("_part", part.cast("long")).join(start, "_part").withColumn(name, F.col("_before") + place + first).drop("_id", "_part", "_before")


def _validated(df: DataFrame, needed: tuple[str, ...], path: str) -> DataFrame:
    if missing := [c for c in needed if c not in df.columns]:
        raise InputError(f"{path} needs the columns {', '.join(missing)}")
    df = df.select(*[clean(c).alias(c) if c != "source_row" else F.col(c) for c in df.columns])
    for c in needed:
        if bad := df.filter(F.col(c).isNull()).select("source_row").limit(1).collect():
            raise InputError(f"{path}, row {bad[0][0]}: {c} is missing")
    if "peptide" in df.columns:
        df = df.withColumn("peptide", F.upper("peptide"))
        if bad := df.filter(~F.col("peptide").rlike(rf"\A[{AA20}]+\z")).select("source_row").limit(1).collect():
            raise InputError(f"{path}, row {bad[0][0]}: the peptide has other letters than the twenty residues")
    if "hla" in df.columns:
        df = hla.normalized(df, "hla", "_name")
        if bad := df.filter("_name_error IS NOT NULL").select("source_row", "_name_error").limit(1).collect():
            raise InputError(f"{path}, row {bad[0][0]}: {bad[0][1]}")
        df = df.withColumn("hla", F.col("_name")).drop("_name", "_name_error", "_name_abstains")
    return df.drop("source_row")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    df = _validated(read_table(spark, path, "dimension"), REFERENCE, path)
    if not {"cdr3a", "cdr3b"} & set(df.columns):
        raise InputError(f"{path} needs cdr3a or cdr3b")
    df = df.withColumns({c: F.upper(c) for c in ("cdr3a", "cdr3b", "trav", "traj", "trbv", "trbj") if c in df.columns})
    if df.groupBy("reference_id").count().filter("count > 1").limit(1).count():
        raise InputError(f"{path}: a reference_id occurs twice")
    return df


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return _validated(numbered(spark.read.parquet(path)), PANEL, path)
    return _validated(read_table(spark, path, "dimension"), PANEL, path)


def read_donors(spark: SparkSession, path: str) -> DataFrame:
    return _validated(read_table(spark, path, "dimension"), DONORS, path)
