"""From cell tables with labels to receptors and model pairs: joins that lose nothing, and provenance folded to one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import InputError, clean
from ..sources.tables import numbered
from . import ingest, pairs

MATCH = ["matched", "left only", "right only", "multiple", "no identity"]
COMPONENTS = ["trav", "traj", "cdr3a", "trbv", "trbj", "cdr3b"]


def conserved(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, match, n_left, n_right, `left`, `right`: every key of either side once, with how many rows each has.

    match: matched (one row on either side), left only, right only, multiple
    (several rows of a side), no identity (a key column is null).  left and right
    hold the rows as structs where the side has one.  Sides are summed up by key
    before they are shuffled, so a key that many rows share is a number, and no
    product of its rows is ever made; the sums of n_left and n_right are the sides' rows.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        row = F.struct(*rest) if rest else F.struct(F.lit(True).alias("here"))
        named = df.select(*keys, row.alias("row"), F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)).alias("_null"))
        sums = named.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.first("row").alias(name), F.first("_null").alias(f"null_{name}"))
        return sums.withColumn(name, F.when(F.col(f"n_{name}") == 1, F.col(name))).withColumnsRenamed({k: f"{name}_{k}" for k in keys})

    a, b = side(left, "left"), side(right, "right")
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}"))
    both = a.join(b, on, "full_outer")
    n, m = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    match = F.when(F.coalesce("null_left", F.lit(False)) | F.coalesce("null_right", F.lit(False)), MATCH[4]).when((n > 1) | (m > 1), MATCH[3]).when(m == 0, MATCH[1]).when(n == 0, MATCH[2]).otherwise(MATCH[0])
    return both.select(*[F.coalesce(f"left_{k}", f"right_{k}").alias(k) for k in keys], match.alias("match"), n.alias("n_left"), m.alias("n_right"), "left", "right")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], right_only: bool = False) -> DataFrame:
    """left's rows with right's columns; InputError where a row has no partner or a key has several (right_only: rows of the right without one are passed over)."""
    met = conserved(left, right, keys)
    fine = F.col("match").isin("matched", *(["right only"] if right_only else []))
    bad = met.filter(~fine).groupBy("match").agg(F.count("*").alias("n")).collect()
    if bad:
        raise InputError("rows don't meet one to one: " + "; ".join(f"{r.match}: {r.n} keys" for r in sorted(bad)))
    columns = lambda df, s: [F.col(f"{s}.{c}").alias(c) for c in df.columns if c not in keys]
    return met.filter("match = 'matched'").select(*keys, *columns(left, "left"), *columns(right, "right"))


def provenance(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, status: `one` value on every row, `missing` where rows have none, `conflict` where rows differ (the value is null then)."""
    of = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    rows = df.select(F.inline(F.array(*of)))
    told = rows.groupBy("column").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v").isNull()).alias("nulls"))
    status = F.when(F.col("least") != F.col("most"), "conflict").when(F.col("nulls") > 0, "missing").otherwise("one")
    return told.select("column", F.when(status == "one", F.col("least")).alias("value"), status.alias("status"))


def one_provenance(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Each column's one value (of those that the table has); InputError where it has none or several."""
    there = [c for c in columns if c in df.columns]
    told = provenance(df, there).collect() if there else []
    if bad := sorted(r["column"] for r in told if r.status != "one"):
        raise InputError(f"rows must have one {', one '.join(bad)}")
    return {c: next((r.value for r in told if r["column"] == c), None) for c in columns}


def dataset(obs: DataFrame, panel: DataFrame, label: str = "benchmark_label", max_pairs: int = 1_000_000) -> dict[str, DataFrame]:
    """Tables of a labelled cell table (cell_id, donor_id, the six components, a label): receptors, chains, cells, cell_labels, clone_labels, pairs, skipped, qc.

    Every cell keeps exactly one receptor, a placeholder where none is resolved;
    cells whose identities fall together once they are trimmed are an error.
    Labels stay out of what a model reads, and clones whose cells differ are told, not voted on.
    """
    keyed = obs.select(clean("cell_id").alias("cell_id"), clean("donor_id").alias("donor_id"), F.col("cell_id").alias("input_cell_id"), F.col(label).alias(label))
    held = ingest.ingest(numbered(obs.select("cell_id", "donor_id", *COMPONENTS)), "paired")
    cells = one_to_one(keyed, held.cells.select("cell_id", "donor_id", "receptor_id"), ["cell_id", "donor_id"])
    exported = pairs.export_pairs(held.receptors, panel, max_pairs=max_pairs)
    return {
        "receptors": held.receptors,
        "chains": held.chains,
        "cells": cells.drop(label),
        "cell_labels": keyed.drop("input_cell_id"),
        "clone_labels": pairs.clone_labels(cells, "receptor_id", label),
        "pairs": exported.filter("skip_reason IS NULL").drop("skip_reason"),
        "skipped": exported.filter("skip_reason IS NOT NULL"),
        "qc": held.qc,
    }
