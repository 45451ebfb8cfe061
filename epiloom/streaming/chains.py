"""Receptor records as a stream.

Normalising chains and looking exact junctions up in a static reference are
stateless and run on a stream unchanged; cells are counted in windows with a
watermark.  Pairing and ranking need whole cells and stay batch operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import usable_cdr3
from ..operators.ingest import long_chains, with_cell_key


def stream_chains(records: DataFrame, layout: str = "10x") -> DataFrame:
    """Chains of a streaming frame; rows aren't refused but flagged, as a guard would need an action."""
    if "source_row" not in records.columns:
        records = records.withColumn("source_row", F.lit(0).cast("long"))
    return with_cell_key(long_chains(records, layout, strict=False))


def stream_exact_hits(chains: DataFrame, references: DataFrame, locus: str = "TRB", column: str = "cdr3b") -> DataFrame:
    """Chains whose usable junction a static reference holds (distance 0)."""
    known = references.filter(usable_cdr3(column)).select(F.col(column).alias("cdr3"), "reference_id", "peptide")
    return chains.filter((F.col("locus") == locus) & usable_cdr3("cdr3") & F.col("eligible")).join(known, "cdr3")


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key and window, late rows up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
