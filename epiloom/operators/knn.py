"""Exact cosine neighbours.

Queries and references become tables of matrices, a row a block of vectors.
Blocks of queries are given to every salt, blocks of references to one each, and
an equi-join on the salt brings every query block together with every reference
block once: one plan, whatever the number of queries, and nothing on the driver.
A task keeps the best k of each query of the block that it is at, so that k rows
for each query and salt are shuffled; a window merges them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block of queries and of references.
QUERY_BLOCK, REFERENCE_BLOCK = 4096, 2048


def cosine(a: str, b: str) -> Column:
    """Cosine of two float arrays in double precision, within -1 and 1 (JVM-side)."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def matrices(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """keys, m: blocks of up to `rows` vectors of length 1, as they come from each partition (rows without a vector are none)."""
    kind = df.schema[key].dataType.simpleString()

    def pack(frames):
        import pandas as pd

        keys, held = [], []

        def blocks(least: int):
            while len(keys) >= least:
                m = _unit(np.array(held[:rows], float))
                yield pd.DataFrame({"keys": [keys[:rows]], "m": [m.tobytes()]})
                del keys[:rows], held[:rows]

        for pdf in frames:
            keys += pdf["k"].tolist()
            held += pdf["v"].tolist()
            yield from blocks(rows)
        yield from blocks(1)

    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("v IS NOT NULL AND k IS NOT NULL").mapInPandas(pack, f"keys array<{kind}>, m binary")


def best_of(s: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k greatest, ties by the smaller reference."""
    order = np.lexsort((r, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)


def cosine_top_k(queries: DataFrame, references: DataFrame, k: int = 10, query_id: str = "query_id", ref_id: str = "ref_id", vector: str = "vector", block: int = QUERY_BLOCK, salts: int | None = None) -> DataFrame:
    """query_id (of its own type), ref_id, similarity, rank: each query's k nearest references; ties go to the smaller ref_id.

    salts: into how many parts the references are dealt, as many as Spark's shuffle partitions if not told; queries are sent to each.
    """
    if isinstance(k, bool) or not 1 <= k <= 1000:
        raise ValueError("k is a whole number from 1 to 1000")
    spark = references.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = queries.schema[query_id].dataType.simpleString()
    q = matrices(queries, query_id, vector, block).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    r = matrices(references.withColumn(ref_id, F.col(ref_id).cast("long")), ref_id, vector, REFERENCE_BLOCK)
    r = r.select(F.col("keys").alias("ref_keys"), F.col("m").alias("ref_m"), F.pmod(F.xxhash64("keys"), F.lit(salts)).cast("int").alias("salt"))

    def nearest(batches):
        import pyarrow as pa

        now, ids, s, r = None, None, None, None

        def told():
            n = s.shape[1]
            at = pa.array(np.repeat(np.arange(len(ids)), n))
            return pa.RecordBatch.from_arrays([ids.take(at), pa.array(r.reshape(-1)), pa.array(s.reshape(-1))], names=["query_id", "ref_id", "similarity"])

        for batch in batches:
            for i in range(batch.num_rows):
                keys, m, ref_keys, ref_m = (batch.column(batch.schema.get_field_index(c))[i] for c in ("keys", "m", "ref_keys", "ref_m"))
                ref = np.asarray(ref_keys.values.to_numpy(zero_copy_only=False), np.int64)
                product = np.frombuffer(m.as_py()).reshape(len(keys.values), -1) @ np.frombuffer(ref_m.as_py()).reshape(len(ref), -1).T
                best = best_of(np.clip(product, -1, 1), np.broadcast_to(ref, product.shape), k)
                if now is not None and keys.values.equals(now):
                    s, r = best_of(np.hstack([s, best[0]]), np.hstack([r, best[1]]), k)
                    continue
                if now is not None:
                    yield told()
                now, ids, (s, r) = keys.values, keys.values, best
        if now is not None:
            yield told()

    # the join hands on one query block with all reference blocks of its salt before the next
    met = q.join(r.hint("merge"), "salt").select("keys", "m", "ref_keys", "ref_m")
    found = met.mapInArrow(nearest, f"query_id {kind}, ref_id long, similarity double")
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def unit_norm(vector: str, tolerance: float = 1e-4) -> Column:
    """Whether the vector has length 1; with two chains, each half has length 1 / sqrt(2) (see `halves_balanced`)."""
    square = F.aggregate(F.transform(F.col(vector).cast("array<double>"), lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    return F.abs(F.sqrt(square) - 1) <= tolerance


def halves_balanced(vector: str, tolerance: float = 1e-4) -> Column:
    half = (F.size(vector) / 2).cast("int")
    norm = lambda start: F.sqrt(F.aggregate(F.transform(F.slice(F.col(vector).cast("array<double>"), start, half), lambda v: v * v), F.lit(0.0), lambda a, v: a + v))
    root = F.lit(0.5**0.5)
    return (F.abs(norm(F.lit(1)) - root) <= tolerance) & (F.abs(norm(half + 1) - root) <= tolerance)


def joined_chains(alpha: str, beta: str) -> Column:
    """Two unit vectors side by side, scaled to length 1."""
    return F.transform(F.concat(F.col(alpha).cast("array<double>"), F.col(beta).cast("array<double>")), lambda v: v / F.sqrt(F.lit(2.0)))
