"""What the operators share: tables, shared storage, words, hashes, blocks."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one block of documents holds at most (one document may exceed it alone).
BLOCK_CHARS = 8_000_000
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where all is one process (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="epiloom-")
        sc.setCheckpointDir(where)
    return where


def _write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: lineage is cut and a lost executor costs nothing."""
    return _write(df, f"{shared_dir(df.sparkSession)}/epiloom-{uuid.uuid4().hex}", partition_by)


class Scratch:
    """A folder in the shared one for tables that nothing reads after the block: it goes with it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark)}/epiloom-{uuid.uuid4().hex}", []

    def written(self, df: DataFrame) -> DataFrame:
        return _write(df, f"{self.path}/{uuid.uuid4().hex}")

    def dealt(self, df: DataFrame, column: str) -> DataFrame:
        """df as a table with a bucket of the column for each shuffle partition: joins by the column needn't shuffle it again."""
        name = uuid.uuid4().hex
        self.tables.append(f"spark_catalog.default.epiloom_{name}")
        buckets = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.bucketBy(buckets, column).saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def kept(self, df: DataFrame) -> DataFrame:
        """df, written beside the folder, so that it outlasts the block."""
        return written(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner take away the shuffle files of frames that nothing refers to any more; else they stay until the driver happens to collect garbage."""
    for _ in range(2):  # what the first round frees holds what the second one frees
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased, as UTF-8."""
    return encode(text).lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembering at most `most` words."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive values of h (none if there are fewer)."""
    if len(h) < n:
        return np.empty(0, U64)
    m = len(h) - n + 1
    out = mix(h[:m] + U64(n))
    for k in range(1, n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[k : k + m])
    return out


#: Odd factors of a symbol by its place in a word (from place 4096 on they come again).
PLACES = mix(np.arange(1, 4097, dtype=U64)) | U64(1)


def run_hashes(symbols: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of each run of symbols that are marked as inside a word."""
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, U64), at
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    h = np.add.reduceat((symbols[at].astype(U64) + U64(1)) * PLACES[place & 4095], first)
    return mix(h + length.astype(U64)), at[first]


#: Whether a byte belongs to a word [^\\x20\\x09-\\x0D]+.
IN_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Bytes of text whose words are hashed together: arrays of this size stay in the cache.
LOT = 100_000


def words_hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts, and where each text's begin (one more: where the last ones end)."""
    held = [encode(t) for t in texts]
    x = np.frombuffer(b"\n".join(held).lower(), np.uint8)
    h, at = run_hashes(x, IN_WORD[x])
    return h, np.concatenate([[0], np.searchsorted(at, np.cumsum([len(t) + 1 for t in held]))])


def batches_of(batch, most: int = BLOCK_CHARS, text: str = "text") -> Iterator:
    """Slices of an Arrow batch of at most `most` bytes of text, or of one row."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct 64-bit values as differences in as few bytes as the largest needs (first byte: how many)."""
    if not len(values):
        return b"\x00"
    d = np.empty(len(values), U64)
    d[0] = values[0]
    np.subtract(values[1:], values[:-1], out=d[1:])
    first, rest = int(d[0]), d[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    body = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + first.to_bytes(8, "little") + body


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"\x00" or not data:
        return np.empty(0, U64)
    width, first = data[0], int.from_bytes(data[1:9], "little")
    body = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1).T
    d = np.zeros((body.shape[0] + 1, 8), np.uint8)
    d[1:, :width] = body
    d = d.view("<u8").reshape(-1).astype(U64)
    d[0] = first
    return np.cumsum(d, dtype=U64)
