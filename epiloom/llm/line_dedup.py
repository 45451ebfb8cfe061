"""Operator 6: reversible line deduplication with sharded cuckoo filters over exact reference counts.

Every document's distinct line keys (at least `min_chars` code points) are its
references.  A key lives in one shard, by its hash.  Per shard there is an
exact table key -> (n documents, largest doc_id) and a cuckoo filter of the
keys in it.  Inserting documents raises counts: keys that the filter doesn't
know are new and need no look at the table.  Deleting documents lowers them;
a key whose count falls to 0 leaves both table and filter, so an insertion and
a later deletion leave the index as it was.  Keys are 128-bit hashes.

To drop lines, the keys of at least `min_docs` documents go into one cuckoo
filter a shard.  What a document loses is gathered by its doc_id and a hash of its
text, each key once, so that many rows of one doc_id, or without any, are spread
by their texts and no row gathers more keys than its own text holds (short of
texts with equal hashes, whose keys one doc_id loses or keeps alike).  Filters of at most `filter_bytes` in all are sent to every
task and spare the others' references a shuffle; beyond that size no filter is
sent and all references go to the exact join, which decides in either case.

Defined results: null or empty text is one empty line; a row is a document,
so repeated rows count as several and rows of one doc_id keep or lose a key
together; a null doc_id is smaller than any other and keeps lines only if all
holders are null; lines keep their bytes; extra columns pass through in
dedupe_lines, where n_lines and n_dropped replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, encode, mix, table, text_or_empty, written

MIN_CHARS, MIN_DOCS, FILTER_BYTES, KEYS_A_SHARD = 40, 5, 64 << 20, 200_000
BLANK = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """Buckets of four 16-bit tags; a tag sits in one of two buckets, so it can be taken out again."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 64):
        n = 16
        while n * self.SLOTS * 0.85 < capacity:
            n *= 2
        self.tags = np.zeros((n, self.SLOTS), np.uint16)
        self.seed = 1

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of the given 64-bit keys, larger if they don't fit at first."""
        room = max(64, len(keys))
        while True:
            made = cls(room)
            if all(made.insert(int(t), int(i)) for t, i in zip(*made.placed(keys), strict=True)):
                return made
            room *= 2

    def placed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        return (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1), (h & np.uint64(len(self.tags) - 1)).astype(np.int64)

    def other(self, i, tag):
        """The other bucket of a tag; works both ways."""
        return i ^ ((np.int64(tag) * 0x5BD1E995) & (len(self.tags) - 1))

    def insert(self, tag: int, i: int) -> bool:
        for at in (i, self.other(i, tag)):
            if len(free := np.flatnonzero(self.tags[at] == 0)):
                self.tags[at, free[0]] = tag
                return True
        at = int(self.other(i, tag))
        for _ in range(self.KICKS):
            self.seed = (self.seed * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self.seed >> 16) % self.SLOTS
            tag, self.tags[at, slot] = int(self.tags[at, slot]), tag
            at = int(self.other(at, tag))
            if len(free := np.flatnonzero(self.tags[at] == 0)):
                self.tags[at, free[0]] = tag
                return True
        return False

    def add(self, keys: np.ndarray, all_keys: np.ndarray) -> CuckooFilter:
        """With the keys inserted; if one doesn't fit, a larger filter of all_keys."""
        done = all(self.insert(int(t), int(i)) for t, i in zip(*self.placed(keys), strict=True))
        return self if done else CuckooFilter.of(all_keys)

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that are in."""
        for t, i in zip(*self.placed(keys), strict=True):
            for at in (int(i), int(self.other(int(i), int(t)))):
                if len(held := np.flatnonzero(self.tags[at] == t)):
                    self.tags[at, held[0]] = 0
                    break

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, i = self.placed(keys)
        j = i ^ ((tag.astype(np.int64) * 0x5BD1E995) & (len(self.tags) - 1))
        return ((self.tags[i] == tag[:, None]) | (self.tags[j] == tag[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.tags.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls()
        made.tags = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return made


def key_of(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b (a key's 128 bits), doc_id, salt (a hash of the text): each document's distinct keys."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch):
                keys, rows = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    own = {k for line in encode(text or "").split(b"\n") if long_enough(k := key_of(line), min_chars)}
                    keys += own
                    rows += [row] * len(own)
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(at), part.column(2).take(at)], ["a", "b", "doc_id", "salt"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text"), F.hash("text").alias("salt")).mapInArrow(split, "a long, b long, doc_id long, salt int")


def sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col("b"), F.lit(shards)).cast("int"))


def filters_of(keys: DataFrame) -> DataFrame:
    """shard, tags: a cuckoo filter of each shard's keys (shard, a, b)."""

    def build(pdf):
        import pandas as pd

        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "tags": [CuckooFilter.of(pdf["a"].to_numpy()).to_bytes()]})

    return keys.groupBy("shard").applyInPandas(build, "shard int, tags binary")


@dataclass
class LineIndex:
    """counts: shard, a, b, n, last; filters: shard, tags; refs: a, b, doc_id, salt.  Counts and refs are in the shared folder."""

    counts: DataFrame
    filters: DataFrame
    refs: DataFrame
    shards: int
    min_chars: int = MIN_CHARS

    @classmethod
    def of(cls, docs: DataFrame, shards: int | None = None, min_chars: int = MIN_CHARS) -> LineIndex:
        """shards: None for one to some KEYS_A_SHARD keys."""
        refs = written(references(docs, min_chars))
        counts = written(refs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
        shards = shards or max(1, -(-counts.count() // KEYS_A_SHARD))
        counts = sharded(counts, shards).select("shard", "a", "b", "n", "last")
        return cls(counts, filters_of(counts), refs, shards, min_chars)  # filters are built when a change asks for them

    def _changed(self, change: DataFrame, refs: DataFrame) -> LineIndex:
        """change: a, b, n (more or fewer), last."""
        change = sharded(change, self.shards)
        # `last` travels as text, as pandas reads whole numbers beside nulls as fractions; a filter's row has n = 0
        schema = "shard int, a long, b long, n long, last string, tags binary"

        def apply(key, held, new):
            import pandas as pd

            own = held["n"].to_numpy() == 0
            known = CuckooFilter.from_bytes(held["tags"][own].iloc[0]) if own.any() else CuckooFilter()
            old = held[~own]
            table = {(a, b): (n, x and int(x)) for a, b, n, x in zip(old["a"], old["b"], old["n"], old["last"], strict=True)}
            there = known.has(new["a"].to_numpy()) if len(new) else np.zeros(0, bool)
            fresh, gone = [], []
            for a, b, n, x, maybe in zip(new["a"], new["b"], new["n"], new["last"], there, strict=True):
                last = x and int(x)
                n0, last0 = table.get((a, b), (0, None)) if maybe else (0, None)
                now = n0 + n
                last = last if n < 0 else max((v for v in (last, last0) if v is not None), default=None)
                if now > 0:
                    table[a, b] = (now, last)
                    if n0 == 0:
                        fresh.append(a)
                elif n0 > 0:
                    del table[a, b]
                    gone.append(a)
            known.remove(np.array(gone, np.int64))
            known = known.add(np.array(fresh, np.int64), np.array([k[0] for k in table], np.int64))
            rows = [(key[0], a, b, n, None if x is None else str(x), None) for (a, b), (n, x) in table.items()]
            rows += [(key[0], 0, 0, 0, None, known.to_bytes())] if table else []
            return pd.DataFrame(rows, columns=["shard", "a", "b", "n", "last", "tags"])

        zero = F.lit(0).cast("long")
        held = self.counts.withColumns({"last": F.col("last").cast("string"), "tags": F.lit(None).cast("binary")}).unionByName(
            self.filters.select("shard", zero.alias("a"), zero.alias("b"), zero.alias("n"), F.lit(None).cast("string").alias("last"), "tags")
        )
        change = change.withColumn("last", F.col("last").cast("string"))
        both = written(held.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, schema))
        counts = both.filter("n > 0").select("shard", "a", "b", "n", F.col("last").cast("long").alias("last"))
        return LineIndex(counts, both.filter("n = 0").select("shard", "tags"), refs, self.shards, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        more = written(references(docs, self.min_chars))
        return self._changed(more.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), self.refs.unionByName(more))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose doc_id is given."""
        ids = doc_ids.select(F.col("doc_id").alias("gone")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("gone"))
        fewer, rest = self.refs.join(ids, same, "left_semi"), written(self.refs.join(ids, same, "left_anti"))
        lost = fewer.groupBy("a", "b").agg((-F.count("*")).alias("n"))
        last = rest.join(lost, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.max("doc_id").alias("last"))
        return self._changed(lost.join(last, ["a", "b"], "left"), rest)

    def dropped(self, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, salt, keys: the 16-byte keys that each document loses."""
        repeated = written(self.counts.filter(F.col("n") >= min_docs))
        filters = written(filters_of(repeated))
        size = filters.agg(F.coalesce(F.sum(F.length("tags")), F.lit(0))).first()[0]
        refs = self.refs
        if size <= filter_bytes:
            held = refs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.tags) for r in filters.collect()})
            shards = self.shards

            def maybe(batches):
                import pyarrow as pa

                known = {s: CuckooFilter.from_bytes(t) for s, t in held.value.items()}
                for batch in batches:
                    a, b = (batch.column(i).to_numpy() for i in (0, 1))
                    shard, keep = np.mod(b, shards), np.zeros(len(a), bool)
                    for s in np.unique(shard):
                        if s in known:
                            at = np.flatnonzero(shard == s)
                            keep[at] = known[s].has(a[at])
                    yield batch.filter(pa.array(keep))

            refs = refs.mapInArrow(maybe, refs.schema)
        hits = refs.join(repeated.select("a", "b", "last"), ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        return hits.groupBy("doc_id", "salt").agg(F.collect_set(F.struct("a", "b")).alias("keys"))


def dedupe_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, shards: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with the kept text, n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    lost = LineIndex.of(docs, shards, min_chars).dropped(min_docs, filter_bytes).select(F.col("doc_id").alias("_lost_id"), F.col("salt").alias("_lost_salt"), F.col("keys").alias("_lost_keys"))
    same = docs["doc_id"].cast("long").eqNullSafe(lost["_lost_id"]) & (F.hash(docs["text"]) == lost["_lost_salt"])
    joined = docs.join(lost, same, "left").drop("_lost_id", "_lost_salt")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch):
                texts, lines, gone = [], [], []
                for text, keys in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    if not keys:
                        texts.append(text)
                        lines.append((text or "").count("\n") + 1)
                        gone.append(0)
                        continue
                    out = {np.array([k["a"], k["b"]], "<i8").tobytes() for k in keys}
                    all_lines = encode(text).split(b"\n")
                    kept = [x for x in all_lines if not (long_enough(k := key_of(x), min_chars) and xxhash.xxh3_128_digest(k) in out)]
                    texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                    lines.append(len(all_lines))
                    gone.append(len(all_lines) - len(kept))
                columns = [*part.columns[:-1], pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return joined.mapInArrow(rewrite, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


SQL_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH l AS (SELECT doc_id, i, line, {SQL_KEY} AS key FROM
  (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.last AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
