"""Operator 10: stupid-backoff scores from n-gram counts, computed relationally.

Counts of words and of runs of up to `order` words cover all documents.  A
document is scored under the counts of all the others (its own are taken off),
so that a text isn't its own evidence:

    S(w | v) = c(v w) / c(v)        if c(v w) > 0
             = alpha * S(w | v')    otherwise, on shorter and shorter contexts v'
    S(w)     = c(w) / N  if c(w) > 0,  alpha / N  otherwise (N: all words but the document's, at least 1)

Plan, all in tables of the shared folder:

1. blocks: neighbouring documents, some block_words words together; a row holds
   their doc_ids, lengths and words as numbers in the block's own vocabulary.
2. for each n: a block explodes into its distinct n-grams with their sums in the
   block (a map-side sum); they are dealt by hash into shards, and a shard's
   count table is joined to them.  A row carries what one block asks of one
   shard.  A block sends an n-gram once however often it has it, so that a word
   that a third of all rows hold weighs no more in its shard than any other.
   Orders follow one another, so that one's shuffle is gone before the last's.
3. the answers return to their blocks, and scores are summed per document.

Blocks times shards are rows of some 50 n-grams or more: beyond a terabyte of input
blocks grow with its square root, so that rows stay in proportion to the input.

n-grams are known by 64-bit hashes.  Words are [^\x20\x09-\x0D]+, A-Z lower-cased.

Defined results: null or empty text has 0 words, sum 0.0 and a null mean; a
row is a document, so repeated rows are each other's evidence; a null doc_id
stays null; a document longer than a block is a block of its own; extra columns
aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOT, U64, Scratch, batches_of, ngram_hashes, pack_sorted, release, table, unpack_sorted, words_hashed

ORDER, ALPHA = 3, 0.4
#: Words of a block up to BLOCK_BYTES of input, about; n-grams that a shard counts, about.
BLOCK_WORDS, BLOCK_BYTES, SHARD_NGRAMS = 1 << 20, 1e12, 500_000


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes where they are small: 255 stands for those that follow in full."""
    big = c >= 255
    return len(c).to_bytes(4, "little") + np.where(big, 255, c).astype(np.uint8).tobytes() + c[big].astype("<u8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    c = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    c[c == 255] = np.frombuffer(data, "<u8", offset=4 + n).astype(np.int64)
    return c


def shard_bounds(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(1, shards)], U64)


def block_words_for(docs: DataFrame) -> int:
    """Words of a block: in proportion to the square root of the input beyond BLOCK_BYTES."""
    held = min(float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1e15)
    return int(BLOCK_WORDS * max(1.0, held / BLOCK_BYTES) ** 0.5)


BLOCKS = "block long, doc_ids binary, known binary, lengths binary, vocabulary binary, symbols binary"


def blocks_of(docs: DataFrame, block_words: int) -> DataFrame:
    """The documents (doc_id, text) in blocks; lengths: words of each."""

    def pack(block, ids, known, lengths, hashes):
        import zstandard

        vocabulary, symbols = np.unique(np.concatenate(hashes), return_inverse=True)
        width = max(1, (len(vocabulary).bit_length() + 7) // 8)
        planes = symbols.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()  # all lowest bytes, then the next ones: they pack better
        held = bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)
        return block, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(known).astype(np.uint8).tobytes(), np.concatenate(lengths).astype("<i8").tobytes(), pack_sorted(vocabulary), held

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = [pa.int64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        row = lambda x: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], names)
        block, held, words = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
        for batch in batches:
            for part in batches_of(batch, LOT):
                h, cuts = words_hashed(part.column(1).to_pylist())
                if words and words + len(h) > block_words:
                    yield row(pack(block, *held))
                    block, held, words = block + 1, ([], [], [], []), 0
                ids = part.column(0)
                for column, value in zip(held, (pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False), np.diff(cuts), h), strict=True):
                    column.append(value)
                words += len(h)
        if held[0]:
            yield row(pack(block, *held))

    return docs.mapInArrow(read, BLOCKS)


def words_in(vocabulary: bytes, symbols: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and the document, by its place in the block, that each belongs to."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(symbols[1:]), np.uint8).reshape(symbols[0], -1)
    at = np.zeros((planes.shape[1], 8), np.uint8)
    at[:, : symbols[0]] = planes.T
    h = unpack_sorted(vocabulary)[at.view("<u8").reshape(-1).astype(np.int64)]
    lengths = np.frombuffer(lengths, "<i8")
    return h, np.repeat(np.arange(len(lengths)), lengths)


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within documents, and the places where they begin."""
    at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
    return ngram_hashes(h, n)[at], at


def asked(blocks: DataFrame, ns: list[int], shards: int) -> DataFrame:
    """n, shard, block, keys, counts: each block's distinct n-grams by the shard that counts them."""
    bounds = shard_bounds(shards)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                block, _, _, lengths, vocabulary, symbols = (batch.column(i)[row].as_py() for i in range(6))
                h, doc = words_in(vocabulary, symbols, lengths)
                for n in ns:
                    keys, counts = np.unique(grams(h, doc, n)[0], return_counts=True)
                    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    some = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    for at in range(0, len(some), 256):
                        lot = some[at : at + 256]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([n] * len(lot), pa.int32()), pa.array([x[0] for x in lot], pa.int32()), pa.array([block] * len(lot), pa.int64()), pa.array([pack_sorted(keys[a:b]) for _, a, b in lot], pa.binary()), pa.array([pack_counts(counts[a:b]) for _, a, b in lot], pa.binary())],
                            ["n", "shard", "block", "keys", "counts"],
                        )

    return blocks.mapInArrow(read, "n int, shard int, block long, keys binary, counts binary")


def answered(rows: DataFrame) -> DataFrame:
    """block, n, shard, totals: the counts over all blocks of the n-grams that each block asked for."""

    def answer(pdf):
        import pandas as pd

        keys, counts = [unpack_sorted(k) for k in pdf["keys"]], [unpack_counts(c) for c in pdf["counts"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts)).astype(np.int64)  # whole numbers below 2^53 stay exact
        cuts = np.cumsum([0, *map(len, keys)])
        return pd.DataFrame({"block": pdf["block"], "n": pdf["n"], "shard": pdf["shard"], "totals": [pack_counts(sums[place[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]})

    return rows.groupBy("n", "shard").applyInPandas(answer, "block long, n int, shard int, totals binary")


def others(g: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How often all other documents hold each n-gram; totals: by the distinct n-grams, ascending."""
    order = np.argsort(g, kind="stable")
    g, doc = g[order], doc[order]
    other = np.append(True, g[1:] != g[:-1])[: len(g)]
    runs = np.flatnonzero(other | np.append(True, doc[1:] != doc[:-1])[: len(g)])
    own = np.diff(np.append(runs, len(g)))
    out = np.empty(len(g), np.int64)
    out[order] = totals[np.cumsum(other) - 1] - np.repeat(own, own)
    return out


def block_scores(h: np.ndarray, doc: np.ndarray, lengths: np.ndarray, totals: list[np.ndarray], words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each document of a block: how many words are scored on a shorter context, and the sum of logarithms."""
    rest = np.maximum(words - lengths, 1)[doc]
    log, backed, context = np.zeros(len(h)), np.zeros(len(h), bool), None
    for n, total in enumerate(totals, 1):
        g, at = grams(h, doc, n)
        whole = np.zeros(len(h), np.int64)
        whole[at] = others(g, doc[at], total)
        if n == 1:
            log = np.log(np.where(whole > 0, whole, alpha) / rest)
        else:
            found = whole[at] > 0
            log[at + n - 1] = np.where(found, np.log(np.maximum(whole[at], 1) / np.maximum(context[at], 1)), np.log(alpha) + log[at + n - 1])
            backed[at + n - 1] = ~found
        context = whole
    return np.bincount(doc, backed, len(lengths)).astype(np.int64), np.bincount(doc, log, len(lengths))


SCORES = "doc_id string, n_words long, n_backoff long, log_score double, mean_log_score double"


def scored(blocks: DataFrame, answers: DataFrame, order: int, words: int, alpha: float) -> DataFrame:
    def score(key, held, replies):
        import pandas as pd

        out = []
        for b in held.itertuples():
            lengths = np.frombuffer(b.lengths, "<i8")
            h, doc = words_in(b.vocabulary, b.symbols, b.lengths)
            totals = []
            for n in range(1, order + 1):
                told = replies[replies["n"] == n].sort_values("shard")["totals"]
                totals.append(np.concatenate([unpack_counts(t) for t in told]) if len(told) else np.empty(0, np.int64))
            back, log = block_scores(h, doc, lengths, totals, words, alpha)
            ids = [str(i) if k else None for i, k in zip(np.frombuffer(b.doc_ids, "<i8").tolist(), b.known, strict=True)]  # pandas reads whole numbers beside nulls as fractions
            out.append(pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_words": lengths, "n_backoff": back, "log_score": log, "mean_log_score": pd.Series([x / m if m else None for x, m in zip(log.tolist(), lengths.tolist(), strict=True)], dtype=object)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    rows = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, SCORES)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_words: int | None = None, shard_ngrams: int = SHARD_NGRAMS) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored on a shorter context), log_score (sum of natural logarithms), mean_log_score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spark, out = docs.sparkSession, None
    with Scratch(spark) as scratch:
        blocks = scratch.written(blocks_of(docs, block_words or block_words_for(docs)))
        words = _words(blocks)
        shards = max(1, -(-words // shard_ngrams))
        answers = None
        for ns in [[n for n in (1, 2) if n <= order], *[[n] for n in range(3, order + 1)]]:
            told = scratch.written(answered(asked(blocks, ns, shards)))
            answers = told if answers is None else answers.unionByName(told)
            release(spark)  # the shuffle of these orders goes before the next one's comes
        out = scratch.kept(scored(blocks, answers, order, words, alpha))
    return out


def _words(blocks: DataFrame) -> int:
    """The words of all blocks."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x, "<i8").sum()) for x in batch.column(0).to_pylist()], pa.int64())], ["words"])

    return blocks.select("lengths").mapInArrow(read, "words long").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
b AS (SELECT doc_id, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), d1 AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY ALL), d2 AS (SELECT doc_id, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY ALL),
c3 AS (SELECT u, v, w, count(*) AS c FROM b WHERE u IS NOT NULL GROUP BY ALL), d3 AS (SELECT doc_id, u, v, w, count(*) AS c FROM b WHERE u IS NOT NULL GROUP BY ALL),
n AS (SELECT doc_id, len(ws) AS m, greatest((SELECT sum(len(ws)) FROM w) - len(ws), 1) AS rest FROM w),
s AS (SELECT b.doc_id, b.u, b.v, n.rest, c1.c - d1.c AS cw, cv.c - dv.c AS cv, c2.c - d2.c AS cvw, cuv.c - duv.c AS cuv, c3.c - d3.c AS cuvw
  FROM b JOIN n USING (doc_id) JOIN c1 ON c1.w = b.w JOIN d1 ON d1.doc_id = b.doc_id AND d1.w = b.w
  LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN d1 dv ON dv.doc_id = b.doc_id AND dv.w = b.v
  LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN d2 ON d2.doc_id = b.doc_id AND d2.v = b.v AND d2.w = b.w
  LEFT JOIN c2 cuv ON cuv.v = b.u AND cuv.w = b.v LEFT JOIN d2 duv ON duv.doc_id = b.doc_id AND duv.v = b.u AND duv.w = b.v
  LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w LEFT JOIN d3 ON d3.doc_id = b.doc_id AND d3.u = b.u AND d3.v = b.v AND d3.w = b.w),
q AS (SELECT *, CASE WHEN v IS NOT NULL AND cvw > 0 THEN ln(cvw / cv)
  ELSE CASE WHEN v IS NULL THEN 0 ELSE ln({ALPHA}) END + CASE WHEN cw > 0 THEN ln(cw / rest) ELSE ln({ALPHA} / rest) END END AS short FROM s),
r AS (SELECT doc_id, CASE WHEN u IS NOT NULL AND cuvw > 0 THEN ln(cuvw / cuv) WHEN u IS NOT NULL THEN ln({ALPHA}) + short ELSE short END AS l,
  CASE WHEN u IS NOT NULL THEN cuvw = 0 ELSE v IS NOT NULL AND cvw = 0 END AS back FROM q)
SELECT n.doc_id, n.m AS n_words, count(*) FILTER (WHERE back) AS n_backoff, round(coalesce(sum(l), 0), 4) AS log_score, round(sum(l) / nullif(n.m, 0), 6) AS mean_log_score
FROM n LEFT JOIN r USING (doc_id) GROUP BY n.doc_id, n.m
"""
