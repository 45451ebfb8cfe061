"""Operator 3: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are runs of letters, digits and underscores, lower-cased.  Of each test
item the rare n-grams - those that at most a share RARE of all documents (or ten)
hold - are its seeds, and at least the rarest `seed_share` of them, as an item
that very many documents hold has no others.  A document that holds a seed is
aligned with the item around the seed: match +2, mismatch and gap -1 (Smith-
Waterman over words); a pair's score is the best alignment's over that of the
whole item with itself.  Pairs of at least `least` are returned, so copies with
words replaced, dropped or put in are found as well as exact ones.

A window reaches from the first to the last diagonal of its seeds and as many
words beyond as gaps can cost an alignment that still scores `least`; windows
that overlap are one.  So a pair's score is that of its best alignment in the
whole document, if this one runs through a seed.

Items are taken in blocks of at most BLOCK_WORDS words, one pass over the
documents each, so that what is sent to every task stays bounded however large
the benchmark is.  An upper bound (two for each word in common) spares most
alignments; it never drops a pair that reaches `least`.

Defined results: null or empty texts and items have no words and match nothing;
an item of fewer than n words is one seed, its whole sequence; repeated rows
have a row each; repeated item_ids are several items; null ids stay null; extra
columns aren't read (dropped documents: `clean` passes them through).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batches_of, mix, ngram_hashes, run_hashes, table, written

N, SEED_SHARE, RARE, LEAST, BLOCK_WORDS = 3, 0.6, 1e-3, 0.4, 1_000_000
MATCH, MISS, GAP = 2, -1, -1
#: Whether a character is a letter, digit or underscore, below LOW; others are asked one by one.
LOW, BLOCK_CHARS = 0x3000, 100_000
#: Characters of text looked at together: arrays of this size stay in the cache.
IN_WORD = np.array([chr(c).isalnum() or c == 95 for c in range(LOW)])
BITS = 1 << 20


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (one more: where the last ones end)."""
    texts = [t.lower() for t in texts]
    x = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = IN_WORD[np.minimum(x, LOW - 1)]
    if len(high := np.flatnonzero(x >= LOW)):
        kinds, kind = np.unique(x[high], return_inverse=True)
        inside[high] = np.array([chr(c).isalnum() for c in kinds.tolist()])[kind]
    h, at = run_hashes(x, inside)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.concatenate([[0], np.searchsorted(at, ends)])


def seeds_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram at each place; that of a shorter sequence is told apart by its length."""
    if 0 < len(h) < n:
        return mix(ngram_hashes(h, len(h)) + U64(len(h)))
    return ngram_hashes(h, n)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of item with window: score, its end in the window, and the length of the window's part."""
    m = len(window)
    above, start_above = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    best = (0, 0, 0)
    for w in item:
        fit = np.where(window == w, MATCH, MISS)
        take = np.maximum.reduce([above[:-1] + fit, above[1:] + GAP, np.zeros(m, np.int64)])
        via = np.where(take == above[:-1] + fit, start_above[:-1], np.where(take == above[1:] + GAP, start_above[1:], steps[1:]))
        via = np.where(take == 0, steps[1:], via)
        row = np.concatenate([[0], take])
        # gaps along the window: row[j] = max over i <= j of take[i] - (j - i)
        lifted = np.maximum.accumulate(row - GAP * steps)
        here = lifted + GAP * steps
        source = np.maximum.accumulate(np.where(row - GAP * steps == lifted, steps, 0))
        start = np.concatenate([[0], via])
        start = np.where(here > row, start[source], start)
        above, start_above = np.maximum(here, 0), start
        j = int(above.argmax())
        if above[j] > best[0]:
            best = (int(above[j]), j, j - int(start[j]))
    return best


class Items:
    """A block of test items and the seeds that lead to them."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], n: int, documents_with: dict[int, int] | None = None, documents: int = 0, share: float = SEED_SHARE):
        self.ids, self.words, self.n = [r[0] for r in rows], [r[1] for r in rows], n
        found = []
        for k, h in enumerate(self.words):
            s = seeds_of(h, n)
            if documents_with is not None and len(s):
                df = np.array([documents_with.get(int(x), 0) for x in s])
                s_at = np.flatnonzero(df <= max(np.sort(df)[max(0, int(np.ceil(share * len(s))) - 1)], RARE * documents, 10))
            else:
                s_at = np.arange(len(s))
            found += [(int(s[p]), k, int(p)) for p in s_at]
        found.sort()
        self.seed = np.array([f[0] for f in found], U64)
        self.item, self.place = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        self.bits = np.zeros(BITS, bool)
        self.bits[(self.seed & U64(BITS - 1)).astype(np.int64)] = True
        self.short = any(len(w) < n for w in self.words)

    def with_hits(self, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The texts, of those whose words are h[cuts[i]:cuts[i + 1]], that may hold a seed: all that do are among them."""
        if not len(self.seed):
            return np.empty(0, np.int64)
        if self.short:
            return np.flatnonzero(np.diff(cuts))
        s = ngram_hashes(h, self.n)
        at = np.flatnonzero(self.bits[(s & U64(BITS - 1)).astype(np.int64)])
        found = np.searchsorted(self.seed, s[at]).clip(max=len(self.seed) - 1)
        at = at[self.seed[found] == s[at]]
        return np.unique(np.searchsorted(cuts, at, side="right") - 1)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the document, item and place in the item of each seed found."""
        s = seeds_of(h, self.n)
        if len(h) >= self.n and any(len(w) < self.n for w in self.words):  # shorter items may stand anywhere
            s = np.concatenate([s, *(mix(ngram_hashes(h, k) + U64(k)) for k in range(1, self.n))])
            at = np.concatenate([np.arange(len(h) - k + 1) for k in (self.n, *range(1, self.n))])
        else:
            at = np.arange(len(s))
        a, b = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
        some = np.flatnonzero(b > a)
        times = (b - a)[some]
        index = np.repeat(a[some], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        return np.repeat(at[some], times), self.item[index], self.place[index]

    def matches(self, h: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """item number, score, first word and words of the best alignment, for each item that reaches `least`."""
        at, item, place = self.hits(h)
        out = []
        for k in np.unique(item):
            words = self.words[k]
            size, best, top = len(words), (0.0, 0, 0), 0
            # an alignment that scores `least` and runs through a seed leaves the seed's diagonal by no more words than it can pay for
            slack = int((MATCH * size - least * MATCH * size) / -GAP)
            begin = np.unique(at[item == k] - place[item == k])
            # windows that overlap are one, so that no alignment is cut
            for group in np.split(begin, np.flatnonzero(np.diff(begin) > size + 2 * slack) + 1):
                lo, hi = max(0, int(group[0]) - slack), min(len(h), int(group[-1]) + size + slack)
                window = h[lo:hi]
                pool, own = np.unique(words, return_counts=True)
                held = np.sort(window)
                seen = np.searchsorted(held, pool, "right") - np.searchsorted(held, pool, "left")
                if MATCH * np.minimum(own, seen).sum() < max(least * MATCH * size, top + 1):
                    continue
                score, end, length = align(words, window)
                if score > top:
                    top, best = score, (score / (MATCH * size), lo + end - length, length)
            if best[0] >= least:
                out.append((int(k), *best))
        return out


def item_blocks(benchmark: DataFrame, most: int):
    """Lists of (item_id, word hashes) of at most `most` words, or of one item."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        h, _ = hashed([r.text or ""])
        if block and size + len(h) > most:
            yield block
            block, size = [], 0
        if len(h):
            block.append((r.item_id, h))
            size += len(h)
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, seed_share: float = SEED_SHARE, least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words: documents (doc_id, text) and the items (item_id, text) they hold copies of."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"])
    blocks = item_blocks(benchmark, block_words)
    found, more = _one_block(docs, next(blocks), n, seed_share, least), next(blocks, None)
    while more is not None:
        found, more = written(found).unionByName(_one_block(docs, more, n, seed_share, least)), next(blocks, None)
    return found


def _one_block(docs: DataFrame, rows: list, n: int, seed_share: float, least: float) -> DataFrame:
    every = Items(rows, n)

    def count(batches):
        import pyarrow as pa

        seeds = np.unique(every.seed)
        for batch in batches:
            total = np.zeros(len(seeds), np.int64)
            for part in batches_of(batch, BLOCK_CHARS):
                h, cuts = hashed([t or "" for t in part.column(1).to_pylist()])
                for i in every.with_hits(h, cuts):
                    s = seeds_of(h[cuts[i] : cuts[i + 1]], n)
                    if len(s):
                        at = np.searchsorted(seeds, s).clip(max=len(seeds) - 1)
                        total[np.unique(at[seeds[at] == s])] += 1
            some = np.flatnonzero(total)
            # the row without seed tells how many documents there are
            yield pa.RecordBatch.from_arrays([pa.array([*seeds[some].view(np.int64).tolist(), None], pa.int64()), pa.array([*total[some].tolist(), batch.num_rows], pa.int64())], ["seed", "n"])

    counted = docs.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # at most one row a seed
    documents = sum(r.n for r in counted if r.seed is None)
    items = Items(rows, n, {r.seed & (2**64 - 1): r.n for r in counted if r.seed is not None}, documents, seed_share)

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch, BLOCK_CHARS):
                rows, found = [], []
                h, cuts = hashed([t or "" for t in part.column(1).to_pylist()])
                for row in items.with_hits(h, cuts).tolist():
                    got = items.matches(h[cuts[row] : cuts[row + 1]], least)
                    rows += [row] * len(got)
                    found += got
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array([items.ids[k] for k in columns[0]], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    ["doc_id", "item_id", "score", "first_word", "n_words"],
                )

    return docs.mapInArrow(find, "doc_id long, item_id long, score double, first_word long, n_words long")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
