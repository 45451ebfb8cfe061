"""Operator 8: exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct n-word shingles.  Equal sets
form a class, and classes are joined; copies need no pairs among themselves.
All shingles are put in one order, rare ones first, by a frequency sketch of
all documents.  If two sets of size n and m are to share `share` of their union,
their prefixes of n - T(n) + l and m - T(m) + l shingles share at least l, with
T(n) the least overlap that n allows.  A class's l follows from the cost of its
candidates, as the sketch estimates it; its prefix is as long as its l asks for,
and two classes become a candidate pair only where they share as many prefix
shingles as the smaller of their l.

1. one pass: each document's size and class; the sketch.
2. each class's prefix, at its own l, goes to its shingles; lists of one class end there.
3. of a list, every class names the one whose lists are the longest in all: edited
   copies have shingles of their own in their prefixes, the text that they come
   from has none.  The class named most often is its hub.  Signatures, which count a set's shingles in PARTS
   by hash, bound what two sets share; pairs that they leave room for a link, and all pairs of a hub
   that CROWD classes name, are compared whole, and links joined into
   components.  Classes without a link name another, while that finds links.
4. in each list, pairs of classes of different components are counted.  Two
   classes of one hub h, with o shingles of h each and s shingles beyond the
   prefix that aren't h's, overlap in at most min(o) + max(s) + their shared
   prefix shingles that aren't h's.  Where this needs such shingles, only they
   count; so members of a large group that miss its hub don't meet in all its
   lists, and no link is lost.
   Of other pairs a few more shared shingles than the smaller l are counted, at
   places that the least overlap leaves them.
5. pairs with enough shared prefix shingles, and signatures that fit, are compared whole: only now do sets travel.
6. components of all links; a document gets the smallest doc_id of its own.

What is bounded: the sketch has a slot for SKETCH_BYTES of input, 2^20 to 2^24
of them; a task sends a class once.  A shingle that the sketch takes for very
frequent is dealt by class as well, and a list of over LIST_ROWS classes is
split into blocks that meet two at a time.  What belongs to a class (root,
hub, counts) is joined to its list rows where they are read, and not stored
with them; parts of a hub go along only where it is crowded and some of its
classes missed it.  Shuffles end, with their files, where a table is written.
Sets are made only for classes that
the bounds on size and place allow a link: a cuckoo filter of at most
`filter_bytes` spares the others the way; beyond that size all sets are sent, and
the join decides in either case.

Shingles and classes are known by 64-bit hashes: among 10^10 different classes
some two are expected to share a hash by chance (3 in all), which would be
taken for copies.

Defined results: without words or text a document has size 0 and is its own
component; with fewer than n words its whole sequence is its one shingle; a
row is a document; a null doc_id is larger than any other, and the component
of rows without any doc_id is null; extra columns aren't read; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOT, U64, Scratch, batches_of, mix, ngram_hashes, release, table, words_hashed, written
from .components import connected_components
from .line_dedup import CuckooFilter

WORDS, SHARE, MOST_MATCHES, FILTER_BYTES = 5, (75, 100), 8, 64 << 20
#: Bytes of input for which the sketch has a slot; bounds of its size, as powers of two; slots that travel as one row.
SKETCH_BYTES, FEWEST_SLOTS, MOST_SLOTS, CHUNK = 128, 20, 24, 1 << 14
#: Estimated holders of a shingle beyond which its list is dealt by class as well; classes of a list that are compared in one task.
HOT_HOLDERS, LIST_ROWS = 1 << 16, 1 << 13
#: Parts, by hash, in which a set's shingles are counted; classes that name a hub from which on all of them are compared with it, whatever their signatures, since what they share with it bounds what they share.
PARTS, CROWD = 256, 8
#: Those of a list (and band of sizes) among which each class names one; a round of naming another follows while one in so many finds a link; shared shingles counted beyond the smaller l.
NAMED, WORTH, MORE = 8, 4, 2


def shingles(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Ascending hashes of the distinct shingles of each text."""
    h, cuts = words_hashed(texts)
    runs = ngram_hashes(h, n)
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        short = h[a:b]
        out.append(np.unique(runs[a : b - n + 1]) if b - a >= n else mix(ngram_hashes(short, b - a) + U64(b - a)) if b > a else short)
    return out


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def needed(n, share=SHARE):
    """T(n): the least overlap of a set of n shingles with any set that it is linked to."""
    p, q = share
    return -(-p * n // q)


def overlap(n, m, share=SHARE):
    """The least overlap of sets of n and m shingles that are linked."""
    p, q = share
    return -(-p * (n + m) // (p + q))


class Order:
    """Rare shingles first, by the sketch's levels; ties by hash."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    @staticmethod
    def level(load: np.ndarray, usual: float) -> np.ndarray:
        """0 for what a slot holds besides any one shingle, else a fourth of a doubling a step."""
        over = load - usual - 4 * np.sqrt(usual + 1)
        return np.where(over < 1, 0, np.minimum(1 + 4 * np.log2(np.maximum(over, 1)), 255)).astype(np.uint8)

    def sorted(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in order, and how many other documents hold each, as estimated."""
        level = self.levels[(s & U64(len(self.levels) - 1)).astype(np.int64)]
        at = np.argsort(level, kind="stable")
        level = level[at].astype(float)
        return s[at], np.where(level > 0, 2.0 ** ((level - 1) / 4), 0.0)

    def prefix(self, s: np.ndarray, share=SHARE) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The set in order, estimated holders, l and the length of the prefix for it."""
        tokens, df = self.sorted(s)
        m = self.matches(df, share)
        return tokens, df, m, len(s) - needed(len(s), share) + m

    def matches(self, df: np.ndarray, share=SHARE) -> int:
        """l: how many prefix shingles to require, by estimated cost."""
        n = len(df)
        t = needed(n, share)
        most = min(MOST_MATCHES, t)
        sums = np.cumsum(df)[[n - t + k - 1 for k in range(1, most + 1)]]
        if sums[0] <= 1:
            return 1
        k = np.arange(1, most + 1)
        # of those who share l shingles there are at most sums / l; each is compared whole, after its prefix
        return int(k[(sums / k * n + sums[0] * (n - t + k)).argmin()])


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def slots_for(docs: DataFrame) -> int:
    """The sketch's size, by the bytes that the plan's statistics name."""
    held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(max((held // SKETCH_BYTES).bit_length(), FEWEST_SLOTS), MOST_SLOTS)


def described(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """Rows of documents (doc_id, size, class) and, without class, of the sketch (chunk, counts)."""

    def read(batches):
        import pyarrow as pa

        sketch = np.zeros(slots, np.int32)
        for batch in batches:
            for part in batches_of(batch, LOT):
                held = shingles([t or "" for t in part.column(1).to_pylist()], n)
                sizes, classes = [len(s) for s in held], [class_of(s) for s in held]
                np.add.at(sketch, (np.concatenate(held) & U64(slots - 1)).astype(np.int64), 1)
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["doc_id", "size", "class", "chunk", "counts"])
        full = np.flatnonzero(sketch.reshape(-1, CHUNK).any(axis=1))
        m = len(full)
        counts = [narrow(sketch[i * CHUNK : (i + 1) * CHUNK]) for i in full]
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(full.astype(np.int32)), pa.array(counts, pa.binary())], ["doc_id", "size", "class", "chunk", "counts"])

    return docs.mapInArrow(read, "doc_id long, size long, class long, chunk int, counts binary")


def sketch_of(rows: DataFrame, slots: int) -> np.ndarray:
    """The level of each slot, a byte each: all that the driver holds and sends, however many documents there are."""

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(c, f"<u{c[0]}", offset=1).astype(np.int64) for c in pdf["counts"])
        usual = float(np.median(total))
        return pd.DataFrame({"chunk": [key[0]], "levels": [Order.level(total, usual).tobytes()]})

    out = np.zeros(slots, np.uint8)
    for r in rows.groupBy("chunk").applyInPandas(add, "chunk int, levels binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.levels, np.uint8)
    return out


def in_one(size, place, matches) -> np.ndarray:
    """A shingle's place, its set's size and l as one value: no text has 2^30 words, and l is at most MOST_MATCHES."""
    return (np.asarray(place).astype(U64) | np.asarray(size).astype(U64) << U64(30) | np.asarray(matches).astype(U64) << U64(60)).view(np.int64)


def out_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, place and l of in_one()."""
    at, low = at.view(U64), U64((1 << 30) - 1)
    return (at >> U64(30) & low).astype(np.int64), (at & low).astype(np.int64), (at >> U64(60)).astype(np.int64)


def prefixes(docs: DataFrame, n: int, share, order) -> DataFrame:
    """token, at (in_one), class, salt: the shingles of each class's prefix for its own l.  salt: -1, or a part of a very frequent shingle's holders."""

    def read(batches):
        import pyarrow as pa

        told, o = set(), Order(order.value)
        kinds = (np.int64, np.int64, np.int64, np.int32)
        for batch in batches:
            for part in batches_of(batch, LOT):
                out = ([], [], [], [])
                for s in shingles([t or "" for t in part.column(1).to_pylist()], n):
                    if not len(s) or (c := class_of(s)) in told:
                        continue
                    if len(told) < 1 << 20:  # a copy within the task needs no second list entry; a late one does no harm
                        told.add(c)
                    tokens, df, m, p = o.prefix(s, share)
                    parts = (df[:p] // HOT_HOLDERS).astype(np.int64)
                    salt = np.where(parts > 0, c % np.maximum(parts, 1), -1)
                    for column, value, kind in zip(out, (tokens[:p].view(np.int64), in_one(np.full(p, len(s)), np.arange(p), np.full(p, m)), np.full(p, c, np.int64), salt), kinds, strict=True):
                        column.append(value.astype(kind))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "at", "class", "salt"])

    return docs.select("doc_id", "text").mapInArrow(read, "token long, at long, class long, salt int")


def runs(batches, keys: list[str], columns: list[str]):
    """Whole runs of equal keys of sorted batches, many at once: (key arrays, column arrays, where each run begins and the last one ends)."""
    names = [*keys, *columns]
    rest: list[list[np.ndarray]] = []  # the last run so far, which may go on

    def cut(held):
        x = [np.concatenate(y) for y in zip(*held, strict=True)]
        new = np.flatnonzero(np.append(True, np.logical_or.reduce([y[1:] != y[:-1] for y in x[: len(keys)]])))
        return x, new

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])
        if len(rest) > 1 and all(x[0] == x[-1] == y[-1] for x, y in zip(rest[-1][: len(keys)], rest[-2][: len(keys)], strict=True)):
            continue  # nothing but the same run
        x, new = cut(rest)
        if len(new) > 1:
            yield [y[: new[-1]] for y in x[: len(keys)]], [y[: new[-1]] for y in x[len(keys) :]], new
        rest = [[y[new[-1] :] for y in x]]
    if rest:
        x, new = cut(rest)
        yield x[: len(keys)], x[len(keys) :], np.append(new, len(x[0]))


def couples(starts: np.ndarray, split, most: int = 64, lot: int = 500_000):
    """Index arrays (i, j) of the pairs within runs: all pairs of runs of up to `most` rows, those that split(a, b) yields of longer ones."""
    length = np.diff(starts)
    for k in np.unique(length[(length > 1) & (length <= most)]).tolist():
        first = starts[:-1][length == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, lot // len(i))
        for at in range(0, len(first), step):
            f = first[at : at + step, None]
            yield (f + i).ravel(), (f + j).ravel()
    for r in np.flatnonzero(length > most).tolist():
        yield from split(int(starts[r]), int(starts[r + 1]))


def sizes_fit(n1, n2, share):
    p, q = share
    return np.minimum(n1, n2) * q >= np.maximum(n1, n2) * p


def allowed(n1, p1, n2, p2, slack, share):
    """Whether sizes and places of a shared shingle leave room for a link, if at most `slack` shared ones come before it."""
    return np.minimum(n1 - p1, n2 - p2) >= overlap(n1, n2, share) - slack


def required(n1, l1, n2, l2, share):
    """How many shingles the prefixes of linked sets share at least: no fewer than the smaller l, as beyond the prefixes at most the longer rest is shared."""
    rest = np.maximum(needed(n1, share) - l1, needed(n2, share) - l2)
    return np.maximum(overlap(n1, n2, share) - rest, np.minimum(l1, l2))


def counted(n1, l1, n2, l2, share):
    """How many shared shingles are counted for a pair: some more than the smaller l, if both prefixes reach that far.  The first k that a linked pair shares leave room for all but k - 1 of its overlap."""
    over = overlap(n1, n2, share)
    return np.minimum(np.minimum(l1, l2) + MORE, np.minimum(over - needed(n1, share) + l1, over - needed(n2, share) + l2))


def named_in(c, n, reach, share, apart) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a list the class that it names, and whether there is one: of those that fit and are apart from it, the one whose lists are the longest in all.

    Asked are the first NAMED of every band of sizes that fit each other, so that small sets find theirs in lists that larger ones fill.
    """
    found, some = np.zeros(len(c), np.int64), np.zeros(len(c), bool)
    at = np.lexsort((c, -reach))
    band = np.floor(np.log(n[at]) / np.log(share[1] / share[0])).astype(np.int64)
    by_band = np.argsort(band, kind="stable")
    new = np.append(True, np.diff(band[by_band]) != 0)
    place = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    for i in at[np.sort(by_band[place < NAMED])][::-1]:
        ok = (c != c[i]) & sizes_fit(n, n[i], share) & apart(i)
        found[ok], some[ok] = c[i], True
    return found, some


LISTS = "token long, class long, size int, place int, matches int, least int, held int, hot boolean"


def shared_lists(prefix_rows: DataFrame, share) -> DataFrame:
    """The rows whose shingle is in the prefixes of several classes; least: how many prefix shingles a link with any of them needs, if sizes and places allow one here; held: how many classes; hot: whether the list may have over LIST_ROWS of them."""

    def keep(batches):
        import pyarrow as pa

        for (token, salt), (c, at), starts in runs(batches, ["token", "salt"], ["class", "at"]):
            run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            keep = np.append(True, (c[1:] != c[:-1]) | (run[1:] != run[:-1]))  # copies that other tasks sent
            keep &= (np.bincount(run, keep)[run] > 1) | (salt >= 0)
            if not keep.any():
                continue
            token, salt, c, at, run = (x[keep] for x in (token, salt, c, at, run))
            n, p, m = out_of(at)
            starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            starts = np.append(starts, len(run))
            least = np.full(len(c), 1 << 30)

            def meet(i, j):
                ok = sizes_fit(n[i], n[j], share) & allowed(n[i], p[i], n[j], p[j], 0, share)  # noqa: B023
                i, j = i[ok], j[ok]
                k = required(n[i], m[i], n[j], m[j], share)  # noqa: B023
                np.minimum.at(least, i, k)  # noqa: B023
                np.minimum.at(least, j, k)  # noqa: B023

            def split(a, b):
                if b - a > 2048 or salt[a] >= 0:  # what any one of a fitting size would ask for
                    x = slice(a, b)
                    least[x] = np.where(n[x] - p[x] >= overlap(n[x], needed(n[x], share), share), 1, least[x])  # noqa: B023
                    return
                for i in range(a, b - 1):
                    yield np.full(b - i - 1, i), np.arange(i + 1, b)

            for i, j in couples(starts, split):
                meet(i, j)
            least[salt >= 0] = np.minimum(least[salt >= 0], 1)
            held = np.repeat(np.diff(starts), np.diff(starts))
            for k in range(0, len(c), 50_000):
                x = slice(k, k + 50_000)
                small = lambda y: pa.array(y[x].astype(np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[x]), pa.array(c[x]), small(n), small(p), small(m), pa.array(least[x].astype(np.int32), mask=least[x] == 1 << 30), small(held), pa.array((held[x] > LIST_ROWS) | (salt[x] >= 0))],
                    ["token", "class", "size", "place", "matches", "least", "held", "hot"],
                )

    return prefix_rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "class").mapInArrow(keep, LISTS)


def linkable(lists: DataFrame) -> DataFrame:
    """The rows of classes that share as many prefix shingles as a link needs, with reach: how long a class's lists are in all."""
    own = Window.partitionBy("class")
    rows = lists.withColumns({"rows": F.count("*").over(own), "fewest": F.min("least").over(own), "reach": F.sum("held").over(own)})
    return rows.filter("rows >= fewest").select("token", "class", "size", "place", "matches", "reach", "hot")


def hubs(votes: DataFrame) -> DataFrame:
    """class, hub: the class that each one names most often (of several the least); once is enough only for small sets."""
    counted = votes.groupBy("class", F.col("named").alias("hub")).agg(F.count("*").alias("times"), F.first("size").alias("size")).filter("times >= 2 OR size < 16")
    return counted.groupBy("class").agg(F.min(F.struct(-F.col("times"), "hub"))["hub"].alias("hub"))


def naming(lists: DataFrame, share) -> DataFrame:
    """class, named, size: what the classes without a link (column root equal to class) name, besides their hub, in lists."""

    def emit(batches):
        import pyarrow as pa

        for _, (c, n, reach, root, hub), starts in runs(batches, ["token", "block"], ["class", "size", "reach", "root", "hub"]):
            n, alone, length = n.astype(np.int64), root == c, np.diff(starts)
            begin = starts[:-1]
            some = np.logical_or.reduceat(alone, begin) & (np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin))
            two = begin[some & (length == 2)]
            two = two[sizes_fit(n[two], n[two + 1], share) & (hub[two] != c[two + 1]) & (hub[two + 1] != c[two])]
            at, name = np.concatenate([two, two + 1]), np.concatenate([c[two + 1], c[two]])
            held = [(c[at][alone[at]], name[alone[at]], n[at][alone[at]])]
            for r in np.flatnonzero(some & (length > 2)).tolist():
                x = slice(starts[r], starts[r + 1])
                k, z, h = c[x], root[x], hub[x]
                name, ok = named_in(k, n[x], reach[x], share, lambda i: (z != z[i]) & (h != k[i]) & (h[i] != k))  # noqa: B023
                ok &= alone[x]
                held.append((k[ok], name[ok], n[x][ok]))
            k, name, size = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(name), pa.array(size.astype(np.int32))], ["class", "named", "size"])

    return lists.filter("other = block").mapInArrow(emit, "class long, named long, size int")


def hub_here(starts: np.ndarray, c: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """Whether each row's hub is another class of its run."""
    out, at = np.zeros(len(c), bool), np.flatnonzero(hub != c)
    if len(at):
        names = np.unique(np.concatenate([c, hub[at]]))
        run = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * len(names)
        out[at] = np.isin(run[at] + np.searchsorted(names, hub[at]), run + np.searchsorted(names, c))
    return out


def across(lists: DataFrame, share) -> DataFrame:
    """a, b: pairs of classes of different components that share as many prefix shingles as a link needs."""

    def emit(batches):
        import pyarrow as pa

        held, rows = [], 0

        def batch():
            a, b, least, first = (np.concatenate(x) for x in zip(*held, strict=True))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            at = np.lexsort((hi, lo))
            lo, hi, least, first = lo[at], hi[at], least[at], first[at]
            cut = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(lo[cut]), pa.array(hi[cut]), pa.array(np.diff(np.append(cut, len(lo)))), pa.array(least[cut]), pa.array(np.logical_or.reduceat(first, cut))], ["a", "b", "times", "least", "first"])

        for (_, block, other), (c, n, p, m, root, hub, o, s, of_hub, mine, parts), starts in runs(batches, ["token", "block", "other"], ["class", "size", "place", "matches", "root", "hub", "over", "beyond", "of_hub", "mine", "parts"]):
            n, p, m, o, s = (x.astype(np.int64) for x in (n, p, m, o, s))
            known = np.array([x is not None for x in parts])
            held_of = np.frombuffer(b"".join(x or bytes(PARTS) for x in parts), np.uint8).reshape(-1, PARTS)
            of_hub = of_hub | hub_here(starts, c, hub)

            def split(a, b):
                kinds, kind, count = np.unique(root[a:b], return_inverse=True, return_counts=True)  # noqa: B023
                largest, at = kind == count.argmax(), np.arange(b - a)
                for i in np.flatnonzero(~largest).tolist():
                    j = np.flatnonzero(largest | (at > i))
                    yield np.full(len(j), a + i), a + j

            for i, j in couples(starts, split):
                ok = (root[i] != root[j]) & sizes_fit(n[i], n[j], share) & ((block[i] == other[i]) | (mine[i] != mine[j]))
                i, j = i[ok], j[ok]
                of_both = np.minimum(o[i], o[j])
                told = np.flatnonzero((hub[i] == hub[j]) & known[i] & known[j])
                for at in range(0, len(told), 50_000):
                    k = told[at : at + 50_000]
                    of_both[k] = np.minimum(held_of[i[k]], held_of[j[k]]).sum(axis=1, dtype=np.int64)
                short = overlap(n[i], n[j], share) - of_both - np.maximum(s[i], s[j])
                apart = (hub[j] == hub[i]) & (o[i] >= 0) & (o[j] >= 0) & (short > 0)  # only shingles that aren't their hub's can link them
                least = np.where(apart, short, counted(n[i], m[i], n[j], m[j], share))
                first = apart | allowed(n[i], p[i], n[j], p[j], 0, share)
                ok = np.where(apart, ~(of_hub[i] | of_hub[j]), allowed(n[i], p[i], n[j], p[j], least - 1, share))
                if ok.any():
                    held.append((c[i[ok]], c[j[ok]], least[ok], first[ok]))
                    rows += int(ok.sum())
                if rows >= 500_000:
                    yield batch()
                    held, rows = [], 0
        if held:
            yield batch()

    pairs = lists.mapInArrow(emit, "a long, b long, times long, least long, first boolean")
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("least").alias("least"), F.max("first").alias("first")).filter("times >= least AND first").select("a", "b")


def long_lists(lists: DataFrame) -> DataFrame:
    """token, blocks: into how many blocks the lists of over LIST_ROWS rows are split."""
    return lists.filter("hot").groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > LIST_ROWS).select("token", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("blocks"))


def in_blocks(lists: DataFrame, long: DataFrame, pairs: bool) -> DataFrame:
    """lists with block and other, by token: 0 and 0, but for long lists, whose rows are dealt into blocks; with pairs, every two blocks meet once."""
    dealt = lists.join(long, "token", "left").withColumn("mine", F.coalesce(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), F.lit(0)))
    if pairs:
        dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        dealt = dealt.withColumn("block", F.least("mine", "met")).withColumn("other", F.greatest("mine", "met")).drop("met")
    else:
        dealt = dealt.withColumn("block", F.col("mine")).withColumn("other", F.col("mine"))
    return dealt.drop("blocks").repartition("token", "block", "other").sortWithinPartitions("token", "block", "other", "class")


def filter_of(classes: DataFrame, filter_bytes: int):
    """A filter of the classes for every task, if it takes at most filter_bytes."""
    many = classes.count()
    if 3 * many > filter_bytes:  # a filter takes at most some 2.4 to 4.8 bytes a class
        return None
    shards = classes.groupBy(F.pmod(F.col("class"), F.lit(64)).alias("shard")).applyInPandas(_filter, "shard long, tags binary")
    return classes.sparkSession.sparkContext.broadcast({r.shard: bytes(r.tags) for r in shards.collect()})


def _filter(key, pdf):
    import pandas as pd

    return pd.DataFrame({"shard": [key[0]], "tags": [CuckooFilter.of(pdf["class"].to_numpy()).to_bytes()]})


def known_in(keep):
    """Which of an array of classes the filter holds, as a function; all without a filter."""
    if keep is None:
        return lambda c: np.ones(len(c), bool)
    held = {k: CuckooFilter.from_bytes(t) for k, t in keep.value.items()}

    def known(c: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(c), bool), c % 64
        for k in np.unique(shard).tolist():
            if k in held:
                out[shard == k] = held[k].has(c[shard == k])
        return out

    return known


def signature(s: np.ndarray) -> bytes | None:
    """How many shingles of the set are in each of PARTS, a byte each; null beyond a byte."""
    of = np.bincount((s >> U64(56)).astype(np.int64), minlength=PARTS)
    return None if of.max() > 255 else of.astype(np.uint8).tobytes()


def sets_of(docs: DataFrame, classes: DataFrame, n: int, share, order, filter_bytes: int) -> DataFrame:
    """class, prefix, tokens, signature: the sets, in order, of the given classes, and the lengths of their prefixes."""
    keep = filter_of(classes, filter_bytes)

    def read(batches):
        import pyarrow as pa

        o, told, known = Order(order.value), set(), known_in(keep)
        for batch in batches:
            for part in batches_of(batch, LOT):
                rows = []
                held = [s for s in shingles([t or "" for t in part.column(1).to_pylist()], n) if len(s)]
                of = [class_of(s) for s in held]
                for s, c, wanted in zip(held, of, known(np.array(of, np.int64)).tolist(), strict=True):
                    if wanted and c not in told:
                        if len(told) < 1 << 20:
                            told.add(c)
                        tokens, _, _, p = o.prefix(s, share)
                        rows.append((c, p, tokens.tobytes(), signature(s)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["class", "prefix", "tokens", "signature"])

    sets = docs.select("doc_id", "text").mapInArrow(read, "class long, prefix int, tokens binary, signature binary")
    return sets.join(classes, "class", "left_semi").dropDuplicates(["class"])


def fitting(pairs: DataFrame, sets: DataFrame, share, crowded: bool = False) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for a link; with crowded, also all of a b that CROWD pairs have."""
    stay = F.lit(False)
    if crowded:
        crowd = pairs.groupBy("b").agg(F.count("*").alias("named")).filter(F.col("named") >= CROWD).select("b", F.lit(True).alias("crowd"))
        pairs, stay = pairs.join(crowd, "b", "left"), F.coalesce("crowd", F.lit(False))
    of = lambda side, name: sets.select(F.col("class").alias(side), F.col("signature").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y", stay.alias("stay"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            unknown = np.array([i is None or j is None for i, j in zip(x, y, strict=True)], bool)
            x, y = (np.frombuffer(b"".join(i or bytes(PARTS) for i in z), np.uint8).reshape(-1, PARTS) for z in (x, y))
            n, m, most = (z.sum(axis=1, dtype=np.int64) for z in (x, y, np.minimum(x, y)))
            ok = batch.column(4).to_numpy(zero_copy_only=False).astype(bool) | unknown | (most >= overlap(n, m, share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(read, "a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, share) -> DataFrame:
    """a, b, linked, over (how many shingles they share), beyond (how many of a's come after its prefix and aren't b's) and parts (how many of the shared ones are in each of PARTS, a byte each; null beyond a byte) of pairs (a, b)."""
    p, q = share
    first = pairs.join(sets.select(F.col("class").alias("a"), "prefix", F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "prefix", "x", "y")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            linked, over, beyond, parts = [], [], [], []
            for head, a, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.sort(np.frombuffer(b, "<u8"))
                common = y[np.searchsorted(y, x).clip(max=len(y) - 1)] == x
                o = int(common.sum())
                linked.append(q * o >= p * (len(x) + len(y) - o))
                over.append(o)
                beyond.append(len(x) - head - int(common[head:].sum()))
                parts.append(signature(x[common]))
            columns = [pa.array(linked, pa.bool_()), pa.array(over, pa.int32()), pa.array(beyond, pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "linked", "over", "beyond", "parts"])

    return both.mapInArrow(read, "a long, b long, linked boolean, over int, beyond int, parts binary")


def rooted(lists: DataFrame, told: DataFrame, roots: DataFrame) -> DataFrame:
    """lists with what is told of each class (its hub and more) and its root; its own, where there is none."""
    of_class = told.join(roots.withColumnRenamed("node", "class"), "class", "full")
    return lists.join(of_class, "class", "left").withColumns({"root": F.coalesce("root", "class"), "hub": F.coalesce("hub", "class")})


def by_hub(found: DataFrame) -> DataFrame:
    """class, hub, over, beyond and parts of what was compared; parts only where a crowded hub was missed, since elsewhere few pairs of its classes are looked at, or none."""
    of_hub = found.groupBy("b").agg(F.count("*").alias("named"), F.min("linked").alias("all"))
    missed = of_hub.filter((F.col("named") >= CROWD) & ~F.col("all")).select("b", F.lit(True).alias("missed"))
    return found.join(missed, "b", "left").select(F.col("a").alias("class"), F.col("b").alias("hub"), "over", "beyond", F.when(F.col("missed"), F.col("parts")).alias("parts"))


def with_hubs(lists: DataFrame, found: DataFrame, roots: DataFrame, long: DataFrame) -> DataFrame:
    """lists with root, hub, over and beyond (-1 where there is none), parts, and whether the hub's prefix holds the shingle, as far as blocks of a list can't tell."""
    rows = rooted(lists, by_hub(found), roots).withColumns({"over": F.coalesce("over", F.lit(-1)), "beyond": F.coalesce("beyond", F.lit(-1))})
    if long.isEmpty():
        return rows.withColumn("of_hub", F.lit(False))
    theirs = lists.join(long.select("token"), "token", "left_semi").select("token", F.col("class").alias("hub"), F.lit(True).alias("of_hub"))
    return rows.join(theirs, ["token", "hub"], "left").withColumn("of_hub", F.coalesce("of_hub", F.lit(False)) & (F.col("hub") != F.col("class")))


def jaccard_links(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, size, class) and class -> root (the least class of its component; only classes with links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    slots = slots_for(docs)
    rows = written(described(docs, n, slots))
    members = rows.filter("class IS NOT NULL").select("doc_id", "size", "class")
    order = docs.sparkSession.sparkContext.broadcast(sketch_of(rows.filter("class IS NULL").select("chunk", "counts"), slots))
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        lists = scratch.dealt(linkable(shared_lists(prefixes(docs, n, share, order), share)), "class")  # all others share too few prefix shingles for a link
        release(spark)
        classes = scratch.written(lists.select("class").distinct())
        sets = scratch.dealt(sets_of(docs, classes, n, share, order, filter_bytes), "class")
        release(spark)
        long = scratch.written(long_lists(lists))
        lists = lists.drop("hot")
        alone = lists.withColumns({"root": F.col("class"), "hub": F.col("class")})
        named = scratch.written(hubs(naming(in_blocks(alone, long, pairs=False), share)).select(F.col("class").alias("a"), F.col("hub").alias("b")))
        found = scratch.written(compared(scratch.written(fitting(named, sets, share, crowded=True)), sets, share))
        release(spark)
        links, tested = found.filter("linked").select("a", "b"), named.count()
        roots = merged(spark.createDataFrame([], "node long, root long"), links)
        first = named.select(F.col("a").alias("class"), F.col("b").alias("hub"))
        while WORTH * links.count() > tested:  # to save work: pairs within a component need no look below
            more = scratch.written(hubs(naming(in_blocks(rooted(lists, first, roots), long, pairs=False), share)).select(F.col("class").alias("a"), F.col("hub").alias("b")))
            again = scratch.written(compared(scratch.written(fitting(more, sets, share)), sets, share))
            release(spark)
            links, tested = again.filter("linked").select("a", "b"), more.count()
            roots = merged(roots, links)
        left = scratch.written(across(in_blocks(with_hubs(lists.drop("reach"), found, roots, long), long, pairs=True), share))
        release(spark)
        left = scratch.written(fitting(left, sets, share))
        return members, merged(roots, compared(left, sets, share).filter("linked").select("a", "b")).withColumnRenamed("node", "class")


def merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links (a, b) between classes."""
    root = lambda side: first.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    joined = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    second = connected_components(joined)
    up = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    of_first = first.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(of_first.union(second.join(first, "node", "left_anti")))


def near_duplicates(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    members, roots = jaccard_links(docs, n, share, filter_bytes)
    full = members.filter("size > 0")
    held = written(full.groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(roots, "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root")))
    least = written(held.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    component = held.join(least, "root").select("class", "component_id")
    found = full.join(component, "class").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return found.union(members.filter("size = 0").select("doc_id", F.col("size"), F.col("doc_id")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {SHARE[1]} * count(*) >= {SHARE[0]} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS c FROM s UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.c)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""
