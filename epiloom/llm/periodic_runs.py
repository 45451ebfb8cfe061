"""Operator 12: runs of words that repeat with a period, found by bit-parallel lags.

A run is a stretch of consecutive words whose smallest period q fits at least
`times` times, that has at least `least` words, and that no neighbouring word
continues.  Word ids of a document become bit planes, one big integer for each
bit of the ids.  For a lag q each plane is XORed with itself shifted by q, and
the results are ORed: zero bits are words that equal the word q places on.
ANDing the matches with themselves shifted by 1, 2, 4, ... leaves a bit wherever
a stretch of as many matches as a run of that period needs begins.  A lag is
given up as soon as the first planes leave no such stretch.

Lags below `DENSE` are all tried.  Of longer ones those can hold no run that
match no aligned window: a run of period q in [Q, 2Q) repeats a window of Q / 2
words that begins at a multiple of Q / 2 after q words, so comparing hashes of
such windows with those Q to 2Q places on finds every lag that is worth trying,
in time linear in the words for each doubling of Q.  Equal windows have equal
hashes, so no run is lost; a lag that matches by chance is tried in vain.  Nor
is a lag tried for windows inside a run of which it is a multiple.

Each document is worked on alone, in the task that reads it; nothing is shuffled.

Defined results: a null text, an empty one or one of white space has no words
and no runs; runs may overlap; words are compared as they are (case counts);
`collapsed` joins by one space the words that no run holds after its first q
words.  Rows come back as they are, with a null or a repeated doc_id too; columns
of the names `runs` and `collapsed` are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batches_of, encode, mix, table, text_or_empty

#: Words that a run has at least, and times that its period fits at least.
LEAST, TIMES = 24, 3
#: Lags below it are tried without looking for windows first (a power of two).
DENSE = 64
#: Planes that are compared before a lag is given up.
FIRST_PLANES = 4
RUNS = "array<struct<start: long, length: long, period: long>>"


def planes_of(ids: np.ndarray) -> list[int]:
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def starts_of_ones(x: int, length: int) -> int:
    """The bits of x from which `length` ones follow."""
    have = 1
    while have < length and x:
        step = min(have, length - have)
        x &= x >> step
        have += step
    return x


def stretches(x: int) -> list[tuple[int, int]]:
    """First place and length of each stretch of ones, in ascending order."""
    ones = np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 15) // 8, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(ones, prepend=0))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def matches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` words that each equal the word `lag` places on."""
    inside, differ = (1 << (n - lag)) - 1, 0
    for k in range(0, len(planes), FIRST_PLANES):
        for plane in planes[k : k + FIRST_PLANES]:
            differ |= plane ^ (plane >> lag)
        starts = starts_of_ones(inside & ~differ, least)
        if not starts:
            return []
    return [(at, length + least - 1) for at, length in stretches(starts)]


class Found:
    """The runs so far, by period; those of one period begin in ascending order."""

    def __init__(self):
        self.by_period: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, length: int, period: int) -> None:
        starts, ends = self.by_period.setdefault(period, ([], []))
        starts.append(start)
        ends.append(start + length)

    def holds(self, start: int, end: int, lag: int) -> bool:
        """Whether a run whose period divides the lag holds these words; runs of one period share too few words for more than the last to matter."""
        for period, (starts, ends) in self.by_period.items():
            if lag % period == 0 and (k := bisect_right(starts, start)) and ends[k - 1] >= end:
                return True
        return False

    def outside(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Which pairs of a window's place and a lag no run explains whose period divides the lag."""
        left = np.ones(len(at), bool)
        for period, (starts, ends) in self.by_period.items():
            k = np.searchsorted(starts, at, side="right") - 1
            left &= ~((k >= 0) & (np.asarray(ends)[k] >= at + lag) & (lag % period == 0))
        return left


def window_lags(ids: np.ndarray, found: Found, times: int) -> Iterator[list[int]]:
    """For each doubling of Q from DENSE on the lags in [Q, 2Q) that repeat an aligned window of Q / 2 words."""
    n, w, h = len(ids), 1, mix(ids.astype(U64) + U64(1))
    while times * 2 * w <= n:
        if 2 * w >= DENSE:
            at = np.arange(0, len(h) - 2 * w, w)
            later = np.concatenate([h[2 * w :], np.zeros(2 * w, U64)])
            row, k = np.nonzero(np.lib.stride_tricks.sliding_window_view(later, 2 * w)[::w][: len(at)] == h[at][:, None])
            place, lag = at[row], k + 2 * w
            there = (place + lag < len(h)) & (lag * times <= n)
            place, lag = place[there], lag[there]
            yield np.unique(lag[found.outside(place, lag)]).tolist()
        h = mix(h[:-w] * U64(0x9E3779B97F4A7C15) + h[w:])
        w *= 2


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, found = len(words), Found()
    if n < max(least, times):
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, count=n)
    planes, out = planes_of(ids), []

    def lags() -> Iterator[int]:
        yield from range(1, min(DENSE - 1, n // times) + 1)
        for more in window_lags(ids, found, times):
            yield from more

    for lag in lags():
        for at, length in matches(planes, n, lag, max(least, times * lag) - lag):
            if not found.holds(at, at + length + lag, lag):
                found.add(at, length + lag, lag)
                out.append((at, length + lag, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with `runs` (by start and period) and `collapsed`, the text without repetitions."""
    if times < 2 or least < 2 * times:
        raise ValueError("a run holds its period at least twice, and least is at least 2 * times")

    def work(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in batches_of(batch):
                runs, left = [], []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words = encode(text or "").split()
                    runs.append(runs_of(words, least, times))
                    left.append(b" ".join(collapse(words, runs[-1])))
                keys = ("start", "length", "period")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[dict(zip(keys, r, strict=True)) for r in x] for x in runs], kind), pa.array(left, pa.binary())], names=[*part.schema.names, "runs", "collapsed"])

    docs = docs.drop("runs", "collapsed")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(work, f"{schema}, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth (by the checksum of its doc_id) repeats some of its words from a place on: the input that the query fixes."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10").alias("g"), (h % 10 == 0).alias("hit"))
    repeated = F.expr(r"""
        array_join(transform(array(array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')), w -> if(size(w) = 0, '',
            array_join(transform(sequence(0, size(w) - 1), i ->
                if(i < g % size(w), w[i], w[cast(g % size(w) + (i - g % size(w)) % (1 + floor((size(w) - g % size(w)) / (3 + g % 8))) as int)])), ' '))), '')
    """)
    return rows.select("doc_id", F.when(F.col("hit"), repeated).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]  # noqa: E731  whose exponent is greater
    # the first of those that no other exceeds: runs come by start and period
    best: Column = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda top, r: F.when(top.isNull() | (more(r, top) > 0), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(table(spark, sf_dir, "documents"))))


#: By another way: every run repeats stretches of 16 words its period later, and stretches with the same distance that follow each other are one.
SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda x, y: list_reduce([xor(x, y)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
places AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % nullif(len(w), 0) AS a FROM numbered),
texts AS MATERIALIZED (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w
  FROM places),
windows AS (SELECT row, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS k FROM texts, unnest(range(n - 15)) AS t(i) WHERE n >= 24),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.row = y.row AND x.k = y.k AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM pairs),
periodic AS (SELECT row, min(i) AS s, count(*) + 15 + q AS l, q FROM stretches GROUP BY row, q, g HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (
  SELECT * FROM periodic r
  WHERE NOT EXISTS (SELECT 1 FROM periodic o WHERE o.row = r.row AND o.q < r.q AND r.q % o.q = 0 AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
held AS (SELECT row, list({'s': s, 'l': l, 'q': q} ORDER BY s, q) AS r FROM runs GROUP BY row),
tops AS (SELECT row, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY l / q DESC, s, q) = 1)
SELECT doc_id, coalesce(len(r), 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(array_to_string(list_transform(r, lambda x: x.s || ',' || x.l || ',' || x.q || chr(10)), ''), '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN r IS NULL THEN w ELSE list_transform(
    list_filter(range(n), lambda i: len(list_filter(r, lambda x: i >= x.s + x.q AND i < x.s + x.l)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM texts LEFT JOIN held USING (row) LEFT JOIN tops USING (row)
"""
