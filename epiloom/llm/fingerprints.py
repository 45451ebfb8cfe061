"""Operator 2: document fingerprints by locally consistent parsing.

A text is a row of symbols, its code points.  At each level runs of one symbol
become one symbol, deterministic coin tossing relabels each symbol by the
lowest bit in which it differs from its left neighbour until six labels are
left, and a phrase begins wherever a label is larger than both neighbours'.
Phrases are named by a hash of what they hold and are the symbols of the next
level.  Where a phrase begins depends on a few symbols around it only, so equal
substrings are cut, and named, alike wherever they stand.

The fingerprint sketches the sets of phrase names of the levels in `LEVELS`
(about 9 and 27 characters long): of each of BINS hash classes one byte of the
least name (ff: none), as hexadecimal.  The likeness of two fingerprints is the
share of equal bytes among the classes that either has, less what chance makes
equal, averaged over the levels; equal texts have likeness 1.

Defined results: null text counts as empty; two empty texts have likeness 1, an
empty and another one 0; documents stand in ascending order of doc_id (null
first), then text; a single document is its own next one; repeated rows each
have a row; extra columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batches_of, encode, mix, table

LEVELS, BINS = (2, 3), 128
#: Characters of text in a part of the order, about; parts at most (a longer part is read as a stream).
PART_CHARS, MOST_PARTS = 4_000_000, 4096
_A, _B = np.meshgrid(np.arange(128, dtype=np.int64), np.arange(128, dtype=np.int64), indexing="ij")
_LOW = np.bitwise_count(((_A ^ _B) & -(_A ^ _B)) - 1).astype(np.int64)
#: TOSS[a << 7 | b]: the new label of a symbol labelled a right of one labelled b.
TOSS = np.where(_A == _B, 0, 2 * _LOW + ((_A >> np.minimum(_LOW, 7)) & 1)).astype(np.uint8).reshape(-1)


def toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One more round of coin tossing over labels under 128; first marks those without a left neighbour."""
    at = labels.astype(np.uint16)
    pair = at << np.uint16(7)
    pair[1:] |= at[:-1]
    out = TOSS[pair]
    out[first] = labels[first] & 1
    return out


def phrases(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the rows x, of which one begins at each of `starts` (none is empty), and the new starts."""
    n = len(x)
    begin = np.zeros(n, bool)
    begin[starts] = True
    # runs
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new |= begin
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n)).astype(U64)
        x, begin = x[at], begin[at]
        long = length > 1
        x[long] = mix(x[long] + length[long] * U64(0xD6E8FEB86659FD93))
    n = len(x)
    first = np.flatnonzero(begin)
    # labels
    left = np.empty(n, U64)
    left[1:] = x[:-1]
    left[0] = 0
    left[first] = ~x[first]
    differ = x ^ left
    low = differ & (~differ + U64(1))
    label = np.bitwise_count(low - U64(1))
    label = (label << 1) | ((x & low) != 0)
    label[differ == 0] = 0
    label = label.astype(np.uint8)
    for _ in range(3):
        label = toss(label, first)
    # cuts at local maxima
    cut = begin.copy()
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~begin[2:]
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, n))
    place = np.arange(n, dtype=U64) - np.repeat(at, length).astype(U64)
    names = mix(np.add.reduceat(mix(x + place * U64(0x9E3779B97F4A7C15)), at) + length.astype(U64))
    return names, np.flatnonzero(begin[at])


def sketches(texts: list[str]) -> np.ndarray:
    """One row of len(LEVELS) * BINS bytes a text."""
    out = np.full((len(texts), len(LEVELS), BINS), 255, np.uint8)
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out.reshape(len(texts), -1)
    points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in filled]
    starts = np.cumsum([0, *map(len, points)])[:-1]
    x = mix(np.concatenate(points).astype(U64) + U64(1))
    for level in range(1, max(LEVELS) + 1):
        x, starts = phrases(x, starts)
        if level in LEVELS:
            doc = np.repeat(np.arange(len(filled)), np.diff(np.append(starts, len(x))))
            least = np.full(len(filled) * BINS, ~U64(0), U64)
            np.minimum.at(least, doc * BINS + (x >> U64(57)).astype(np.int64), x & U64((1 << 57) - 1))
            out[filled, LEVELS.index(level)] = np.where(least == ~U64(0), 255, least % U64(255)).astype(np.uint8).reshape(-1, BINS)
    return out.reshape(len(texts), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of sketches, each from 0 to 1."""
    a, b = (s.reshape(len(s), len(LEVELS), BINS) for s in (a, b))
    either = ((a != 255) | (b != 255)).sum(axis=2)
    same = ((a == b) & (a != 255)).sum(axis=2)
    share = np.where(either == 0, 1.0, (same / np.maximum(either, 1) - 1 / 255) / (1 - 1 / 255))
    return np.clip(share, 0.0, 1.0).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """part, ghost, doc_id, text: each part in order, and after it, as a ghost, the row that follows it.

    Parts are cut at doc_ids that occur; such a row goes to its own part and to
    the one before, and the first row of all goes behind the last part too.  So
    the texts are shuffled once, and no task needs another one's rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chars, nulls, least = docs.agg(F.sum(F.length("text")), F.sum(F.col("doc_id").isNull().cast("int")), F.min("doc_id")).first()
    parts = min(MOST_PARTS, max(1, -(-(chars or 0) // PART_CHARS)))
    cuts: list[int] = []
    if parts > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
        cuts = sorted({c for c in cuts if c > least or nulls})
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>")
    part = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    before = F.when(F.array_contains(bounds, F.col("doc_id")), part - 1)
    copies = F.filter(
        F.array(F.struct(part.alias("part"), F.lit(False).alias("ghost")), F.struct(before.alias("part"), F.lit(True).alias("ghost")), F.struct(F.when(is_first, F.lit(len(cuts))).alias("part"), F.lit(True).alias("ghost"))),
        lambda c: c["part"].isNotNull(),
    )
    sent = docs.select("doc_id", "text", F.explode(copies).alias("to")).select("to.part", "to.ghost", "doc_id", "text")
    return sent.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "ghost", F.asc_nulls_first("doc_id"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row of SCHEMA for each row of docs (doc_id, text)."""

    def stream(batches):
        import pyarrow as pa

        last = None  # part, ghost, doc_id, text, sketch of the row before
        for batch in batches:
            for block in batches_of(batch, 2_000_000):
                columns = [block.column(i).to_pylist() for i in range(4)]
                own = sketches(columns[3])
                rows = [*([last] if last else []), *zip(*columns, own, strict=True)]
                last = rows[-1]
                pairs = [(r, after) for r, after in zip(rows, rows[1:], strict=False) if not r[1]]
                if not pairs:
                    continue
                changed = [edited(r[3], after[3]) for r, after in pairs]
                theirs, mine, following = sketches(changed), np.array([r[4] for r, _ in pairs]), np.array([after[4] for _, after in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[2] for r, _ in pairs], pa.int64()), pa.array([len(r[3]) for r, _ in pairs], pa.int64()), pa.array([hashlib.sha256(encode(t)).hexdigest() for t in changed]),
                        pa.array([s.tobytes().hex() for s in mine]), pa.array([s.tobytes().hex() for s in theirs]), pa.array(likeness(mine, theirs)), pa.array(likeness(mine, following)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return in_order(docs).mapInArrow(stream, SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
