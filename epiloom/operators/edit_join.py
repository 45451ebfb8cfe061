"""Edit-distance joins of two sets of sequences.

k = 0 is an equi-join.  For k > 0 each sequence of the left is cut in two halves.
k edits can't spoil both: with e + f = k - 1 either the first half is within e
edits of a beginning of the other sequence, or the second within f of an end.
For k up to 3 both are at most 1, and strings are within one edit only if they
share a string that each becomes by losing at most one letter.  So halves go into
an index with their one-letter deletions, the right side offers the beginnings
and ends that a left sequence of each fitting length could have as halves, and an
equi-join on deletions finds the candidates, which are verified before anything
is shuffled.  Halves hold half of what tells sequences apart even where all begin
and end alike; a sequence gives a number of rows that its length and k bound.
Every distinct sequence is looked at once, whoever has it.

Half of a short sequence tells little: candidates grow with the square of the
tables, and far beyond the pairs.  So for k in WHOLE, where the shorter one of a
pair has at most SHORT letters between the beginning and the end that all share,
whole sequences go into the index.  Those of one length that differ in s
letters agree when the letters at these places are left out, and in one choice of
places only; others agree when the longer loses k letters and the shorter as many
less as it is shorter, or both k - 1.
"""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each k the edits that the first and the second half may have.
SPLIT = {1: (0, 0), 2: (0, 1), 3: (1, 1)}


#: Letters between the shared ends up to which whole sequences less some letters are the index.
SHORT = 24
#: For these k.  Of k = 3 the index has several times as many rows, and was slower than halves wherever measured (README).
WHOLE = {2}


def _half(side: int, s: str, n: str) -> str:
    """SQL: the first or the last n letters of s, or all where it has fewer."""
    return f"substring({s}, 1, greatest({n}, 0))" if side == 0 else f"if({n} <= 0, '', substring({s}, -least({n}, length({s}))))"


def _forms(df: DataFrame, column: str, side: int, edits: int, sizes: str, longer: str) -> DataFrame:
    """column, half, lost (a letter's place; 0: none), key: halves of each size that are `longer` by each of these, as they are and less one letter each.

    As long as asked: either side may have lost the letter; longer: this one has; shorter: the other has.
    """
    of = df.select(column, F.expr(f"explode({sizes})").alias("size")).select("*", F.expr(f"explode({longer})").alias("longer"))
    of = of.withColumn("half", F.expr(_half(side, column, "size + longer")))
    if not edits:
        return of.select(column, "half", F.lit(0).alias("lost"), F.xxhash64("size", "half").alias("key"))
    of = of.withColumn("lost", F.expr("explode(sequence(if(longer > 0, 1, 0), if(longer < 0, 0, greatest(length(half), if(longer > 0, 1, 0)))))"))
    of = of.filter("lost < 2 OR substring(half, lost, 1) <> substring(half, lost - 1, 1)")  # of equal letters in a row the first stands for all
    form = F.expr("if(lost = 0, half, concat(substring(half, 1, lost - 1), substring(half, lost + 1)))")
    return of.select(column, "half", "lost", F.xxhash64("size", form).alias("key"))


def _shared_ends(left: DataFrame, right: DataFrame) -> tuple[str, str, int]:
    """The beginning and the end that all sequences have (a + end is nowhere longer than a sequence), and letters in all, to the power of three."""
    both = left.select(F.col("a").alias("s")).union(right.select("b"))
    n = F.length("s").cast("double")
    told = both.agg(F.min("s"), F.max("s"), F.min(F.reverse("s")), F.max(F.reverse("s")), F.min(F.length("s")), F.count("*")).first()
    if not told[5]:
        return "", "", 0
    start = os.path.commonprefix(told[:2])
    end = os.path.commonprefix(told[2:4])[: told[4] - len(start)][::-1]
    inner = F.least(n - len(start) - len(end), F.lit(float(SHORT + 3)))
    return start, end, int(both.agg(F.sum(inner * inner * inner)).first()[0])


def _less(df: DataFrame, n: int) -> DataFrame:
    """m, at, rest: sequences without n of their letters, for every choice of places, which `at` holds."""
    if n == 0:
        return df.select("m", F.lit(0).cast("long").alias("at"), F.col("m").alias("rest"))
    out = df.filter(F.length("m") >= n).withColumn("p1", F.expr(f"explode(sequence(1, length(m) - {n - 1}))"))
    rest = "substring(m, 1, p1 - 1)"
    for i in range(2, n + 1):
        out = out.withColumn(f"p{i}", F.expr(f"explode(sequence(p{i - 1} + 1, length(m) - {n - i}))"))
        rest += f", substring(m, p{i - 1} + 1, p{i} - p{i - 1} - 1)"
    at = " + ".join(f"p{i} * {1 << 20 * (i - 1)}L" for i in range(1, n + 1))
    return out.select("m", F.expr(at).alias("at"), F.expr(f"concat({rest}, substring(m, p{n} + 1))").alias("rest"))


def _emptied(df: DataFrame, n: int) -> DataFrame:
    """As _less, and sequences of fewer letters without any."""
    return _less(df, n).union(df.filter(F.length("m") < n).select("m", F.lit(0).cast("long"), F.lit("")))


def _met(mine: DataFrame, theirs: DataFrame, parts: int) -> DataFrame:
    """x, y, at, bt of rows with equal keys."""
    mine = mine.select("key", F.col("m").alias("x"), "at").repartition(parts, "key")
    return mine.join(theirs.select("key", F.col("m").alias("y"), F.col("at").alias("bt")).repartition(parts, "key").hint("merge"), "key").drop("key")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _substituted(a: DataFrame, b: DataFrame, k: int, parts: int) -> DataFrame:
    """Pairs of one length that agree but for up to k places: each comes as a result once, with the places in which it differs."""
    keyed = lambda df: _union([_less(df, n).select("m", "at", F.xxhash64(F.lit(n), F.length("m"), "at", "rest").alias("key")) for n in range(k + 1)])
    return _met(keyed(a), keyed(b), parts)


def _differ_there(k: int):
    """The letters at all places that were left out differ, so that no fewer places would have done."""
    out = F.expr("at = bt AND length(x) = length(y)")
    for i in range(k):
        place = f"int(shiftright(at, {20 * i}) & {(1 << 20) - 1})"
        out = out & F.expr(f"{place} = 0 OR substring(x, {place}, 1) <> substring(y, {place}, 1)")
    return out


def _shifted(a: DataFrame, b: DataFrame, k: int, parts: int) -> DataFrame:
    """Pairs that need letters put in or taken out, several times perhaps: both without k - 1, or the longer without k and the shorter without fewer."""
    kind = lambda df, n, name: _emptied(df, n).select("m", "at", F.xxhash64(F.lit(name), "rest").alias("key"))
    keyed = lambda df, longer, shorter: _union([kind(df, k - 1, "same"), kind(df, k, longer), *[kind(df, n, shorter) for n in range(k)]])
    met = _met(keyed(a, "left", "right"), keyed(b, "right", "left"), parts)
    return met.filter(F.abs(F.length("x") - F.length("y")) <= k).filter("length(x) <> length(y) OR at <> bt")


def _short_pairs(left: DataFrame, right: DataFrame, k: int) -> tuple[DataFrame, DataFrame, str, str]:
    """Substituted and shifted candidates (x, y without the shared ends) whose shorter one has up to SHORT letters, and the ends."""
    start, end, cubes = _shared_ends(left, right)
    rows = cubes // (3 if k == 3 else 8)  # about what the index has
    parts = 1 + min(rows // 200_000, 63) + rows // 4_000_000
    middle = lambda df, c: df.select(F.expr(f"substring({c}, {len(start) + 1}, length({c}) - {len(start) + len(end)})").alias("m")).filter(F.length("m") <= SHORT + k).repartition(parts, "m")
    a, b = middle(left, "a"), middle(right, "b")
    near = F.least(F.length("x"), F.length("y")) <= SHORT
    return _substituted(a, b, k, parts).filter(near), _shifted(a, b, k, parts).filter(near), start, end


def _whole(pairs: DataFrame, start: str, end: str) -> DataFrame:
    of = lambda c: F.concat(F.lit(start), F.col(c), F.lit(end))
    return pairs.withColumns({"a": of("x"), "b": of("y")})


def edit_candidates(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of the distinct sequences of left (a) and right (b) that the index can't rule out; a pair may come several times."""
    if k not in WHOLE:
        return _half_candidates(left, right, k)
    same, shifted, start, end = _short_pairs(left, right, k)
    found = _whole(same.filter(_differ_there(k)).unionByName(shifted), start, end).select("a", "b")
    return found.union(_long_candidates(left, right, k, len(start) + len(end)))


def _long_candidates(left: DataFrame, right: DataFrame, k: int, ends: int) -> DataFrame:
    return _half_candidates(left.filter(F.length("a") > SHORT + ends), right.filter(F.length("b") > SHORT + ends), k)


def _half_candidates(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs that half of one can't rule out."""
    out = None
    for side, edits in enumerate(SPLIT[k]):
        size = lambda n, s=side: f"int({n} div 2)" if s == 0 else f"int({n} - {n} div 2)"
        mine = _forms(left, "a", side, edits, f"array({size('length(a)')})", "array(0)")
        # a left sequence has up to k letters more or less than this one
        sizes = f"array_distinct(transform(sequence(greatest(length(b) - {k}, 0), length(b) + {k}), n -> {size('n')}))"
        theirs = _forms(right, "b", side, edits, sizes, f"sequence(-{edits}, {edits})")
        mine, theirs = mine.withColumnsRenamed({"half": "x", "lost": "i"}), theirs.withColumnsRenamed({"half": "y", "lost": "j"})
        fits = (F.abs(F.length("a") - F.length("b")) <= k) & ((F.col("i") == 0) | (F.col("j") == 0) | (F.col("x") != F.col("y")))  # equal halves meet as they are
        # by shuffles whatever the inputs' sizes: the optimizer doesn't know how many rows come of each, and would broadcast them
        found = mine.join(theirs.hint("merge"), "key").filter(fits).select("a", "b")
        out = found if out is None else out.union(found)
    return out


def edit_pairs(left: DataFrame, right: DataFrame, k: int, left_seq: str = "seq", right_seq: str = "seq") -> DataFrame:
    """Distinct (left_seq, right_seq, distance) with Levenshtein distance at most k (0 to 3)."""
    if isinstance(k, bool) or not isinstance(k, int) or not 0 <= k <= 3:
        raise ValueError("the distance is a whole number from 0 to 3")
    a = left.select(F.col(left_seq).alias("a")).filter("a IS NOT NULL").distinct()
    b = right.select(F.col(right_seq).alias("b")).filter("b IS NOT NULL").distinct()
    if k == 0:
        return a.join(b, a["a"] == b["b"]).select("a", "b", F.lit(0).alias("distance"))
    near = lambda df, x="a", y="b": df.withColumn("distance", F.levenshtein(x, y, k)).filter("distance >= 0")
    if k not in WHOLE:
        return near(_half_candidates(a, b, k)).distinct()
    same, shifted, start, end = _short_pairs(a, b, k)
    apart = F.expr(f"length(x) <> length(y) OR aggregate(sequence(1, length(x)), 0, (n, i) -> n + int(substring(x, i, 1) <> substring(y, i, 1))) > {k}")  # others are among the same
    shifted = near(shifted, "x", "y").filter(apart).select("x", "y", "distance").distinct()
    short = near(same.filter(_differ_there(k)), "x", "y").select("x", "y", "distance").union(shifted)
    long = near(_long_candidates(a, b, k, len(start) + len(end))).distinct()
    return _whole(short, start, end).select("a", "b", "distance").union(long.select("a", "b", "distance"))


def edit_join(left: DataFrame, right: DataFrame, left_seq: str, right_seq: str, k: int) -> DataFrame:
    """Rows of left and right whose sequences are within k edits, with the distance."""
    pairs = edit_pairs(left, right, k, left_seq, right_seq)
    return left.join(pairs, left[left_seq] == pairs["a"]).join(right, F.col("b") == right[right_seq]).drop("a", "b")
