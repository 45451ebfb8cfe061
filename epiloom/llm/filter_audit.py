"""Operator 11: how filters act on each other, by inclusion-exclusion (DataFrame operations only).

Every document gets a mask of the filters that it fails.  For each part the
joint failures J(S) of all sets S of filters are counted: the sum over its
documents of the product of the flags in S (J of the empty set counts the
documents).  Everything else follows from these 32 numbers:

* survivors of filters P: the sum over S within P of (-1)^|S| J(S);
* removed by f after P: survivors of P less survivors of P and f;
* failing f only: the sum over S with f in it of (-1)^(|S|-1) J(S);
* redundant: J({f}) less what f removes at its step;
* the removed of f over all orders: the game "documents that P removes" has the
  Harsanyi dividends (-1)^(|S|-1) J(S), and each S shares its dividend equally
  among its members, which is the Shapley value; times the number of orders.

The last filter asks whether a smaller doc_id has the same text.  A text's
documents are summed up by (text, doc_id) and then by (text, part) before the
rows of one text meet, so a text that a third of all documents hold is a few
numbers from each task.

Defined results: a null text is empty; a null source is the part ""; a null
doc_id has no labels, repeats nothing and is repeated by nothing; of rows with
the same doc_id and text none repeats the other; a document with several labels
is good (toxic) where any says so, without label neither.  Repeated rows count
as often as they come.  No documents: no rows.  Other columns aren't read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Words, distinct words in percent, capitals in percent.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
#: The filters in the order of their bits; the last one is the repeated text.
FILTERS = "ABCDE"
COUNTED = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """The conditions of A to D, over a text that isn't null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return [
        F.size(words) < FEWEST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def bits(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags)])


def flagged(docs: DataFrame, labels: DataFrame, failures=text_failures) -> DataFrame:
    """part, mask, n, good, toxic: how many documents, and how many of them are labelled so; the mask's last bit is the repeated text."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits(failures(text)).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("apart", F.lit(0).cast("long"))
    # rows without doc_id match nothing: their texts spread them
    rows = rows.withColumn("apart", F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(0)).join(marks, ["doc_id", "apart"], "left")
    kind = ["same", "part", "mask", "good", "toxic"]
    rows = rows.select("doc_id", "same", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min("doc_id").alias("lowest"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_lowest"),
    )
    first = by_kind.groupBy("same").agg(F.min("lowest").alias("first"), F.sum("n").alias("of_text")).filter("of_text > 1").select("same", "first")
    kinds = by_kind.join(first, "same", "left")
    new = F.col("nameless") + F.when(F.col("first").isNull() | (F.col("lowest") == F.col("first")), F.col("n_lowest")).otherwise(0)
    bit = 1 << (len(FILTERS) - 1)
    both = F.array(F.struct("mask", new.alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - new).alias("n")))
    out = kinds.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def joint_failures(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, J(S) of every set S of filters (S as a mask, in ascending order) as arrays, one for each of COUNTED."""
    # mask & s = s is the product of the flags in s
    sums = lambda c: ", ".join(f"sum({c} * CAST(mask & {s} = {s} AS long))" for s in range(1 << len(filters)))
    return masks.groupBy("part").agg(*[F.expr(f"array({sums(c)})").alias(c) for c in COUNTED])


def sign(s: int) -> int:
    return -1 if bin(s).count("1") % 2 else 1


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, the bit of its filter, the mask of those before it) of all orders."""
    out = []
    for order in permutations(filters):
        before = 0
        for k, name in enumerate(order):
            out.append(("".join(order), k + 1, filters.index(name), before))
            before |= 1 << filters.index(name)
    return out


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, of what flagged() returns."""
    sets, m = range(1 << len(filters)), len(filters)
    of = lambda c, terms: " + ".join(f"{k} * {c}[{s}]" for s, k in terms)
    array = lambda items: F.expr(f"array({', '.join(items)})")  # noqa: E731  expressions as SQL: thousands of terms are parsed at once
    survivors = lambda c: array(of(c, [(s, sign(s)) for s in sets if s & p == s]) for p in sets)
    with_bit = lambda weigh: array(of("n", [(s, -sign(s) * weigh(s)) for s in sets if s >> f & 1]) for f in range(m))
    per_part = joint_failures(masks, filters).select(
        "part",
        *[survivors(c).alias(f"left_{c}") for c in COUNTED],
        array(f"n[{1 << f}]" for f in range(m)).alias("fails"),
        with_bit(lambda s: 1).alias("only"),
        with_bit(lambda s: factorial(m) // bin(s).count("1")).alias("share"),
    )
    rows = array(f"struct('{o}' AS filter_order, {k} AS step, {f} AS f, {p} AS p)" for o, k, f, p in steps(filters))
    each = per_part.withColumn("_", F.explode(rows)).select("*", "_.*")
    gone = lambda c: F.col(f"left_{c}")[F.col("p")] - F.col(f"left_{c}")[F.col("p").bitwiseOR(F.expr("shiftleft(1, f)"))]
    return each.select(
        "part",
        "filter_order",
        "step",
        F.col("left_n")[F.col("p").bitwiseOR(F.expr("shiftleft(1, f)"))].alias("kept"),
        gone("n").alias("removed"),
        (F.col("fails")[F.col("f")] - gone("n")).alias("redundant"),
        F.col("only")[F.col("f")].alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.col("share")[F.col("f")].alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(flagged(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
flags AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b | b.b | c.b | d.b | e.b = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
each_step AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | f) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & f <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & f <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & f <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & f <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM each_step
"""
