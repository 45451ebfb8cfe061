"""Operator 4: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a learned lexicon (strong and weak
terms, plain and after undoing obfuscation), the densest stretch of hits, hits
near a second-person word, capitals, punctuation and obfuscation rates.  The
lexicon holds words and word beginnings that toxic training documents hold more
often than clean ones by a likelihood-ratio test.  All is learned from a sample
of at most `sample` labelled training documents (equal texts once), the first of
each label in the order of a hash of doc_id: as many as the label's share, but
for the rarer one at least sample / 16, or all that there are; calibration
weighs what was drawn more often less.  Trees are fitted to features whose lexicon comes
from the sample's other half, and calibrated on scores of folds left out.  Only the sample's
features and the best terms reach the driver.  Every document is scored.

Defined results: null text counts as empty and is scored like any other text;
labels that are null, whose doc_id is null or unknown, or that lie in the held
out third teach nothing, nor do equal texts whose labels differ; with fewer than 8 texts of either label in the sample
every score is the share of toxic ones (0 if there are none); repeated rows score alike; extra
columns pass through in `toxicity`, where score and predicted replace columns
of those names; a null doc_id isn't held out.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, table, written

SAMPLE, TERMS, THRESHOLD, LEAST_G2, FOLDS = 16_000, 600, 0.7, 20.0, 4
WORD = re.compile(r"[^\W\d_](?:[\w'@$*!]*\w)?")
#: Second-person words.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú usted ustedes vosotros su sus".split())
#: What stands for letters in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi", "*_'-.")
#: Word beginnings of these lengths can be terms.
STEMS = range(3, 8)
_CLASS = np.zeros(sys.maxunicode + 1, np.uint8)
for _c in range(0x250):
    _CLASS[_c] = 1 if chr(_c).isupper() else 2 if chr(_c).isalpha() else 0
_CLASS[0x250:] = 2
for _i, _s in enumerate("!?.,*@#$%&"):
    _CLASS[ord(_s)] = 3 + min(_i, 4)


def terms_of(word: str) -> list[str]:
    """The word as a term, and its beginnings (marked with a dash)."""
    return [word, *(word[:k] + "-" for k in STEMS if k <= len(word))]


@dataclass
class Lexicon:
    weight: dict[str, float]

    def of(self, word: str) -> float:
        """The largest weight among the word's terms, plain or deobfuscated; 0 if none is known."""
        w = self.weight
        found = max((w.get(t, 0.0) for t in terms_of(word)), default=0.0)
        if not found and not word.isalpha() and (plain := word.translate(LEET)) != word:
            found = -max((w.get(t, 0.0) for t in terms_of(plain)), default=0.0)  # negative: only after undoing
        return found


class Remembered(dict):
    def __init__(self, lexicon: Lexicon, most: int = 1 << 18):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float:
        found = self.lexicon.of(word)
        if len(word) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


N_FEATURES = 17
#: Log-odds from which a term is strong.
STRONG = 3.5


def features(text: str, known: Remembered) -> list[float]:
    words = WORD.findall(text.lower())
    n = len(words)
    c = np.bincount(_CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8) if text else np.zeros(8)
    chars, letters = max(len(text), 1), max(c[1] + c[2], 1)
    w = np.fromiter(map(known.__getitem__, words), float, n)
    at = np.flatnonzero(w)
    size = np.abs(w[at])
    strong = size >= STRONG
    near = dense = 0
    if len(at):
        places = at[strong] if strong.any() else at
        dense = int((np.searchsorted(places, places + 50) - np.arange(len(places))).max())
        near = sum(1 for i in places.tolist() if not SECOND.isdisjoint(words[max(0, i - 5) : i + 6]))
    hidden = int((w < 0).sum())
    mixed = sum(1 for x in words if not x.isalpha()) if not text.isalpha() else 0
    m = max(n, 1)
    return [
        float(strong.sum()), strong.sum() / m, float(len(at) - strong.sum()), (len(at) - strong.sum()) / m, float(size.sum()) / m, float(size.max()) if len(at) else 0.0, float(dense), near / m, float(near > 0),
        hidden / m, mixed / m, c[1] / letters, c[3] / chars, c[4] / chars, (c[5] + c[6]) / chars, c[7] / chars, math.log1p(n),
    ]


def learn_terms(counts: Counter, texts: tuple[int, int], most: int = TERMS) -> Lexicon:
    """Terms that toxic documents hold more often than chance allows (likelihood ratio, G^2).

    counts: (term, toxic) -> documents; texts: how many clean and toxic documents.
    """
    negative, positive = texts
    of = lambda k, n: k * math.log(k / n) if k else 0.0
    weight = {}
    for term in {t for t, y in counts if y}:
        p, n = counts[term, 1], counts[term, 0]
        odds = math.log((p + 0.5) / (positive - p + 0.5)) - math.log((n + 0.5) / (negative - n + 0.5))
        apart = of(p, positive) + of(positive - p, positive) + of(n, negative) + of(negative - n, negative)
        k, total = p + n, positive + negative
        g2 = 2 * (apart - of(k, total) - of(total - k, total))
        if p >= 4 and g2 >= LEAST_G2 and odds > 1:
            weight[term] = (g2, odds)
    best = sorted(weight.items(), key=lambda x: (-x[1][0], x[0]))[:most]
    return Lexicon({term: odds for term, (_, odds) in best})


@dataclass
class Trees:
    """Boosted regression trees of fixed depth over binned features, for the logistic loss."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features and bins of the inner nodes, values of the leaves

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, smooth: float = 4.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        f, trees, width = np.full(len(y), base), [], bins + 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            cut_on, cut_at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width)
            for level in range(depth):
                nodes = 2**level
                best = np.zeros(nodes)
                for j in range(x.shape[1]):
                    key = node * width + b[:, j]
                    gs = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    hs = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gain = gs**2 / (hs + smooth) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + smooth) - gs[:, -1:] ** 2 / (hs[:, -1:] + smooth)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), k]
                    for m in np.flatnonzero(top > best + 1e-9):
                        best[m], cut_on[nodes - 1 + m], cut_at[nodes - 1 + m] = top[m], j, k[m]
                node = 2 * node + (b[np.arange(len(y)), cut_on[nodes - 1 + node]] > cut_at[nodes - 1 + node])
            leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + smooth)
            f += leaf[node]
            trees.append((cut_on, cut_at, leaf))
        return cls(edges, base, trees)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for cut_on, cut_at, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            inner = 1
            while inner <= len(cut_on):
                node = 2 * node + (b[rows, cut_on[inner - 1 + node]] > cut_at[inner - 1 + node])
                inner *= 2
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and the calibrated values there; between them it is interpolated."""
    order = np.argsort(score, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []  # sums of y, of weight and of scores, weighted
    for s, v, u in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([float(u * v), float(u), float(u * s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    at = np.array([s / w for _, w, s in blocks])
    # a block's share is drawn towards 1/2 by a quarter of an outcome each way, so that no score is 0 or 1
    value = np.array([(v + 0.25) / (w + 0.5) for v, w, _ in blocks])
    return at, np.maximum.accumulate(value)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray
    share: float

    def scores(self, texts: list[str], known: Remembered) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.array([features(t, known) for t in texts]))
        return np.clip(np.interp(raw, self.at, self.value) + 1e-4 * (1 / (1 + np.exp(-raw)) - 0.5), 0, 1)


def is_held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def quotas(there: dict[int, int], sample: int) -> dict[int, int]:
    """How many labels of each kind are drawn: by their share, of the rarer at least sample / 16 if there are so many."""
    rare = min((0, 1), key=there.get)
    of_rare = min(there[rare], max(round(sample * there[rare] / max(sum(there.values()), 1)), sample // 16))
    return {rare: of_rare, 1 - rare: min(there[1 - rare], sample - of_rare)}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    there = {0: 0, 1: 0} | {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = quotas(there, sample)
    first = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(drawn[y]) for y in (0, 1)]
    chosen = first[0].union(first[1])  # the documented bound: `sample` rows of two numbers
    # a drawn row of the rarer label stands for fewer than one of the other
    stands = np.array([there[y] / max(drawn[y], 1) for y in (0, 1)])
    stands /= max(stands.max(), 1)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # equal texts teach once, and nothing where their labels contradict each other
    once = texts.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("same")).agg(F.first("text").alias("text"), F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    rows = written(once.withColumn("part", F.pmod(F.xxhash64("same", F.lit(4)), F.lit(8))))
    n = {(r.half, r.toxic): r["count"] for r in rows.groupBy((F.col("part") % 2).alias("half"), "toxic").count().collect()}
    negative, positive = (sum(v for (_, y), v in n.items() if y == t) for t in (0, 1))
    share = float(positive * stands[1] / ((positive * stands[1] + negative * stands[0]) or 1))
    if min(negative, positive) < 8:
        return Model(Lexicon({}), None, np.zeros(1), np.zeros(1), share)

    def count_terms(batches):
        import pyarrow as pa

        for batch in batches:
            c: Counter = Counter()
            for text, y, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words = set(WORD.findall(text.lower()))
                c.update((t, y, part % 2) for t in {t for w in words for t in terms_of(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array([k[2] for k in c], pa.int64()), pa.array(list(c.values()), pa.int64())], ["term", "toxic", "half", "n"]
            )

    counted = rows.select("text", "toxic", "part").repartition(16).mapInArrow(count_terms, "term string, toxic int, half long, n long")
    sums = counted.groupBy("term").agg(*(F.sum(F.expr(f"if(toxic = {y} and {which}, n, 0)")).alias(f"{name}{y}") for name, which in (("a", "half = 0"), ("b", "half = 1"), ("all", "true")) for y in (0, 1)))
    sums = written(sums.filter("all1 >= 4"))

    def learned(name: str, texts: tuple[int, int]) -> Lexicon:
        p, q = F.col(f"{name}1").cast("double"), F.col(f"{name}0").cast("double")
        negative, positive = map(float, texts)
        # the likelihood ratio of every term, as learn_terms has it; the best of those that speak for toxic texts go to the driver
        of = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
        apart = of(p, positive) + of(positive - p, positive) + of(q, negative) + of(negative - q, negative)
        g2 = 2 * (apart - of(p + q, positive + negative) - of(positive + negative - p - q, positive + negative))
        odds = F.log((p + 0.5) / (positive - p + 0.5)) - F.log((q + 0.5) / (negative - q + 0.5))
        best = sums.filter((p >= 4) & (odds > 1)).orderBy(F.desc(F.round(g2, 6)), "term").limit(2 * TERMS).select("term", p.cast("long").alias("p"), q.cast("long").alias("q")).collect()
        return learn_terms(Counter({(r.term, 1): r.p for r in best}) | Counter({(r.term, 0): r.q for r in best}), texts)

    # trees and calibration see documents that their lexicon wasn't learned from; scoring uses all that the sample teaches
    halves = [learned(name, (n.get((h, 0), 0), n.get((h, 1), 0))) for h, name in enumerate("ab")]
    final = learned("all", (negative, positive))

    def describe(batches):
        import pyarrow as pa

        known = [Remembered(x) for x in halves]
        for batch in batches:
            x = [features(t, known[1 - part % 2]) for t, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "part"])

    data = rows.select("text", "toxic", "part").repartition(16).mapInArrow(describe, "x array<double>, toxic int, part long").collect()
    data.sort(key=lambda r: (r.part, r.toxic, r.x))
    x, y = np.array([r.x for r in data]).reshape(-1, N_FEATURES), np.array([r.toxic for r in data])
    raw, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for k in range(FOLDS):  # calibrated on scores of documents that the trees didn't see
        raw[fold == k] = Trees.fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    at, value = isotonic(raw, y, stands[y])
    return Model(final, Trees.fit(x, y), at, value, share)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text, ...) with score and predicted."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        import pyarrow as pa

        known = Remembered(model.lexicon)
        for batch in batches:
            for part in batches_of(batch):
                s = model.scores([t or "" for t in part.column(at).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], schema.fieldNames())

    return docs.mapInArrow(score, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
