import random
import zlib

import numpy as np
import pytest

from epiloom.llm import toxicity as m

CLEAN = [f"mot{i}a" for i in range(500)]
BAD = ["blighter", "scoundrel", "rotter", "cadling"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(8), [], []
    for d in range(900):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 120))]
        bad = d % 5 == 0
        if bad:
            for _ in range(max(2, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ish"])
        docs.append((d, " ".join(words)))
        labels.append((d, int(bad)))
    docs += [(1000, None), (1001, ""), (None, "you blighter"), (1002, "x" * 200_000), (5, docs[5][1])]
    labels += [(1000, None), (None, 1), (4000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS score"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = m.train(docs, labels)
    got = m.toxicity(docs, model).select("doc_id", "score", "predicted", m.is_held_out(m.F.col("doc_id")).alias("held")).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= m.THRESHOLD) for r in got)
    for r in got:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(r.doc_id % 5 == 0, r.predicted) for r in got if r.held and r.doc_id < 900]
    assert sum(y == p for y, p in held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_held_out_labels_teach_nothing(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", m.F.when(m.is_held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = m.train(docs, labels), m.train(docs, flipped)
    assert a.lexicon == b.lexicon and np.array_equal(a.at, b.at) and np.array_equal(a.value, b.value)


def test_without_labels(spark, corpus):
    docs, labels = corpus
    model = m.train(docs, labels.limit(0))
    assert {r.score for r in m.toxicity(docs.limit(3), model).collect()} == {0.0}
    assert m.toxicity(docs.limit(0), model).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    at, value = m.isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(int))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()


def test_rare_label_still_teaches(spark):
    rng, docs, labels = random.Random(4), [], []
    for d in range(9000):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(10, 30))]
        if d % 160 == 0:
            words[::4] = [rng.choice(BAD) for _ in words[::4]]
        docs.append((d, " ".join(words)))
        labels.append((d, int(d % 160 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = m.train(docs, labels, sample=640)
    assert model.trees is not None
    got = m.toxicity(docs, model).filter("predicted = 1").select("doc_id").collect()
    found = [r.doc_id % 160 == 0 for r in got]
    assert sum(found) > 0.8 * 57 and sum(found) > 0.9 * len(found)


def test_quotas():
    assert m.quotas({0: 890, 1: 110}, 16_000) == {0: 890, 1: 110}
    assert m.quotas({0: 89_000, 1: 11_000}, 16_000) == {0: 14_240, 1: 1_760}
    assert m.quotas({0: 9_995_000, 1: 5_000}, 16_000) == {0: 15_000, 1: 1_000}
    assert m.quotas({0: 5, 1: 10**6}, 16_000) == {0: 5, 1: 15_995}
    assert m.quotas({0: 0, 1: 0}, 16_000) == {0: 0, 1: 0}


def test_equal_texts_with_other_labels_teach_nothing(spark):
    rng = random.Random(4)
    docs = [(d, " ".join(rng.choice(["sun", "tree", "river", "hill", "stone"]) for _ in range(12)) + (" vile scum" if d % 5 == 0 else "")) for d in range(400)]
    docs += [(1000 + d, "said twice over") for d in range(40)]
    labels = [(d, int(d % 5 == 0)) for d in range(400)] + [(1000 + d, d % 2) for d in range(40)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    runs = []
    for n in (1, 7):
        got = m.toxicity(d.repartition(n), m.train(d.repartition(n), y.repartition(n + 1))).collect()
        runs.append({r.doc_id: round(r.score, 9) for r in got})
    assert runs[0] == runs[1]
    assert all((s >= 0.7) == (d % 5 == 0) for d, s in runs[0].items() if d < 400) and runs[0][1000] < 0.7
