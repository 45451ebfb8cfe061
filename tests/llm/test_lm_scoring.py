import math
import random
from collections import Counter

import numpy as np
import pytest

from epiloom.llm import lm_scoring as m
from epiloom.llm.common import pack_sorted, unpack_sorted


def brute(docs, order):
    words = [(t or "").encode().lower().split() for _, t in docs]
    grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in words]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    every, out = sum(map(len, words)), []
    for (d, _), w, own in zip(docs, words, grams, strict=True):
        c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        rest, log, back = max(every - len(w), 1), 0.0, 0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    log += math.log(factor * (c(g) or m.ALPHA) / rest)
                elif c(g) > 0:
                    log += math.log(factor * c(g) / c(g[:-1]))
                    break
                else:
                    back += factor == 1.0
                    factor *= m.ALPHA
        out.append((d, len(w), back, round(log, 6), round(log / len(w), 6) if w else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order):
    rng = random.Random(order)
    docs = [(d, " ".join(rng.choice("abcdefghi") for _ in range(rng.randint(0, 60)))) for d in range(50)]
    docs += [(100, None), (2**60 + 1, ""), (None, "a b zz"), (3, docs[3][1]), (102, "Q " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS block")
    got = m.lm_scores(df, order=order, block_words=300, shard_ngrams=40).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 6), None if r.mean_log_score is None else round(r.mean_log_score, 6)) for r in got), key=repr) == brute(docs, order)


def test_empty(spark):
    assert m.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert m.lm_scores(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()[1] == 0


def test_packing_of_numbers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(unpack_sorted(pack_sorted(x)), x)
        c = rng.integers(1, 400, n)
        assert np.array_equal(m.unpack_counts(m.pack_counts(c)), c)
    assert unpack_sorted(pack_sorted(np.array([0, 2**64 - 1], np.uint64))).tolist() == [0, 2**64 - 1]


def test_registered_query_has_trigram_evidence(spark, tmp_path):
    from epiloom.llm.queries import QUERIES

    rng = random.Random(9)
    docs = [(d, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40)))) for d in range(40)] + [(100, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()
    want = {d: (n, back, log) for d, n, back, log, _ in brute(docs, 3)}
    assert {r.doc_id: (r.n_words, r.n_backoff) for r in got} == {d: w[:2] for d, w in want.items()}
    assert all(abs(r.log_score - want[r.doc_id][2]) < 1e-3 for r in got)
    assert any(want[d][1] != back for d, _, back, *_ in brute(docs, 2))


def test_blocks_and_answers_stay_whole_in_large_shards(spark):
    """One word that all hold, a document longer than a block, rows that repeat: as without blocks."""
    rng = random.Random(3)
    docs = [(d % 70, "the " * (d % 4) + " ".join(rng.choice(["x", "y", "z", "the"]) for _ in range(30))) for d in range(120)] + [(None, "the " * 900), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: repr((r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 6)))
    one = sorted(map(key, m.lm_scores(df.coalesce(1), shard_ngrams=10**9).collect()))
    assert one == sorted(map(key, m.lm_scores(df.repartition(7), block_words=50, shard_ngrams=5).collect()))
    assert [eval(x) for x in one] == [x[:4] for x in sorted(brute(docs, 3), key=lambda x: repr(x[:4]))]
