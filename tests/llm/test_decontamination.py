import random

import numpy as np

from epiloom.llm import decontamination as m

WORDS = [f"word{i}" for i in range(3000)]


def slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (m.MATCH if a[i - 1] == b[j - 1] else m.MISS), h[i - 1, j] + m.GAP, h[i, j - 1] + m.GAP)
    return int(h.max())


def test_alignment_equals_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 12))], np.uint64)
        b = np.array([rng.randrange(6) for _ in range(rng.randint(1, 15))], np.uint64)
        score, end, length = m.align(a, b)
        assert score == slow_alignment(a, b)
        if score:
            assert slow_alignment(a, b[end - length : end]) == score


def planted(rng):
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(15, 50)))) for k in range(30)]
    docs, want = [], set()
    for d in range(240):
        text = [rng.choice(WORDS) for _ in range(rng.randint(30, 200))]
        if d % 4 == 0:
            k, item = rng.choice(items)
            words = item.split()
            if d % 8 == 0:  # edited: words replaced, dropped, put in
                words = [w if rng.random() > 0.12 else rng.choice(WORDS) for w in words if rng.random() > 0.04]
                words.insert(len(words) // 2, "put")
            at = rng.randrange(len(text))
            text[at:at] = words
            want.add((d, k))
        docs.append((d, " ".join(text).capitalize() if d % 3 else " ".join(text).replace(" ", ", ")))
    return docs, items, want


def test_planted_copies_are_found_and_nothing_else(spark):
    docs, items, want = planted(random.Random(6))
    docs += [(900, None), (901, ""), (None, items[3][1]), (902, items[4][1]), (902, items[4][1])]
    items += [(77, None), (78, ""), (79, "two unheardof")]
    docs.append((903, "here are two unheardof words"))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text AS score")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text AS doc_id")
    got = m.contaminated(d, b).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == want | {(None, 3), (902, 4), (903, 79)}
    assert sum(r.doc_id == 902 for r in got) == 2 and all(r.score >= m.LEAST for r in got)
    split = m.contaminated(d, b, block_words=120).collect()  # several blocks of items
    assert sorted(map(tuple, split), key=repr) == sorted(map(tuple, got), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert m.contaminated(none, items).count() == 0
    assert m.contaminated(spark.createDataFrame([(1, "a b c d")], none.schema), items).count() == 0


def whole(items, docs, least):
    """Pairs and scores of whole documents, for all pairs with a seed."""
    out = {}
    for d, text in docs:
        h, _ = m.hashed([text])
        _, found, _ = items.hits(h)
        for k in np.unique(found):
            score = m.align(items.words[k], h)[0] / (m.MATCH * len(items.words[k]))
            if score >= least:
                out[d, items.ids[k]] = round(score, 9)
    return out


def test_pairs_and_scores_equal_those_of_whole_documents():
    rng = random.Random(12)
    texts = [(k, [rng.choice(WORDS) for _ in range(rng.choice([8, 30, 60]))]) for k in range(12)]
    docs = []
    for d in range(150):
        _, words = rng.choice(texts)
        out = []
        for cut in range(3):  # thirds of the item, apart by up to as many words as it has, one after another
            out += words[cut * len(words) // 3 : (cut + 1) * len(words) // 3] + [rng.choice(WORDS) for _ in range(rng.randint(0, len(words) * 2 // 3))]
        docs.append((d, " ".join([rng.choice(WORDS) for _ in range(rng.randint(0, 300))] + out)))
    apart = [w for cut, n in ((0, 33), (1, 34), (2, 35)) for w in texts[0][1][cut * len(texts[0][1]) // 3 : (cut + 1) * len(texts[0][1]) // 3] + ["between"] * n]
    docs.append((900, " ".join(apart)))
    items = m.Items([(k, m.hashed([" ".join(w)])[0]) for k, w in texts], m.N)
    got = {(d, items.ids[k]): round(score, 9) for d, text in docs for k, score, _, _ in items.matches(m.hashed([text])[0], m.LEAST)}
    assert got == whole(items, docs, m.LEAST) and len(got) > 80


def test_thirds_far_apart_are_found(spark):
    rng = random.Random(2)
    item = [rng.choice(WORDS) for _ in range(60)]
    docs = []
    for d, n in enumerate((22, 33, 34, 35)):
        docs.append((d, " ".join(w for c in range(3) for w in item[c * 20 : c * 20 + 20] + [f"x{d}{i}" for i in range(n)])))
    got = m.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: round(r.score, 3) for r in got} == {0: 0.633, 1: 0.45, 2: 0.433, 3: 0.417}


def test_long_texts_and_items_longer_than_a_block(spark):
    rng = random.Random(3)
    items = [(1, " ".join(rng.choice(WORDS) for _ in range(300))), (2, "x " * 400)]
    docs = [(1, " ".join(rng.choice(WORDS) for _ in range(60_000)) + " " + items[0][1]), (2, "y " * 100_000), (3, items[0][1] * 3)]
    got = m.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=100).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 1)} and all(r.score >= 0.99 for r in got)
