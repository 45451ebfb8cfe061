import random

import numpy as np

from epiloom.llm import ngram_join as m
from epiloom.llm.components import connected_components


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    s = [sets(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(rng):
    words = [f"v{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    docs = []
    for g in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        if g % 3 == 0:
            text += passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            docs.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
    docs = list(enumerate(docs))
    return [*docs, (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a\tB"), (None, docs[0][1]), (None, "nobody else says this at all"), (905, "x " * 3000), (906, "x " * 2500), (3, docs[3][1])]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(random.Random(seed))
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS size", "text AS class")
        got = sorted(map(tuple, m.near_duplicates(df.repartition(5), filter_bytes=-seed if seed == 2 else 1 << 20).collect()), key=repr)
        assert got == brute(docs)


def test_empty_and_alone(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(none).count() == 0
    assert [tuple(r) for r in m.near_duplicates(spark.createDataFrame([(4, "one two")], none.schema)).collect()] == [(4, 1, 4)]


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_a_large_group_and_a_frequent_shingle(spark, monkeypatch):
    """One text edited 1,500 times, some copies of copies, and five words that all documents hold: long lists are dealt and split."""
    monkeypatch.setattr(m, "LIST_ROWS", 200)
    monkeypatch.setattr(m, "HOT_HOLDERS", 300)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(4000)]
    text, often = [rng.choice(words) for _ in range(60)], "said by all of them"
    docs, last = [], text
    for d in range(1500):
        held = list(last if d % 7 == 0 else text)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            held[rng.randrange(60)] = rng.choice(words)
        last = held
        docs.append((d, " ".join(held) + " " + often))
    docs += [(2000 + d, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9]))) + " " + often) for d in range(400)]
    got = sorted(map(tuple, m.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()), key=repr)
    assert got == brute(docs)


def test_required_is_never_more_than_linked_prefixes_share():
    rng = random.Random(8)
    for _ in range(2000):
        common = rng.randint(1, 40)
        a = set(range(common)) | {100 + i for i in range(rng.randint(0, 12))}
        b = set(range(common)) | {200 + i for i in range(rng.randint(0, 12))}
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        order = {x: rng.random() for x in a | b}
        la, lb = (rng.randint(1, min(8, m.needed(len(x)))) for x in (a, b))
        head = lambda x, l: set(sorted(x, key=order.get)[: len(x) - m.needed(len(x)) + l])  # noqa: B023, E731, E741
        assert len(head(a, la) & head(b, lb)) >= m.required(len(a), la, len(b), lb, m.SHARE) >= min(la, lb)
        k = int(m.counted(len(a), la, len(b), lb, m.SHARE))
        pa, pb = ({x: i for i, x in enumerate(sorted(y, key=order.get))} for y in (a, b))
        met = [x for x in head(a, la) & head(b, lb) if m.allowed(len(a), pa[x], len(b), pb[x], k - 1, m.SHARE)]
        assert len(met) >= k >= min(la, lb) and any(m.allowed(len(a), pa[x], len(b), pb[x], 0, m.SHARE) for x in met)


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_that_signatures_keep_apart_and_list_rows_stay_where_they_are(spark):
    """Texts that share a third with another one each, too little for a link, and near copies of some: what travels for joins stays under 12 x the text where nothing is broadcast (23.2 x when sets and list rows travelled for each join)."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(50_000)}"
    docs, last = [], [word() for _ in range(300)]
    for d in range(1200):
        last = last[200:] + [word() for _ in range(200)]
        docs.append((d, " ".join(last)))
        if d % 10 == 0:
            docs.append((5000 + d, " ".join(["new", *last[1:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r.doc_id: r.component_id for r in m.near_duplicates(df).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {d: d % 5000 for d, _ in docs}
    assert moved < 12 * sum(len(t) for _, t in docs)
    assert not [t.name for t in spark.catalog.listTables("default") if t.name.startswith("epiloom_")]


def test_signatures_leave_every_link(spark):
    rng = random.Random(12)
    sets = {c: [rng.getrandbits(64) for _ in range(rng.choice([1, 3, 40, 300]))] for c in range(30)}
    for c in range(30, 120):
        of = sets[rng.randrange(30)]
        sets[c] = of[: rng.randint(1, len(of))] + [rng.getrandbits(64) for _ in range(rng.randint(0, 60))]
    sets[120] = [(7 << 56) + i for i in range(400)]  # more than a byte counts
    sets[121] = sets[120][:300]
    rows = [(c, None if (x := m.signature(np.array(s, np.uint64))) is None else bytearray(x)) for c, s in sets.items()]
    pairs = [(a, b) for a in sets for b in sets if a < b]
    held = {(r.a, r.b) for r in m.fitting(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "class long, signature binary"), m.SHARE).collect()}
    linked = {(a, b) for a, b in pairs if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    assert linked and (120, 121) in linked and linked <= held and len(held) < len(pairs) // 2


def test_place_size_and_matches_in_one_value():
    size, place, l = (np.array(x) for x in ([1, 5, (1 << 30) - 1], [0, 4, (1 << 30) - 2], [1, 8, 8]))  # noqa: E741
    assert [x.tolist() for x in m.out_of(m.in_one(size, place, l))] == [size.tolist(), place.tolist(), l.tolist()]


def test_hubs_of_the_same_list():
    starts, c, hub = np.array([0, 3, 5]), np.array([4, 6, 9, 4, 7]), np.array([9, 6, 5, 9, 4])
    assert m.hub_here(starts, c, hub).tolist() == [True, False, False, False, True]
