import hashlib
import random
from collections import defaultdict

import numpy as np

from epiloom.llm import line_dedup as m

LINE = [f"{'Line'} number {i} is long enough to count as a line that may repeat" for i in range(12)]


def brute(docs):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = lambda x: len(holders[key(x)]) >= 5 and d != max((h for h in holders[key(x)] if h is not None), default=None)
        kept = [x for x in lines if not gone(x)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng):
    docs = []
    for d in range(60):
        lines = [rng.choice(LINE) + " " * rng.randint(0, 2) if rng.random() < 0.4 else f"own {d} {i}" * rng.randint(1, 9) for i in range(rng.randint(0, 8))]
        lines = [x.upper() if rng.random() < 0.2 else "\t" + x if rng.random() < 0.2 else x for x in lines]
        docs.append((d, "\n".join(lines)))
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (None, LINE[0]), (None, LINE[1] + "\nx"), (7, docs[7][1]), (103, "é" * 39), (104, "é" * 41), (105, "\r" + LINE[2] + "\r\n" + LINE[2])]


def digest(df):
    rows = df.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(cast(coalesce(text, '') AS binary), 256) AS h").collect()
    return sorted(map(tuple, rows), key=repr)


def test_equals_brute_force_with_and_without_filters(spark):
    docs = corpus(random.Random(2))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS n_dropped", "text AS last")
    want = brute(docs)
    assert digest(m.dedupe_lines(df, shards=4)) == want
    assert digest(m.dedupe_lines(df, shards=4, filter_bytes=-1)) == want
    assert m.dedupe_lines(df.limit(0)).count() == 0
    assert m.dedupe_lines(df).columns == ["doc_id", "text", "last", "n_lines", "n_dropped"]


def test_a_hot_doc_id_is_spread_by_its_texts(spark):
    """Half of all rows have no doc_id: none gathers more keys than its own text holds."""
    rng = random.Random(5)
    shared = [f"shared line {i} that is long enough to count among the repeated ones" for i in range(60)]
    docs = [(None if i % 2 else i % 40, "\n".join(rng.sample(shared, 3))) for i in range(240)] + [(None, "\n".join(shared[:3]))] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert digest(m.dedupe_lines(df, shards=4)) == brute(docs)
    lost = m.LineIndex.of(df, 4).dropped()
    assert max(len(r["keys"]) for r in lost.collect()) == 3


def test_insertions_and_deletions_are_reversible(spark):
    docs = [x for x in corpus(random.Random(3)) if x[0] is not None and x[0] != 7]
    part = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    table = lambda x: sorted(map(tuple, x.counts.select("a", "b", "n", "last").collect()))
    base = m.LineIndex.of(part(docs[:30]), shards=3)
    whole = m.LineIndex.of(part(docs), shards=3)
    grown = base.insert(part(docs[30:]))
    assert table(grown) == table(whole)
    back = grown.delete(part(docs[30:]))
    assert table(back) == table(base)
    assert sorted(map(repr, back.dropped().collect())) == sorted(map(repr, base.dropped().collect()))
    for index in (grown, back):
        held = {r.shard: m.CuckooFilter.from_bytes(r.tags) for r in index.filters.collect()}
        assert all(held[r.shard].has(np.array([r.a]))[0] for r in index.counts.collect())


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 5000)
    f = m.CuckooFilter.of(keys[:4000])
    assert f.has(keys[:4000]).all() and f.has(keys[4000:]).mean() < 0.01
    f.remove(keys[:2000])
    assert f.has(keys[2000:4000]).all() and f.has(keys[:2000]).mean() < 0.01
    assert m.CuckooFilter.from_bytes(f.to_bytes()).has(keys[2000:4000]).all()
