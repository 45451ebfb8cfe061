import hashlib
import random

import numpy as np

from epiloom.llm import fingerprints as m

WORDS = [f"w{i:03d}{'xyz'[i % 3]}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_equal_substrings_are_cut_alike():
    rng = random.Random(1)
    middle = prose(rng, 300)
    a, b = prose(rng, 37) + middle + prose(rng, 5), "?" * 3 + prose(rng, 111) + middle
    names = []
    for t in (a, b):
        x = m.mix(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        starts = np.array([0])
        for _ in range(3):
            x, starts = m.phrases(x, starts)
        names.append(set(x.tolist()))
    assert len(names[0] & names[1]) > 0.8 * len(middle) / 40
    x = m.mix(np.frombuffer(middle.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    y, _ = m.phrases(x, np.array([0]))
    assert len(x) / 6 < len(y) < len(x) / 2


def test_likeness_follows_the_share_in_common():
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(800)]
    texts = [" ".join(base)]
    for share in (0.0, 0.1, 0.5, 1.0):
        k = int(len(base) * share)
        texts.append(" ".join(base[: len(base) - k] + [rng.choice(WORDS) + "q" for _ in range(k)]))
    s = m.sketches(texts)
    near = m.likeness(np.repeat(s[:1], 4, axis=0), s[1:])
    assert near[0] == 1.0 and 0.7 < near[1] < 0.95 and 0.2 < near[2] < 0.5 and near[3] < 0.1
    empty = m.sketches(["", "", "a"])
    assert m.likeness(empty[:1], empty[1:2])[0] == 1.0 and m.likeness(empty[:1], empty[2:])[0] == 0.0
    assert all(len(m.sketches([t])[0]) == 256 for t in ("a", "aa", "a" * 9999, "ab" * 5000))


def brute(rows):
    rows = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    out = []
    for i, (has, d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][2]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        out.append((d if has else None, len(t), hashlib.sha256(e.encode()).hexdigest(), m.sketches([t])[0].tobytes().hex(), m.sketches([e])[0].tobytes().hex()))
    return sorted(out, key=repr)


def test_next_documents_across_parts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(10_000), prose(rng, rng.randint(0, 60))) for _ in range(300)] + [(5, None), (7, ""), (8, "é" * 3001)]
    ids = [r[0] for r in rows]
    rows = [r for i, r in enumerate(rows) if r[0] not in ids[:i]]
    monkeypatch.setattr(m, "PART_CHARS", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "text AS fingerprint")
    got = m.fingerprints(df.repartition(7)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_null_and_empty_tables(spark):
    one = m.fingerprints(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    assert m.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = m.fingerprints(spark.createDataFrame([(1, "xy"), (1, "xy"), (2, "zz")], "doc_id long, text string")).collect()
    assert len(twice) == 3
