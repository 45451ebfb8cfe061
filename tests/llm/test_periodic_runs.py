import hashlib
import random

import pytest

from epiloom.llm import periodic_runs as m


def brute(words, least, times):
    """All runs by their definition: maximal stretches of each period, of which the period is the smallest."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                part = words[i : j + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def corpus(rng):
    for k in range(150):
        words = []
        while len(words) < rng.choice([10, 30, 100, 700]):
            part = [rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 7, 9, 65, 130]))]
            words += (part * rng.choice([1, 1, 2, 3, 4, 9]))[: rng.randint(1, 400)]
        yield [w.encode() for w in words]


@pytest.mark.parametrize("least, times", [(24, 3), (8, 3), (6, 2)])
def test_runs_equal_the_definition(least, times):
    for words in corpus(random.Random(least)):
        assert m.runs_of(words, least, times) == brute(words, least, times)


def test_long_periods_and_long_texts():
    rng = random.Random(5)
    part = [b"%d" % rng.randrange(10**6) for _ in range(5001)]
    words = [b"x"] * 3 + part * 3 + part[:7] + [b"y"]
    assert m.runs_of(words) == [(3, 15010, 5001)]
    assert m.runs_of(words[:-12]) == []
    same = [b"a"] * 200_000
    assert m.runs_of(same) == [(0, 200_000, 1)]
    long = ([b"a"] * 99 + [b"b"]) * 400
    assert sorted(m.runs_of(long), key=lambda r: -r[1])[0] == (0, 40_000, 100) and len(m.runs_of(long)) == 401


def test_windows_find_every_lag_of_a_run():
    rng, found = random.Random(9), m.Found()
    for q in (64, 65, 127, 128, 129, 500):
        words = [str(rng.randrange(3)) for _ in range(rng.randint(0, 99))] + [str(rng.randrange(10**9)) for _ in range(q)] * 3
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = m.np.array([number[w] for w in words])
        assert q in [x for lags in m.window_lags(ids, found, 3) for x in lags]


def test_rows_nulls_and_clashing_columns(spark):
    docs = [(1, "a b " * 20, 7, "x"), (1, "a b " * 20, 7, "x"), (None, "\x0bA a " * 30, None, None), (2, None, 1, ""), (3, " \t\n", 1, ""), (4, "w " * 50_000, 1, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, runs long, collapsed string")
    got = m.periodic_runs(df).collect()
    assert m.periodic_runs(df).columns == ["doc_id", "text", "runs", "collapsed"]
    by_text = {r.text: r for r in got}
    assert len(got) == 6 and len({tuple(r.runs) for r in got if r.doc_id == 1}) == 1
    assert [tuple(x) for x in by_text["a b " * 20].runs] == [(0, 40, 2)] and by_text["a b " * 20].collapsed == "a b"
    assert by_text[None].collapsed == "" and by_text[" \t\n"].runs == [] and by_text["w " * 50_000].collapsed == "w"
    assert [tuple(x) for x in by_text["\x0bA a " * 30].runs] == [(0, 60, 2)]
    assert m.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.periodic_runs(df, 3, 3)


def test_digest(spark):
    text = " ".join(["p", *(["a", "b"] * 15), *"cdefgh", *(["z"] * 45)])
    row = m.digest(m.periodic_runs(spark.createDataFrame([(5, text), (6, "one two")], "doc_id long, text string"))).orderBy("doc_id").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(row[0]) == (5, 2, 37, 45, 1, 45_000, sha("1,30,2\n37,45,1\n"), sha("p a b c d e f g h z"))
    assert tuple(row[1]) == (6, 0, None, None, None, None, sha(""), sha("one two"))


def test_planted_rows(spark):
    import zlib

    docs = [(i, " ".join(f"w{k}" for k in range(i % 97))) for i in range(400)]
    got = {r.doc_id: r.text for r in m.planted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        h, w = zlib.crc32(str(i).encode()), text.split()
        g, n = h // 10, len(text.split())
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        assert got[i] == text
