import random
import re
from collections import defaultdict
from itertools import permutations

from epiloom.llm import filter_audit as m


def brute(docs, labels):
    """Every order applied to every document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t)
    rows = []
    for d, source, t in docs:
        t = t or ""
        w, quality, toxic = words(t), {q for i, q, _ in labels if i == d and d is not None}, {x for i, _, x in labels if i == d and d is not None}
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(i is not None and i < d and (x or "") == t for i, _, x in docs),
        }
        rows.append((source or "", fails, 1 in quality, 1 in toxic))
    removed_of, out = defaultdict(int), []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            here = own
            for k, f in enumerate(order):
                gone = [r for r in here if r[1][f]]
                here = [r for r in here if not r[1][f]]
                redundant = sum(r[1][f] and any(r[1][g] for g in order[:k]) for r in own)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                removed_of[part, f] += len(gone)
                out.append([part, "".join(order), k + 1, len(here), len(gone), redundant, only, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:-1], removed_of[r[0], r[-1]]) for r in out)


def corpus(rng):
    docs = []
    for d in range(120):
        words = [rng.choice(["tree", "Tree", "é", "AB", "x%", "|"] if rng.random() < 0.2 else [f"w{i}" for i in range(99)]) for _ in range(rng.choice([0, 5, 49, 50, 80]))]
        docs.append((d, rng.choice(["a", "b", "", None]), rng.choice([" ", "\t", "\x0b \n"]).join(words)))
    docs += [(200 + i, rng.choice("ab"), rng.choice([docs[3][2], docs[9][2], None])) for i in range(40)]
    return [*docs, docs[5], docs[5], (5, "b", docs[5][2]), (5, "a", "other " * 60), (None, "a", docs[9][2]), (None, "a", docs[9][2]), (None, None, "only here"), (None, "b", "only here"), (999, "c", "word " * 300_000)]


LABELS = [(d, d % 2, int(d % 3 == 0)) for d in range(0, 220, 2)] + [(5, 1, None), (5, None, 1), (5, 0, 0), (None, 1, 1), (7, None, None), (4, 1, 1), (777, 1, 1)]


def test_equals_brute_force(spark):
    docs = corpus(random.Random(4))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "doc_id AS part", "text AS mask", "1 AS n", "2 AS good", "3 AS same")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS apart")
    got = m.filter_interactions(df, labels)
    assert sorted(map(tuple, got.collect())) == brute(docs, LABELS)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert m.filter_interactions(docs.limit(0), labels).count() == 0
    assert m.filter_interactions(docs, labels).agg({"good_lost": "sum", "removed": "sum"}).first()["sum(good_lost)"] == 0


def test_shapley_shares_what_all_filters_remove(spark):
    masks = spark.createDataFrame([("p", 3, 4, 1, 0), ("p", 7, 2, 0, 0), ("p", 0, 9, 0, 0), ("p", 4, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    rows = m.audit(masks, "XYZ").collect()
    share = {r.filter_order[r.step - 1]: r.shapley for r in rows}
    assert len(rows) == 18 and sum(share.values()) == 6 * 7 and share["X"] == share["Y"] == 6 * 2 + 2 * 2 and share["Z"] == 6 + 2 * 2
