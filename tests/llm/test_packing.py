import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epiloom.llm import packing as m

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def exact(lengths, capacity):
    """Fewest bins, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k + lengths[i] <= capacity:
                at = bins.index(k)
                place(i + 1, [*bins[:at], k + lengths[i], *bins[at + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_and_packing(lengths):
    x = np.array(lengths)
    fewest = exact(lengths, 20)
    assert m.lower_bound(x, 20) <= fewest
    bins, offsets = m.best_fit_decreasing(x, 20)
    assert fewest <= bins.max() + 1 <= 1.5 * fewest + 1
    check(list(zip(bins.tolist(), offsets.tolist(), lengths, strict=True)), 20)


def check(rows, capacity):
    bins = {}
    for b, o, n in rows:
        bins.setdefault(b, []).append((o, n))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity


def test_pieces_and_sequences(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice(["tokens ", "é", "\n", "中", "a b ", "<|endoftext|>", "ʰ", "՘"]) for _ in range(rng.choice([0, 3, 90, 700, 4000])))) for i in range(120)]
    docs += [(500, None), (2**60 + 1, "no id either"), (None, "no id"), (3, docs[3][1]), (501, "x" * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text AS length")
    cut = m.pieces(df)
    got = m.packed(cut, part_pieces=20, released=0.5).collect()
    want = []
    for d, t in docs:
        ids = np.array(ids_of(t), "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    check([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    used, bound = len({r.sequence_id for r in got}), m.lower_bound(np.array([r.length for r in got]))
    assert bound <= used <= 1.06 * bound + 2


def test_exchange_saves_sequences(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([1100, 700, 650, 948, 1398, 500, 2048]), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = m.packed(df, part_pieces=20, rounds=0).select("sequence_id").distinct().count()
    after = m.packed(df, part_pieces=20, released=0.5)
    assert after.select("sequence_id").distinct().count() < alone
    check([(r.sequence_id, r.offset, r.length) for r in after.collect()], 2048)
    assert after.count() == 600


def test_empty(spark):
    assert m.packed(m.pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_very_long_white_space(spark):
    docs = [(1, " " * 1_000_000 + "a"), (2, "\n" * 1_200_000 + "b"), (3, "short")]
    got = m.pieces(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for d, t in docs:
        ids = np.array(ids_of(t), "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d)
        assert sum(n for _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in mine)


def test_certificates_hold(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 9 == 0 else i // 2, 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1, 2048, 900))] + [(None, 0, 0, 900, 7)] * 300
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = m.packed(cut, part_pieces=60).toPandas()
    assert len(got) == len(rows) and got.groupby("sequence_id")["length"].sum().max() <= 2048
    sets = got.groupby(["round", "part"])
    for _, own in sets:  # each certificate is that of the packing returned
        assert set(own["bins_used"]) == {own["sequence_id"].nunique()}
        assert set(own["bins_bound"]) == {m.lower_bound(own["length"].to_numpy())}
    assert sets["bins_used"].first().sum() == got["sequence_id"].nunique() and got["round"].max() > 0
    bound = m.lower_bound(got["length"].to_numpy())
    apart = m.packed(cut, part_pieces=60, rounds=0).toPandas()["sequence_id"].nunique()
    assert bound <= got["sequence_id"].nunique() <= apart  # partitions of 60 pieces leave gaps that exchange closes in part
