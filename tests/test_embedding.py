import hashlib

import pytest

from epiloom.functions.text import InputError
from epiloom.operators.embedding import OUTPUT, eligible_problem, embedding_evidence

R = 0.5**0.5
V = {"x": [R, 0.0, R, 0.0], "y": [R, 0.0, 0.0, R], "z": [0.0, R, 0.0, R], "-x": [-R, 0.0, -R, 0.0]}
REF = "reference_id string, identity string, vector array<double>, peptide string, hla string, source string, evidence string"


def frames(spark, refs, donors=(("d", "HLA-A*02:01"),), queries=(("q", "d", "x"),)):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        spark.createDataFrame([(r, d, V[v]) for r, d, v in queries], "receptor_id string, donor_id string, vector array<double>"),
        spark.createDataFrame([(i, sha(v), V[v], p, h, "s", "curated") for i, v, p, h in refs], REF),
        spark.createDataFrame([("PEPA", "HLA-A*02:01"), ("PEPB", None)], "peptide string, hla string"),
        spark.createDataFrame(list(donors), "donor_id string, hla string"),
    )


def test_a_receptor_takes_one_place_and_ruled_out_references_none(spark):
    refs = [
        ("a1", "x", "PEPA", "HLA-A*02:01"), ("a2", "x", "PEPB", None), ("a3", "x", "PEPA", "HLA-A*03:01"), ("b", "y", "PEPB", "HLA-B*07:02"),
        ("n", "z", "PEPB", "HLA-A*02:01N"), ("o", "z", "OTHER", "HLA-A*02:01"), ("c", "-x", "PEPA", None),
    ]
    got = embedding_evidence(*frames(spark, refs), k=2)
    assert got.columns == OUTPUT
    rows = {r.reference_id: r for r in got.collect()}
    assert set(rows) == {"a1", "a2", "b"}
    assert (rows["a1"].neighbor_rank, rows["a2"].neighbor_rank, rows["b"].neighbor_rank) == (1, 1, 2)
    assert rows["b"].cosine_similarity == pytest.approx(0.5)
    assert (rows["a1"].hla_status, rows["a2"].hla_status, rows["b"].hla_status) == ("compatible", "unresolved", "unresolved")
    assert {r.reference_id for r in embedding_evidence(*frames(spark, refs), k=9).collect()} == {"a1", "a2", "b", "c"}


def test_no_typing_leaves_molecules_open_and_empty_tables_give_none(spark):
    refs = [("a", "x", "PEPA", "HLA-A*02:01")]
    (row,) = embedding_evidence(*frames(spark, refs, donors=[("other", "HLA-A*02:01")], queries=[("q", None, "x")])).collect()
    assert (row.donor_hla_status, row.panel_hla_status, row.hla_status) == ("unresolved", "compatible", "unresolved")
    q, r, p, d = frames(spark, refs)
    assert embedding_evidence(q, r.limit(0), p, d).count() == embedding_evidence(q.limit(0), r, p, d).count() == 0


def test_unsound_vectors_are_refused(spark):
    q, r, p, d = frames(spark, [("a", "x", "PEPA", "HLA-A*02:01")])
    lone = spark.createDataFrame([("q", "d", [1.0, 0.0, 0.0, 0.0])], q.schema)
    for bad in (lone, q.union(q)):
        with pytest.raises(InputError):
            embedding_evidence(bad, r, p, d)


def test_only_unambiguous_pairs_of_the_species_are_eligible(spark):
    rows = [("human", "paired", ""), ("human", "paired", None), ("mouse", "paired", ""), (None, "paired", ""), ("human", "single_beta", ""), ("human", None, ""), ("human", "paired", "a second alpha")]
    df = spark.createDataFrame(rows, "species string, pairing_status string, unusable_chain_context string").coalesce(1)
    assert [r.p is None for r in df.select(eligible_problem().alias("p")).collect()] == [True, True, False, False, False, False, False]
