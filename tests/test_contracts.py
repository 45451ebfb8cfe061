import os

import pytest
from pyspark.sql import functions as F

from epiloom.functions import genes
from epiloom.functions.text import InputError
from epiloom.operators import bridge, contracts, evaluate, score_store, scoring, sink

SCORES = "name string, peptide string, hla string, ok string, score string"
SOUND = [("a", "PEP", "H1", "True", "-1.5"), ("b", "PEP", "H1", "0", None), ("c", "PEQ", "H2", "1", "0.00000001"), ("d", "PEQ", "H2", "false", "NaN")]


def scores(spark, *rows):
    return spark.createDataFrame(list(rows), SCORES)


def test_a_sound_table_is_written_in_one_pass(spark, tmp_path):
    df = scores(spark, *SOUND)
    calls = spark.sparkContext.accumulator(0)

    def seen(frames):
        for pdf in frames:
            calls.add(len(pdf))
            yield pdf

    got = contracts.checked(df.mapInPandas(seen, SCORES), contracts.score_contract(), df.orderBy(F.desc("name")), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(SOUND) and calls.value == 4


@pytest.mark.parametrize(
    "rows, message",
    [
        ([("x", "PEP", None, "1", "-1")], "hla is missing"),
        ([("x", "PEP", "H", "maybe", "-1")], "flag"),
        ([("x", "PEP", "H", None, None)], "flag"),
        ([("x", "PEP", "H", "1", "low")], "isn't a number"),
        ([("x", "PEP", "H", "1", None)], "success without"),
        ([("x", "PEP", "H", "1", "0.1")], "success without"),
        ([("x", "PEP", "H", "1", "-Infinity")], "success without"),
        ([("x", "PEP", "H", "false", "-2")], "failure with"),
        ([*SOUND, SOUND[0]], "repeated"),
        (SOUND[1:], "missing"),
        ([*SOUND[1:], SOUND[1]], "a row is missing .1 rows.; a row is repeated"),
        ([*SOUND[1:], ("a", "PEP", "H2", "1", "-1")], "a row is missing .1 rows.; a row wasn't asked for"),
    ],
)
def test_a_broken_table_is_refused_and_leaves_nothing(spark, tmp_path, rows, message):
    with pytest.raises(InputError, match=message):
        contracts.checked(scores(spark, *rows), contracts.score_contract(), scores(spark, *SOUND), f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_types_are_checked_before_anything_runs(spark, tmp_path):
    contract = contracts.Contract(["name"], types={"score": "double", "gone": "int"})
    with pytest.raises(InputError, match="score is string, not double; gone is missing, not int"):
        contracts.checked(scores(spark, *SOUND), contract, path=f"{tmp_path}/out")
    assert contracts.audit(scores(spark, *SOUND).limit(0), contracts.score_contract(), scores(spark)).agg(F.sum("n")).first()[0] == 0


def panel(spark, *rows):
    return spark.createDataFrame(list(rows), "peptide string, hla string")


def test_store_scores_what_is_new_and_refuses_changed_models(spark, tmp_path):
    store, stub = score_store.ScoreStore(spark, f"{tmp_path}/scores"), scoring.StubScorer()
    some = panel(spark, ("GILGFVFTL", "H1"), ("GILGFVFTL", "H1"), ("XX", "H1"), ("GILGFVFTL", None))
    got, told = store.score(some, stub, ["hla"], "m")
    assert (told["asked"], told["scored"]) == (3, 3) and sorted(r.ok for r in got.collect()) == [False, True, True, True]
    more = some.union(panel(spark, ("ELAGIGILTV", "H2"), (None, "H1")))
    again, told = store.score(more, stub, ["hla"], "m")
    assert (told["asked"], told["scored"]) == (5, 2) and again.count() == 6
    # what failed is known as well, and so is a missing peptide
    assert store.score(more, stub, ["hla"], "m")[1]["scored"] == 0
    plain = {(r.peptide, r.hla): r.score for r in scoring.scored(more, stub, ["hla"]).collect()}
    assert {(r.peptide, r.hla): r.score for r in again.collect()} == plain
    with pytest.raises(InputError, match="fingerprint"):
        store.score(some, scoring.StubScorer(1), ["hla"], "m")
    with pytest.raises(InputError, match="fingerprint"):
        store.score(some, stub, ["hla"], "m", species="mouse")
    new, told = store.score(some, scoring.StubScorer(1), ["hla"], "m", renew=True)
    assert told["scored"] == 3 and new.first().score != got.first().score
    assert store.score(some, stub, ["hla"], "other")[1]["scored"] == 3
    assert len(store.fingerprints("m")) == 2


def test_store_with_two_scores_of_a_pair_is_refused(spark, tmp_path):
    store, stub = score_store.ScoreStore(spark, f"{tmp_path}/scores"), scoring.StubScorer()
    mark = score_store.fingerprint(stub, ["hla"])
    rows = spark.createDataFrame([("H1", "PEP", -1.0, "m", mark), ("H1", "PEP", -1.0, "m", mark), ("H2", "PEP", -1.0, "m", mark), ("H2", "PEP", -2.0, "m", mark)], score_store.SCHEMA)
    rows.write.partitionBy("model", "fingerprint").parquet(store.path)
    assert store.known("m", mark).filter("context = 'H1'").collect()[0].score == -1.0
    with pytest.raises(Exception, match="two scores of one pair"):
        store.known("m", mark).collect()
    score_store.require_same("a", "a")
    with pytest.raises(InputError):
        score_store.require_same("a", "b")


def test_joins_conserve_every_row(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (5, "v")] + [(9, "hot")] * 500, "k int, a string")
    right = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z"), (None, "N"), (None, "M")] + [(9, "HOT")] * 300, "k int, b string")
    got = {r.k: r for r in bridge.conserved(left, right, ["k"]).collect()}
    assert {k: r.match for k, r in got.items()} == {1: "matched", 2: "multiple", 3: "right only", 5: "left only", 9: "multiple", None: "no identity"}
    assert sum(r.n_left for r in got.values()) == 505 and sum(r.n_right for r in got.values()) == 305
    assert got[1].left.a == "x" and got[1].right.b == "X" and got[2].left is None and got[2].right.b == "Y"
    with pytest.raises(InputError, match="multiple: 2 keys"):
        bridge.one_to_one(left, right, ["k"])
    one = bridge.one_to_one(left.filter("k = 1"), right.filter("k IN (1, 3)"), ["k"], right_only=True)
    assert [tuple(r) for r in one.collect()] == [(1, "x", "X")]


def test_provenance_is_one_value_or_told(spark):
    df = spark.createDataFrame([("m", "x", None), ("m", "y", None), ("m", "x", "p")], "model string, metric string, seed string")
    assert {r["column"]: (r.value, r.status) for r in bridge.provenance(df, ["model", "metric", "seed"]).collect()} == {"model": ("m", "one"), "metric": (None, "conflict"), "seed": (None, "missing")}
    assert bridge.one_provenance(df, ["model", "absent"]) == {"model": "m", "absent": None}
    with pytest.raises(InputError, match="metric, one seed"):
        bridge.one_provenance(df, ["model", "metric", "seed"])


OBS = "cell_id string, donor_id string, trav string, traj string, cdr3a string, trbv string, trbj string, cdr3b string, benchmark_label string"
CHAINS = ("TRAV12-2", "TRAJ30", "CAVNTGNQFYF", "TRBV19", "TRBJ2-1", "CASSIRSSYEQYF")


def test_dataset_of_labelled_cells(spark):
    rows = [("c1", "d1", *CHAINS, "flu"), (" c2", "d1", *CHAINS, "melan"), ("c3", "d1", None, None, None, *CHAINS[3:], None)]
    out = bridge.dataset(spark.createDataFrame(rows, OBS), panel(spark, ("GILGFVFTL", "A*02:01"), ("ELAGIGILTV", "A*02:01")))
    cells = {r.cell_id: r for r in out["cells"].collect()}
    assert set(cells) == {"c1", "c2", "c3"} and cells["c2"].input_cell_id == " c2" and cells["c1"].receptor_id == cells["c2"].receptor_id != cells["c3"].receptor_id
    assert "benchmark_label" not in out["cells"].columns and out["cell_labels"].count() == 3
    assert sorted((r.benchmark_label, r.n_cells, r.conflict) for r in out["clone_labels"].collect()) == [("flu", 1, True), ("melan", 1, True)]
    assert out["pairs"].count() == 2 and out["skipped"].count() == 2 and out["receptors"].count() == 2
    with pytest.raises(InputError):
        bridge.dataset(spark.createDataFrame([*rows, ("c2", "d1", *CHAINS, "x")], OBS), panel(spark, ("GILGFVFTL", "A*02:01")))


def test_batches_spread_a_hot_context_and_change_no_score(spark):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    rows = [("hot" if i % 10 else "cold", letters[i % 20] + letters[i // 20 % 20] + letters[i // 400] + "".join(letters[(i * 7 + j * j) % 20] for j in range(8 + i % 30)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "context string, peptide string, i int")
    cut = scoring.batched(df, ["context"], "peptide", budget=500)
    sums = cut.groupBy("context", "batch").agg(F.sum(F.length("peptide")).alias("n"))
    assert sums.agg(F.max("n")).first()[0] <= 500 and sums.filter("context = 'hot'").count() > 100
    assert {(r.i, r.batch) for r in cut.collect()} == {(r.i, r.batch) for r in scoring.batched(df.repartition(7).orderBy(F.desc("i")), ["context"], "peptide", budget=500).collect()}
    of = lambda budget: {r.i: r.score for r in scoring.scored(df, scoring.StubScorer(), ["context"], budget=budget).collect()}
    assert of(100) == of(100_000)
    with pytest.raises(InputError):
        scoring.batched(df, ["context"], "peptide", budget=60)


def test_gene_resolution(spark):
    full = ("TRAV1-2*01", "TRAJ33*01", "TRBV6-4*01", "TRBJ2-1*01")
    rows = [
        (1, *full, *full, "reported_match"),
        (2, "TRAV01-02*01", *full[1:], *full, "nomenclature_normalized"),
        (3, "TRAV1-2", *full[1:], *full, "alleles_unspecified"),
        (4, "TRAV1-2", *full[1:], *full[:3], " ", "unreported"),
        (5, "TRAV1-2*02", *full[1:], *full[:3], None, "inferred_gene_choice"),
        (6, "TRAV1", *full[1:], *full, "inferred_gene_choice"),
        (7, None, *full[1:], *full, "alleles_unspecified"),
    ]
    df = spark.createDataFrame(rows, "i int, trav string, traj string, trbv string, trbj string, recon_trav string, recon_traj string, recon_trbv string, recon_trbj string, want string")
    got = genes.gene_resolution(df).collect()
    assert all(r.gene_resolution_status == r.want for r in got)
    reasons = {r.i: r.gene_resolution_reason for r in got}
    assert reasons[1] is None and "TRAV01-02*01" in reasons[2] and "became" in reasons[5] and "not every gene" in reasons[5]
    assert {r.gene_resolution_status for r in genes.gene_resolution(df.drop("recon_trbj")).collect()} == {"unreported", "inferred_gene_choice"}


def test_evidence_sink_counts_in_its_pass(spark, tmp_path):
    rows = [("r1", "Candidate", "exact_paired", 1), ("r1", "Unresolved", "exact_paired", 2), ("r2", "Unresolved", "none", 1), ("r3", "Candidate", "similar_paired", 1), ("r3", "Candidate", "exact_paired", 2)]
    df = spark.createDataFrame(rows, "receptor_id string, status string, evidence_type string, evidence_rank long")
    preview, told = sink.write_evidence(df, f"{tmp_path}/e", preview=3)
    assert told == {"evidence_rows": 5, "candidate_rows": 3, "unresolved_rows": 2, "receptors": 3, "receptors_with_candidates": 2, "receptors_without_evidence": 1}
    assert [tuple(r)[:1] + tuple(r)[3:] for r in preview.collect()] == [("r1", 1), ("r1", 2), ("r2", 1)]
    assert {r.counter: r.n for r in sink.summary(df, sink.evidence_counters()).collect()} == told
    few = sink.first_contexts(spark.createDataFrame([(f"h{i % 30:02}", float(i) if i % 2 else None) for i in range(90)], "hla string, score double"), ["hla"])
    assert [r.hla for r in few.collect()] == [f"h{i:02}" for i in range(20)] and few.first()["rows"] == 3


def test_routes(spark):
    rows = spark.createDataFrame([("GILGFVFTL", "HLA-A*02:01", 0.5), ("GIL", "HLA-A*02:01", 0.5), ("GILGFVFTL", "HLA-A*02:01", None), ("GILGFVFTL", "HLA-B*07:02", 0.5), ("GILGFVFTL", "HLA-A*02", 0.5), ("GILGFVFTL", None, 0.5)], "peptide string, hla string, score double")
    models = spark.createDataFrame([("class_i", "HLA-A*02:01")], "predictor string, hla string")
    assert sorted(r.route for r in sink.routes(rows, models).collect()) == ["failed_score", "no_model", "predicted", "unrouted", "unrouted", "unsupported_length"]


def test_evaluation_keys_meet_whatever_their_spelling(spark):
    a = spark.createDataFrame([(" r1", "gilgfvftl ", "A*02:01")], "receptor_id string, peptide string, hla string")
    assert tuple(evaluate.normalized_keys(a).first()) == ("r1", "GILGFVFTL", "HLA-A*02:01")
    for bad in [(" ", "PEP", "A*02:01"), ("r", "PEXP", "A*02:01"), ("r", "PEP", "A0201"), ("r", "PEP", None)]:
        with pytest.raises(InputError):
            evaluate.normalized_keys(spark.createDataFrame([bad], a.schema))
    with pytest.raises(InputError, match="text"):
        evaluate.normalized_keys(a.withColumn("receptor_id", F.lit(1)))
