import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiloom.functions.text import InputError
from epiloom.operators import background, evaluate, ingest, knn, pairs, profile, ranking, scoring
from epiloom.operators.edit_join import edit_candidates, edit_join, edit_pairs
from epiloom.operators.screen import OUTPUT, Screening, screen, unmatched
from epiloom.sources.tables import numbered

AA = "ACDEFGHIKLMNPQRSTVWY"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_edit_join_equals_brute_force(spark, k):
    rng = random.Random(k)
    base = ["C" + "".join(rng.choices(AA[:6], k=rng.randint(0, 18))) + "F" for _ in range(60)]
    near = []
    for x in base:
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(y) + 1)
            y[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(AA[:6])]])
        near.append("".join(y))
    left, right = spark.createDataFrame([(x,) for x in [*base, None, ""]], "seq string"), spark.createDataFrame([(x,) for x in [*near, None, ""]], "seq string")
    got = {(r.a, r.b): r.distance for r in edit_pairs(left, right, k).collect()}
    want = {(a, b): d for a in {*base, ""} for b in {*near, ""} if (d := levenshtein(a, b)) <= k}
    assert got == want


def alike(rng, n):
    """Junctions that begin and end alike, in families of near ones."""
    out = []
    while len(out) < n:
        middle = rng.choices(AA, k=rng.randint(5, 11))
        for _ in range(3):
            x = list(middle)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(x) + 1)
                x[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(AA)]])
            out.append(f"CASS{''.join(x)}EQYF")
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_join_of_junctions_that_begin_and_end_alike(spark, k):
    rng = random.Random(10 + k)
    words = alike(rng, 360)
    rng.shuffle(words)
    # halves that are empty, one letter, or longer than the other sequence
    words += ["", "C", "CF", "CAF", "CASS", "CASSEQYF", "CCCC", "FFFF", "CFCFCF", "FCFCFC", "CASSS", "CASSSS"]
    left, right = words[::2], [*words[1::2], "", "CF", "CASS", "CFCFCF"]
    df = lambda x: spark.createDataFrame([(w,) for w in x], "seq string")
    got = {(r.a, r.b): r.distance for r in edit_pairs(df(left), df(right), k).collect()}
    assert got == {(a, b): d for a in set(left) for b in set(right) if (d := levenshtein(a, b)) <= k}


def test_edit_candidates_are_a_small_share_of_all_pairs(spark):
    words = alike(random.Random(3), 6000)
    df = lambda x, c: spark.createDataFrame([(w,) for w in sorted(set(x))], f"{c} string")
    a, b = df(words[::2], "a"), df(words[1::2], "b")
    got = [edit_candidates(a, b, k).count() / 9_000_000 for k in (1, 2, 3)]
    assert got[0] < 0.001 and got[1] < 0.01 and got[2] < 0.05, got


def test_edit_candidates_of_short_sequences_are_few(spark):
    # seven letters of sixteen between equal ends: few pairs are within two edits, many share a half
    rng = random.Random(8)
    words = sorted({f"CASS{''.join(rng.choices(AA[:16], k=7))}EQYF" for _ in range(6000)})
    df = lambda x, c: spark.createDataFrame([(w,) for w in x], f"{c} string")
    assert edit_candidates(df(words[::2], "a"), df(words[1::2], "b"), 2).count() < 4000


def test_edit_join_keeps_rows_and_checks_k(spark):
    a = spark.createDataFrame([(1, "CASSF"), (2, "CASSF")], "id int, s string")
    b = spark.createDataFrame([(9, "CATSF"), (8, "CATSF")], "rid int, r string")
    assert edit_join(a, b, "s", "r", 1).count() == 4
    for bad in (True, -1, 4, 1.0):
        with pytest.raises(ValueError):
            edit_pairs(a, b, bad, "s", "r")


RECEPTOR = "receptor_id string, donor_id string, cdr3a string, cdr3b string, trav string, traj string, trbv string, trbj string, pairing_status string, unusable_chain_context string"
REFERENCE = "reference_id string, cdr3a string, cdr3b string, trav string, traj string, trbv string, trbj string, peptide string, hla string, source string, evidence string"


def receptor(rid="r1", donor="d1", a="CALWDKNSGYTIEF", b="CASRHDPWQNVELFF", v="TRBV5-1", status="paired"):
    return (rid, donor, a, b, "TRAV8-3", "TRAJ10", v, "TRBJ2-7", status, "")


def reference(rid="ref1", a="CALWDKNSGYTIEF", b="CASRHDPWQNVELFF", peptide="GILGFVFTL", mhc="A*02:01", v="TRBV5-1", evidence="functional"):
    return (rid, a, b, "TRAV8-3", "TRAJ10", v, "TRBJ2-7", peptide, mhc, "src", evidence)


def screened(spark, receptors, references, panel=(("GILGFVFTL", "A*02:01"),), donors=(("d1", "A*02:01"),), k=1):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return screen(make(receptors, RECEPTOR), make(references, REFERENCE), make(panel, "peptide string, hla string"), make(donors, "donor_id string, hla string"), k).orderBy("receptor_id", "evidence_rank").collect()


def test_exact_and_similar_evidence(spark):
    rows = screened(
        spark,
        [receptor(), receptor("r2", b="CASRHDPWQNVELFW"), receptor("r3", a="CALWDKNSGYTIDF", b="CASRHDPWQNVELFW"), receptor("r4", a=None), receptor("r5", a=None, b=None, status="no_productive_chains"), receptor("r6", v="TRBV7-2"), receptor("r7", donor="d9")],
        [reference(), reference("far", a="CAAAAAAAAAAF"), reference("other", peptide="NLVPMVATV")],
    )
    told = {}
    for r in rows:
        told.setdefault(r.receptor_id, []).append((r.status, r.evidence_type, r.distance, r.reference_id))
    assert told["r1"] == [("Candidate", "exact_paired", 0, "ref1")]
    assert told["r2"] == [("Candidate", "similar_paired", 1, "ref1")]
    assert told["r3"] == [("Unresolved", "none", None, None)]  # one edit in each chain: two in all
    assert told["r4"] == [("Candidate", "exact_single_chain", 0, "far"), ("Candidate", "exact_single_chain", 0, "ref1")]
    assert told["r5"][0][1] == "none"
    assert told["r6"] == [("Unresolved", "exact_paired", 0, "ref1")]  # genes conflict: kept, no candidate
    assert told["r7"] == [("Unresolved", "exact_paired", 0, "ref1")]  # no typing
    assert [c for c in rows[0].asDict()] == [c for c, _ in OUTPUT]


def test_evidence_from_lists_equals_evidence_from_rows(spark, monkeypatch):
    from epiloom.operators import screen as module

    rng = random.Random(4)
    chains = [None, *["CA" + "".join(rng.choices("AC", k=n)) + "F" for n in (3, 3, 4, 4, 5)], "CX*F"]
    genes = lambda g: [None, *[f"{g}{n}-1{allele}" for n in (5, 6) for allele in ("", "*01", "*02")]]
    pick = lambda g: rng.choice(genes(g))
    calls = lambda: (pick("TRAV"), "TRAJ10", pick("TRBV"), rng.choice([None, "TRBJ2-7"]))
    receptors = [(f"r{i}", rng.choice(["d1", "d2", "d9", None]), rng.choice(chains), rng.choice(chains), *calls(), "paired", rng.choice([None, "", "x"])) for i in range(60)]
    receptors += receptors[:2]  # ids of several rows are ranked together
    molecules = [None, "A*02:01", "A*02:01N", "A*03:01", "B*07:02"]
    references = [(f"f{i:03}", rng.choice(chains), rng.choice(chains), *calls(), rng.choice("PQR"), rng.choice(molecules), "s", rng.choice(["functional", "Multimer", "curated", None])) for i in range(150)]
    panel = [(p, m) for p in "PQ" for m in molecules if rng.random() < 0.8]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    given = [make(receptors, RECEPTOR), make(references, REFERENCE), make(panel, "peptide string, hla string"), make([("d1", "A*02:01"), ("d1", "B*07:02"), ("d2", "A*03:01")], "donor_id string, hla string")]
    held = Screening(*given, 1)
    want = held.evidence()
    order = lambda df: sorted(map(repr, df.collect()))
    wanted = order(want)
    assert len(wanted) > 1000
    monkeypatch.setattr(module, "LISTED_FROM", 0)
    longest = held.facts.selectExpr("max(n_a + n_b + n_ab)").first()[0]
    # long lists by rows; hot junctions in pieces; everything by lists, but the two ids
    for longest_list, rows_a_task in ((longest // 2, 50), (longest, 2_000_000)):
        monkeypatch.setattr(module, "LIST", longest_list)
        monkeypatch.setattr(module, "ROWS_A_TASK", rows_a_task)
        assert order(held.evidence()) == wanted
    # no row of evidence is shuffled or sorted by receptor
    once = Screening(given[0].dropDuplicates(["receptor_id"]), *given[1:], 1).evidence()
    assert "Window" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_drops_are_counted_and_every_receptor_stays(spark):
    rows = screened(spark, [receptor(), receptor("r2")], [reference(mhc="A*02:01"), reference("null", mhc="A*02:01N")], panel=[("GILGFVFTL", "B*07:02"), ("GILGFVFTL", "C*07:01")])
    assert [(r.receptor_id, r.evidence_type) for r in rows] == [("r1", "none"), ("r2", "none")]
    assert all("3 comparisons" in r.reason for r in rows)  # two panel molecules, one donor refusal
    assert screened(spark, [], [reference()]) == []


def test_receptors_without_evidence_are_told_without_their_pairs(spark):
    # 30,000 x 30,000 rows of one alpha chain: 900 million comparisons, all ruled out
    r = spark.range(30_000).selectExpr("concat('r', id) AS receptor_id", "'d1' AS donor_id", "'CALWDKNSGYTIEF' AS cdr3a", "cast(null AS string) AS cdr3b", "'single_alpha' AS pairing_status", "'' AS unusable_chain_context")
    f = spark.range(30_000).selectExpr("concat('f', id) AS reference_id", "'CALWDKNSGYTIEF' AS cdr3a", "'GILGFVFTL' AS peptide", "'A*02:01' AS hla", "'src' AS source", "'functional' AS evidence")
    panel, donors = spark.createDataFrame([("GILGFVFTL", "B*07:02"), ("GILGFVFTL", "C*07:01")], "peptide string, hla string"), spark.createDataFrame([("d1", "A*02:01")], "donor_id string, hla string")
    told = unmatched(r, f, panel, donors).groupBy("reason", "evidence_rank").count().collect()
    assert [(x["count"], x.evidence_rank) for x in told] == [(30_000, 1)] and "; 60000 comparisons" in told[0].reason


def test_pairs_are_made_only_where_the_shared_chains_are_near(spark):
    # one alpha chain for all, beta chains that differ: 4 million pairs share a chain, 2,001 are evidence
    beta = "concat('CAS', substr(translate(md5(cast({} AS string)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, 12), 'F')"
    both = lambda n: spark.range(2000).selectExpr(f"concat('{n}', id) AS id", "'CALWDKNSGYTIEF' AS cdr3a", f"{beta.format('id')} AS cdr3b")
    r = both("r").withColumnRenamed("id", "receptor_id").selectExpr("*", "'d1' AS donor_id", "'paired' AS pairing_status", "'' AS unusable_chain_context")
    r = r.unionByName(r.limit(1).selectExpr("'one' AS receptor_id", "cdr3a", "concat(substr(cdr3b, 1, 15), 'W') AS cdr3b", "donor_id", "pairing_status", "unusable_chain_context"))
    f = both("f").withColumnRenamed("id", "reference_id").selectExpr("*", "'GILGFVFTL' AS peptide", "'A*02:01' AS hla", "'src' AS source", "'functional' AS evidence")
    panel, donors = spark.createDataFrame([("GILGFVFTL", "A*02:01")], "peptide string, hla string"), spark.createDataFrame([("d1", "A*02:01")], "donor_id string, hla string")
    held = Screening(r, f, panel, donors, 1)
    assert held._joined(*held._sides(held.base, held.refs, "ab"), "ab").count() == 2001
    assert sorted(map(tuple, held.evidence().groupBy("evidence_type", "distance").count().collect())) == [("exact_paired", 0, 2000), ("similar_paired", 1, 1)]


def contigs(rows):
    return [(*r, None) if len(r) == 6 else r for r in rows]


CONTIG = "barcode string, donor_id string, contig_id string, chain string, cdr3 string, productive string, is_cell string"


def status_of(spark, rows, limit=16):
    df = numbered(spark.createDataFrame(contigs(rows), CONTIG).coalesce(1))
    chains = ingest.with_cell_key(ingest.long_chains(df, "10x"))
    return {r.cell_id: r.pairing_status for r in ingest.candidate_pairs(chains, limit).collect()}


def test_pairing_states(spark):
    rows = [
        ("c1", "d", "1", "TRA", "CAVF", "true"), ("c1", "d", "2", "TRB", "CASF", "T"), ("c2", "d", "3", "TRA", "CAVF", ""), ("c3", "d", "4", "TRB", "CASF", None),
        ("c4", "d", "5", "TRA", "CAVF", "1"), ("c4", "d", "6", "TRA", "CAAF", "1"), ("c4", "d", "7", "TRB", "CASF", "1"), ("c5", "d", "8", "TRB", "CASF", "1"), ("c5", "d", "9", "TRB", "CATF", "1"),
        ("c6", "d", "10", "TRA", "CAVF", "1"), ("c6", "d", "11", "TRA", "CAAF", "1"), ("c6", "d", "12", "TRB", "CASF", "1"), ("c6", "d", "13", "TRB", "CATF", "1"), ("c7", "d", "14", "IGH", "CASF", "1"),
        ("c8", "d", "15", "TRA", "CAXF", "1"), ("c9", "d", "16", "TRA", "CAVF", "1", "false"), ("c10", "d", "17", "TRA", "CAVF", "false"),
    ]
    got = status_of(spark, rows)
    want = dict(c1="paired", c2="single_alpha", c3="single_beta", c4="dual_alpha", c5="dual_beta", c6="ambiguous_pairing", c7="no_productive_chains", c8="unresolved_sequence", c9="excluded_quality", c10="no_productive_chains")
    assert got == want
    assert status_of(spark, rows, 3)["c6"] == "excess_chains"


def test_layouts_agree_and_nothing_is_lost(spark):
    tenx = [("c1", "d", "1", "TRA", "CAVF", "true"), ("c1", "d", "2", "TRB", "CASF", "true"), ("c2", "d", "3", "TRA", "CAVF", "true"), ("c2", "d", "4", "TRB", "CASF", "true"), ("c3", "d", "5", "TRA", "CAAF", "true")]
    a = ingest.ingest(numbered(spark.createDataFrame(contigs(tenx), CONTIG).coalesce(1)))
    airr = spark.createDataFrame([(c, d, i, l, s, p) for c, d, i, l, s, p in tenx], "cell_id string, donor_id string, sequence_id string, locus string, junction_aa string, productive string")
    b = ingest.ingest(numbered(airr.coalesce(1)))
    paired = spark.createDataFrame([("c1", "d", "CAVF", "CASF"), ("c2", "d", "CAVF", "CASF"), ("c3", "d", "CAAF", "")], "cell_id string, donor_id string, cdr3a string, cdr3b string")
    c = ingest.ingest(numbered(paired.coalesce(1)))
    assert (a.layout, b.layout, c.layout) == ("10x", "airr", "paired")
    key = lambda x: sorted(map(tuple, x.receptors.select("receptor_id", "pairing_status", "cell_count", "observation_count").collect()))
    assert key(a) == key(b) == key(c) and len(key(a)) == 2
    assert [sorted(r.cell_id for r in x.cells.collect()) for x in (a, b, c)] == [["c1", "c2", "c3"]] * 3
    assert c.chains.count() == 5 and {r.code: r["count"] for r in c.qc.collect()}["input_records"] == 3


def test_unknown_cells_never_become_a_clone(spark):
    paired = spark.createDataFrame([("c1", "d", None, None), ("c2", "d", "", ""), ("c3", "d", "CAVF", "CASF"), ("c3", "d", "CAVF", "CATF")], "cell_id string, donor_id string, cdr3a string, cdr3b string")
    got = ingest.ingest(numbered(paired.coalesce(1)))
    states = sorted((r.pairing_status, r.cell_count) for r in got.receptors.collect())
    assert states == [("ambiguous_input_pairs", 1), ("ambiguous_input_pairs", 1), ("unresolved_sequence", 1), ("unresolved_sequence", 1)]


def test_input_errors(spark):
    df = lambda rows: numbered(spark.createDataFrame(contigs(rows), CONTIG).coalesce(1))
    for rows in ([("c", "d", "1", "TRA", "CA1F", "true")], [(None, "d", "1", "TRA", "CAF", "true")], [("c", "d", "1", None, "CAF", "true")], [("c", "d", "1", "TRA", "CAF", "perhaps")], [("c", "d", "1", "TRA", "CAF", "t"), ("e", "d", "1", "TRA", "CAF", "t")], [("c", None, "1", "TRA", "CAF", "t")]):
        with pytest.raises(InputError):
            ingest.ingest(df(rows))
    with pytest.raises(InputError):
        ingest.ingest(df([("c", "d", "1", "TRA", "CAF", "t")]), donor_id="other")


def test_metrics(spark):
    cases = [([4, 3, 2, 1], 1.0, 1.0), ([1, 2, 3, 4], 0.0, 5 / 12), ([1, 1, 1, 1], 0.5, 0.5), ([2, 1, 2, 1], 0.5, 0.5)]
    for s, auc, ap in cases:
        scores = spark.createDataFrame([(str(i), "x", float(v)) for i, v in enumerate(s)], "k string, c string, score double")
        labels = spark.createDataFrame([(str(i), "x", v) for i, v in enumerate([1, 1, 0, 0])], "k string, c string, label int")
        r = evaluate.evaluate(scores, labels, ["k", "c"], ["c"]).first()
        assert (r.auroc, r.average_precision, r.status) == (pytest.approx(auc), pytest.approx(ap), "Evaluated")
    scores = spark.createDataFrame([("a", "x", 1.0), ("b", "x", None), ("c", "x", float("nan")), ("d", "x", 2.0)], "k string, c string, score double")
    labels = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("c", "x", 0), ("d", "x", 1), ("d", "x", 0)], "k string, c string, label int")
    r = evaluate.evaluate(scores, labels, ["k", "c"], ["c"]).first()
    assert (r.n_conflicting, r.n_scored, r.coverage, r.auroc, r.status) == (1, 1, pytest.approx(1 / 3), None, "Unresolved")


def test_percentiles_and_ranks(spark):
    tested = spark.createDataFrame([(i, "x", v) for i, v in enumerate([5.0, 2.0, 2.0, 0.5, None])], "i int, c string, score double")
    bg = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0)], "c string, score double")
    got = {r.i: (r.background_n, r.background_percentile) for r in ranking.background_percentile(tested, bg, ["c"]).collect()}
    assert got == {0: (3, 25.0), 1: (3, 75.0), 2: (3, 75.0), 3: (3, 100.0), 4: (3, None)}
    ranks = {r.i: r["rank"] for r in ranking.rank_in_context(tested.union(spark.createDataFrame([(9, "x", float("nan"))], tested.schema)), ["c"]).collect()}
    assert ranks == {0: 1, 1: 2, 2: 2, 3: 4, 4: None, 9: None}
    one = ranking.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v").collect()
    assert [(r.bin, r.n, r.share) for r in one] == [(12, 2, 1.0)]


def test_profiles(spark):
    panel = spark.createDataFrame([("GILGFVFTL", None), ("GILGFVFTL", None), ("GILGFVFTLA", None)], "peptide string, hla string")
    rows = profile.empirical_profile(panel).collect()
    assert len(rows) == (9 + 10) * 20
    g = next(r for r in rows if (r.length, r.position, r.amino_acid) == (9, 1, "G"))
    assert g.frequency == pytest.approx(1.5 / 11) and g.n_peptides == 1
    wide = spark.createDataFrame([(1, *([0.05] * 20)), (2, *([1.0] + [0.0] * 19))], "position int, " + ", ".join(f"{a} double" for a in AA))
    long = profile.unpivoted(wide)
    info = {r.position: (round(r.bits, 6), r.consensus) for r in profile.information_content(long).collect()}
    assert info == {1: (0.0, "X"), 2: (round(float(np.log2(20)), 6), "A")}
    assert profile.bad_rows(wide).count() == 0 and profile.pssm(long).filter("floor_applied").count() == 19


def test_neighbours_equal_dense_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)).round(1)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "ref_id long, vector array<double>").repartition(5)
    q = df.filter("ref_id % 10 = 0").withColumnRenamed("ref_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = knn.cosine_top_k(q, df, 7, block=5).collect()
    for i in range(0, 120, 10):
        sim = np.clip(u @ u[i], -1, 1)
        want = np.lexsort((np.arange(120), -sim))[:7]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert np.allclose([r.similarity for r in mine], sim[want]) and len(mine) == 7


def test_pairs_scores_and_lookup(spark):
    r = spark.createDataFrame([receptor(), receptor("r2", a=None, status="single_beta"), receptor("r3", donor="none")], RECEPTOR)
    panel = spark.createDataFrame([("gilgfvftl", "a*02:01"), ("GILGFVFTL", "HLA-A*02:01"), ("NLVPMVATV", None)], "peptide string, hla string")
    out = pairs.export_pairs(r, panel, spark.createDataFrame([("d1", "A*02:01")], "donor_id string, hla string"))
    rows = out.collect()
    assert len(rows) == 6 and [(x.receptor_id, x.peptide) for x in rows if x.skip_reason is None] == [("r1", "GILGFVFTL")]
    with pytest.raises(InputError):
        pairs.export_pairs(r, panel, max_pairs=5)
    ready = out.filter("skip_reason IS NULL").drop("skip_reason")
    pid = ready.first().pair_id
    told = lambda *x: spark.createDataFrame([x], "pair_id string, score string, reason string")
    good = pairs.import_scores(ready, told(pid, "-1.5", None)).first()
    assert (good.status, good.score) == ("ModelHypothesis", -1.5)
    for bad in (told(pid, "-1.5", "too long"), told(pid, "NaN", None), told(pid, None, None)):
        x = pairs.import_scores(ready, bad).first()
        assert (x.status, x.score) == ("Unresolved", None) and x.reason
    for wrong in (told("pair_x", "1", None), told(pid, "one", None)):
        with pytest.raises(InputError):
            pairs.import_scores(ready, wrong)
    lib = spark.createDataFrame([("P", "A", "13.2"), ("Q", "A", None)], "peptide string, hla string, score string")
    found = {x.peptide: (x.status, x.score) for x in pairs.library_lookup(spark.createDataFrame([("P", "A"), ("Q", "A"), ("R", "A")], "peptide string, hla string"), lib).collect()}
    assert found == {"P": ("PrecomputedScore", 13.2), "Q": ("Unresolved", None), "R": ("Unresolved", None)}


def test_export_without_a_bound_makes_every_pair(spark):
    r = spark.range(1_000_001).selectExpr("concat('r', id) AS receptor_id", "'d1' AS donor_id", *[f"cast(null AS string) AS {c}" for c in pairs.COMPONENTS], "'paired' AS pairing_status")
    panel = spark.createDataFrame([("GILGFVFTL", "A*02:01"), ("NLVPMVATV", None)], "peptide string, hla string")
    out = pairs.export_pairs(r, panel, max_pairs=None)
    assert out.count() == 2_000_002 and out.filter("skip_reason IS NULL").count() == 0
    with pytest.raises(InputError):
        pairs.export_pairs(r, panel)


def test_cross_pairs_has_no_bound(spark, tmp_path):
    from epiloom.plans import catalog

    spark.range(400_001).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "cast(id % 5 AS int) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    assert catalog.QUERIES["cross_pairs"](spark, str(tmp_path)).count() == 25 * 400_001


def test_export_holds_back_what_no_model_takes(spark):
    r = spark.createDataFrame([receptor(), receptor("r2", v="TRBV5-1/TRBV5-4"), ("r3", "d1", "CALWDKNSGYTIEF", "CASRHDPWQNVELFF", "TRAV15D-1/DV6D-1", "TRAJ10", "TRBV5-1", "TRBJ2-7", "paired", ""), ("r4", "d1", "CALWDKNSGYTIEF", "CASRHDPWQNVELFF", "TRAV1/TRAV2", "TRAJ10", "TRBV5-1/DV4", "TRBJ2-7", "paired", "")], RECEPTOR)
    names = ["A*02:01", "HLA-A*02:01N", "HLA-A*02", "HLA-A*02:01:01G", "HLA-A*02:01|HLA-A*02:02", "HLA-DQA1*05:01", "HLA-DQA1*05:01/HLA-DQB1*02:01", "H-2-Kb", "HLA-DRB1*15:01", None]
    panel = spark.createDataFrame([("GILGFVFTL", n) for n in names], "peptide string, hla string")
    rows = pairs.export_pairs(r, panel).collect()
    assert {x.hla for x in rows if x.receptor_id == "r1" and x.skip_reason is None} == {"HLA-A*02:01", "HLA-DQA1*05:01/HLA-DQB1*02:01"}
    assert {x.receptor_id for x in rows if x.skip_reason is None} == {"r1", "r3"} and len(rows) == 4 * len(names)
    mouse = pairs.export_pairs(r, panel.filter("hla IN ('H-2-Kb', 'A*02:01')"), species="mouse").filter("skip_reason IS NULL").collect()
    assert {(x.receptor_id, x.hla) for x in mouse} == {("r1", "H-2-Kb"), ("r3", "H-2-Kb")}


@pytest.mark.parametrize("block, salts", [(5, 3), (1000, 1), (1, 8)])
def test_neighbours_do_not_depend_on_blocks(spark, block, salts):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 6)).round(1)
    v[10:20] = v[0]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "ref_id long, vector array<double>")
    q = df.selectExpr("concat('q', ref_id) AS query_id", "vector")
    got = {(r.query_id, r["rank"]): r.ref_id for r in knn.cosine_top_k(q, df, 4, block=block, salts=salts).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(90):
        order = sorted(range(90), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:4]
        assert [round(float(u[i] @ u[got[f"q{i}", k + 1]]), 9) for k in range(4)] == [round(float(u[i] @ u[j]), 9) for j in order]
    assert [got["q0", k] for k in (1, 2, 3, 4)] == [0, 10, 11, 12] and knn.cosine_top_k(q.limit(0), df, 4).count() == 0


def test_backgrounds_are_reproducible(spark):
    c = spark.createDataFrame([("HLA-A*02:01", 9), ("HLA-B*07:02", 10)], "hla string, peptide_length int")
    key = lambda df: sorted((r.hla, r.peptide, r.background_id) for r in df.collect())
    assert key(background.random_panel(c, 50, 3)) == key(background.random_panel(c.orderBy(F.desc("hla")).repartition(3), 50, 3)) != key(background.random_panel(c, 50, 4))
    letters = "".join(r.peptide for r in background.random_panel(c, 3000, 1).collect())
    assert all(abs(letters.count(a) / len(letters) - 0.05) < 0.01 for a in AA)
    profiles = scoring.profiles(c.limit(1), scoring.StubScorer(), ["hla"])
    drawn = background.profile_panel(c, profiles, 20, 1).collect()
    assert sum(r.peptide is None for r in drawn) == 1 and len(drawn) == 21
    with pytest.raises(InputError):
        background.random_panel(c, 60_000)


def test_scores_of_distinct_contexts(spark):
    s = scoring.StubScorer()
    panel = spark.createDataFrame([("GILGFVFTL", "A*02:01"), ("GILGFVFTL", "A*02:01"), ("XX", "A*02:01"), ("GILGFVFTL", None), ("GILGFVFTL", "bad")], "peptide string, hla string")
    rows = scoring.score_pmhc(panel, s, 30).collect()
    assert len(rows) == 5 and sorted(r.status for r in rows) == ["Scored", "Scored", "Unresolved", "Unresolved", "Unresolved"]
    assert all(r.score == pytest.approx(scoring.pseudo_log_likelihood(s, "HLA-A*02:01", "GILGFVFTL")) for r in rows if r.status == "Scored")
    assert all((r.score is None) == (r.reason is not None) for r in rows)
