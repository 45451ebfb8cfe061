import pytest

from epiloom.__main__ import main


@pytest.fixture(scope="module")
def example(tmp_path_factory):
    out = tmp_path_factory.mktemp("cli") / "ex"
    assert main(["example", "--out", str(out)]) == 0
    return out


def test_screen_of_the_example(spark, example, tmp_path):
    out = tmp_path / "s"
    args = ["screen", "--input", f"{example}/receptors.csv", "--references", f"{example}/references.csv", "--panel", f"{example}/panel.csv", "--donors", f"{example}/donors.csv", "--out", str(out)]
    assert main(args) == 0
    rows = spark.read.parquet(f"{out}/evidence.parquet").collect()
    assert sorted((r.status, r.evidence_type) for r in rows) == [("Candidate", "exact_paired"), ("Candidate", "exact_single_chain"), ("Candidate", "similar_paired")]
    before = sorted(p.name for p in out.iterdir())
    assert main(args) == 2 and sorted(p.name for p in out.iterdir()) == before


@pytest.mark.parametrize("command,table", [("validate", "chains"), ("export", "pairs"), ("repertoire-score", "results")])
def test_receptor_commands(spark, example, tmp_path, command, table):
    args = [command, "--input", f"{example}/receptors.csv", "--out", str(tmp_path / "o")] + (["--panel", f"{example}/panel.csv"] if command != "validate" else [])
    assert main(args) == 0 and spark.read.parquet(f"{tmp_path}/o/{table}.parquet").count() > 0


@pytest.mark.parametrize("command", ["profile", "pmhc-score", "pmhc-profile", "background"])
def test_panel_commands(spark, example, tmp_path, command):
    assert main([command, "--panel", f"{example}/panel.csv", "--out", str(tmp_path / "o")]) == 0


def test_evaluate_and_lookup(spark, example, tmp_path):
    (tmp_path / "s.csv").write_text("receptor_id,peptide,hla,score\nr1,P,A*02:01,2\nr2, p,HLA-A*02:01,1\n")
    (tmp_path / "l.csv").write_text("receptor_id,peptide,hla,label\nr1,P,HLA-A*02:01,1\nr2,P,A*02:01,0\n")
    assert main(["evaluate", "--scores", f"{tmp_path}/s.csv", "--labels", f"{tmp_path}/l.csv", "--out", str(tmp_path / "e")]) == 0
    assert spark.read.parquet(f"{tmp_path}/e/evaluation.parquet").first().auroc == 1.0
    (tmp_path / "bad.csv").write_text("receptor_id,peptide,hla,label\nr1,P,A,1\n")
    assert main(["evaluate", "--scores", f"{tmp_path}/s.csv", "--labels", f"{tmp_path}/bad.csv", "--out", str(tmp_path / "x")]) == 2
    (tmp_path / "lib.csv").write_text("peptide,hla,score\nKLDVGNAEYV,HLA-B*35:01,3\n")
    assert main(["lookup", "--panel", f"{example}/panel.csv", "--library", f"{tmp_path}/lib.csv", "--out", str(tmp_path / "k")]) == 0
    assert main(["lookup", "--panel", f"{tmp_path}/none.csv", "--library", f"{tmp_path}/lib.csv", "--out", str(tmp_path / "n")]) == 2
