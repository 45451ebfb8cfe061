import json
import os

import pytest

from epiloom.functions.text import InputError
from epiloom.operators.ingest import ingest
from epiloom.sources import bundle, tables
from epiloom.streaming.chains import stream_chains, stream_exact_hits, windowed_counts


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_tables_are_read_as_text_and_numbered(spark, tmp_path):
    path = put(tmp_path, "r.csv", "﻿cell_id,donor_id,cdr3a,cdr3b\n001,d,CAVF,\n002,d,,CASF\n")
    df = tables.read_table(spark, path)
    assert [tuple(r) for r in df.orderBy("source_row").collect()] == [("001", "d", "CAVF", None, 2), ("002", "d", None, "CASF", 3)]
    assert ingest(df).receptors.count() == 2
    tsv = put(tmp_path, "r.tsv", "locus\tjunction_aa\tdonor_id\nTRA\tCAVF\td\n")
    assert ingest(tables.read_table(spark, tsv)).layout == "airr"
    for name, text in (("e.csv", "a,b\n"), ("d.csv", "a,a\n1,2\n"), ("p.csv", "a, b\n1,2\n"), ("b.csv", "a,\n1,2\n")):
        with pytest.raises(InputError):
            tables.read_table(spark, put(tmp_path, name, text))


def test_row_numbers_follow_the_file_over_partitions(spark):
    df = tables.numbered(spark.range(0, 1000, 1, 7))
    assert all(r.source_row == r.id + 2 for r in df.collect())


def test_dimension_tables(spark, tmp_path):
    ref = put(tmp_path, "ref.csv", "reference_id,cdr3b,peptide,hla,source,evidence,note\nf1,cassf,gilgfvftl,A*02:01,s,functional,kept\n")
    r = tables.read_references(spark, ref).first()
    assert (r.cdr3b, r.peptide, r.hla, r.note) == ("CASSF", "GILGFVFTL", "HLA-A*02:01", "kept")
    with pytest.raises(InputError):
        tables.read_panel(spark, put(tmp_path, "p.csv", "peptide,hla\nGIL,A0201\n"))
    with pytest.raises(InputError):
        tables.read_donors(spark, put(tmp_path, "d.csv", "donor_id,hla\nd1,\n"))
    with pytest.raises(InputError):
        tables.read_references(spark, put(tmp_path, "two.csv", "reference_id,cdr3b,peptide,source,evidence\nf,CASSF,GIL,s,e\nf,CASSF,GIL,s,e\n"))


def test_bundles_are_whole_or_absent(spark, tmp_path):
    source = put(tmp_path, "in.csv", "a\n1\n")
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    with bundle.bundle(out, [source], {"k": 1}) as stage:
        bundle.write_frame(df, os.path.join(stage, "t"))
    held = bundle.read_manifest(os.path.join(out, "manifest.json"))
    assert held["parameters"] == {"k": 1} and any("t.parquet" in p for p in held["outputs"])
    assert spark.read.parquet(f"{out}/t.parquet").first().b == [1, 2] and spark.read.csv(f"{out}/t.csv", header=True).first().b == "[1,2]"
    with pytest.raises(FileExistsError), bundle.bundle(out, [], {}):
        pass
    late = str(tmp_path / "late")
    with pytest.raises(RuntimeError), bundle.bundle(late, [source], {}):
        put(tmp_path, "in.csv", "a\n2\n")
    assert not os.path.exists(late) and not [p for p in os.listdir(tmp_path) if p.endswith(".stage")]
    with pytest.raises(ValueError):
        bundle.write_json({"x": float("nan")}, str(tmp_path / "x.json"))
    put(tmp_path, "m.json", '{"schema_version": 1, "schema_version": 1}')
    with pytest.raises(ValueError):
        bundle.read_manifest(str(tmp_path / "m.json"))
    assert bundle.frame_digest(df) == bundle.frame_digest(df.repartition(3)) != bundle.frame_digest(df.withColumnRenamed("a", "c"))
    assert json.load(open(os.path.join(out, "manifest.json")))["schema_version"] == 1


def test_streams(spark, tmp_path):
    rows = [("c1", "d", "1", "TRB", "CASSF", "true"), ("c2", "d", "2", "TRB", "CAXF", "true")]
    schema = "barcode string, donor_id string, contig_id string, chain string, cdr3 string, productive string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "s"))
    refs = spark.createDataFrame([("CASSF", "f1", "GIL")], "cdr3b string, reference_id string, peptide string")
    hits = stream_exact_hits(stream_chains(spark.readStream.schema(schema).parquet(str(tmp_path / "s"))), refs)
    q = hits.select("cell_id", "reference_id").writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("hits").collect()] == [("c1", "f1")]
    events = spark.readStream.schema("ts timestamp, event_type string").parquet("/root/testdata/sf0.001/events.parquet") if os.path.isdir("/root/testdata/sf0.001/events.parquet") else None
    if events is not None:
        assert windowed_counts(events, "ts", "event_type").isStreaming
