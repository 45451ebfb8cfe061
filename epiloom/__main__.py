"""Commands over files: python -m epiloom <command> --out <folder> ...

Every command writes one bundle (tables as Parquet and CSV, manifest with the
hashes of what went in and out) or nothing, and refuses an existing folder.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import InputError
from .operators import background, evaluate, ingest, pairs, profile, scoring
from .operators.bridge import one_provenance
from .operators.screen import screen
from .sources import tables
from .sources.bundle import bundle, write_frame

#: Rows made up for the example: two cells of one clone, one with a beta chain only, one that a reference meets at a distance of one.
_CLONE = ("TRAV8-3", "TRAJ10", "CALWDKNSGYTIEF", "TRBV5-1", "TRBJ2-2", "CASRHDPWQNVELFF")
EXAMPLE = {
    "receptors.csv": "cell_id,donor_id,trav,traj,cdr3a,trbv,trbj,cdr3b\n" + "".join(f"{cell},made_donor,{','.join(row)}\n" for cell, row in (("first", _CLONE), ("second", _CLONE), ("beta_only", ("", "", "", *_CLONE[3:])), ("near", (*_CLONE[:2], "CALWDKNSGYTIDF", *_CLONE[3:])))),
    "references.csv": "reference_id,cdr3a,cdr3b,trav,traj,trbv,trbj,peptide,hla,source,evidence\n" + f"made1,{_CLONE[2]},{_CLONE[5]},{_CLONE[0]},{_CLONE[1]},{_CLONE[3]},{_CLONE[4]},KLDVGNAEYV,HLA-B*35:01,made up,functional\n",
    "panel.csv": "peptide,hla\nKLDVGNAEYV,HLA-B*35:01\nWDTNPEKHLY,HLA-B*35:01\n",
    "donors.csv": "donor_id,hla\nmade_donor,HLA-B*35:01\n",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epiloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str):
        c = sub.add_parser(name)
        c.add_argument("--out", required=True)
        for o in options:
            c.add_argument(f"--{o}", required=o not in ("donors", "donor-id"))
        return c

    command("example")
    for name, options in (("validate", ("input", "donor-id")), ("screen", ("input", "donor-id", "references", "panel", "donors")), ("export", ("input", "donor-id", "panel", "donors")), ("repertoire-score", ("input", "donor-id", "panel", "donors"))):
        c = command(name, *options)
        c.add_argument("--format", default="auto", choices=["auto", "10x", "airr", "paired"])
        c.add_argument("--species", default="human", choices=["human", "mouse"])
        c.add_argument("--max-pairings", type=int, default=16)
        c.add_argument("--max-distance", type=int, default=1)
        c.add_argument("--max-pairs", type=int, default=1_000_000)
    command("import", "expected", "scores")
    command("lookup", "panel", "library")
    command("profile", "panel").add_argument("--pseudocount", type=float, default=0.5)
    command("pmhc-score", "panel").add_argument("--background", type=int, default=1000)
    command("pmhc-profile", "panel").add_argument("--floor", type=float, default=1e-12)
    command("background", "panel").add_argument("--seed", type=int, default=0)
    command("evaluate", "scores", "labels").add_argument("--lower-is-better", action="store_true")
    return p


def results(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Tables of the command by name."""
    panel = lambda: tables.read_panel(spark, a.panel)
    if a.command in ("validate", "screen", "export", "repertoire-score"):
        held = ingest.ingest(tables.read_table(spark, a.input), a.format, a.donor_id, a.max_pairings, a.species)
        if a.command == "validate":
            return {"chains": held.chains, "receptors": held.receptors, "cells": held.cells, "qc": held.qc}
        donors = tables.read_donors(spark, a.donors) if a.donors else None
        if a.command == "screen":
            donors = donors if donors is not None else spark.createDataFrame([], "donor_id string, hla string")
            return {"evidence": screen(held.receptors, tables.read_references(spark, a.references), panel(), donors, a.max_distance, a.species), "receptors": held.receptors, "qc": held.qc}
        out = pairs.export_pairs(held.receptors, panel(), donors, a.max_pairs, a.species)
        if a.command == "export":
            return {"pairs": out.filter("skip_reason IS NULL").drop("skip_reason"), "skipped": out.filter("skip_reason IS NOT NULL")}
        return {"results": scoring.score_repertoire(out, scoring.StubScorer())}
    if a.command == "import":
        read = lambda path: tables.read_table(spark, path, "suffix").drop("source_row")
        return {"results": pairs.import_scores(read(a.expected), read(a.scores))}
    if a.command == "lookup":
        return {"results": pairs.library_lookup(panel(), tables.read_table(spark, a.library, "suffix"))}
    if a.command == "profile":
        return {"profile": profile.empirical_profile(pairs.normalized_panel(panel()), a.pseudocount)}
    contexts = lambda: panel().select("hla", F.length("peptide").alias("peptide_length"))
    if a.command == "pmhc-score":
        return {"results": scoring.score_pmhc(panel(), scoring.StubScorer(), a.background)}
    if a.command == "pmhc-profile":
        return {"pssm": profile.pssm(scoring.profiles(contexts(), scoring.StubScorer(), ["hla"]), a.floor)}
    if a.command == "background":
        return {"background": background.random_panel(contexts(), seed=a.seed)}
    keys = ["receptor_id", "peptide", "hla"]
    scores = tables.read_table(spark, a.scores, "comma").withColumn("score", pairs.numeric_score("score"))
    labels = tables.read_table(spark, a.labels, "comma").withColumn("label", F.col("label").cast("int"))
    one_provenance(scores, ["model", "metric"])
    scores, labels = evaluate.normalized_keys(scores.select(*keys, "score")), evaluate.normalized_keys(labels.select(*keys, "label"))
    return {"evaluation": evaluate.evaluate(scores, labels, keys, keys[1:], not a.lower_is_better)}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    inputs = [v for k, v in vars(a).items() if k in ("input", "references", "panel", "donors", "expected", "scores", "labels", "library") and v]
    try:
        with bundle(a.out, inputs, {k: v for k, v in vars(a).items() if k not in ("out", *inputs)}) as stage:
            if a.command == "example":
                for name, text in EXAMPLE.items():
                    with open(os.path.join(stage, name), "w", encoding="utf-8") as f:
                        f.write(text)
                return 0
            spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
            for name, df in results(spark, a).items():
                write_frame(df, os.path.join(stage, name))
    except (InputError, ValueError, OSError, RuntimeError) as e:
        print(f"epiloom: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
