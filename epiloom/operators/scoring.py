"""The boundary to sequence models: a Scorer is run through mapInPandas, once for each distinct context."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hla
from ..functions.text import AA20, InputError
from .background import random_panel
from .ranking import background_percentile, rank_in_context

#: Letters of a batch, parts of a context, and letters of the longest peptide that is scored.
TOKEN_BUDGET, SALTS, LONGEST = 4096, 16, 50


class Scorer(Protocol):
    """Loaded once a Python worker; logits are per position over the twenty residues."""

    def fingerprint(self) -> str: ...

    def logits(self, context: str, length: int) -> np.ndarray: ...


class StubScorer:
    """A deterministic stand-in for a language model: logits follow from a hash of context and position."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fingerprint(self) -> str:
        return f"stub:{self.seed}"

    def logits(self, context: str, length: int) -> np.ndarray:
        digests = [hashlib.sha256(f"{self.seed}:{context}:{i}".encode()).digest()[:20] for i in range(length)]
        return (np.array([list(d) for d in digests], np.float32) - 128) / 64


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def pseudo_log_likelihood(scorer: Scorer, context: str, peptide: str) -> float:
    """Mean natural logarithm of the residues' probabilities."""
    lp = log_softmax(scorer.logits(context, len(peptide)))
    return float(np.mean([lp[i, AA20.index(a)] for i, a in enumerate(peptide)]))


def context_name(context: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in context])


def batched(rows: DataFrame, context: list[str], item: str, budget: int = TOKEN_BUDGET, salts: int = SALTS, longest: int = LONGEST) -> DataFrame:
    """rows with `batch`: rows of one context, and at most `budget` letters of items of up to `longest` letters.

    A context's rows are dealt into `salts` parts by a hash of the item, and each
    part is cut where its running sum of letters passes another width; a batch
    begins at most one width after the one before, and its last row adds less than
    `longest`.  So a context that has nearly all rows is spread, no window holds
    more than a part of it, and neither order nor number of tasks changes a batch.
    Items are distinct within a context; of equal ones any may come first.
    """
    if budget < 2 * longest:
        raise InputError("a batch takes two of the longest items at least")
    width = budget - longest + 1
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col(item), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % salts
    letters = F.least(F.coalesce(F.length(item), F.lit(0)), F.lit(longest))
    before = W.partitionBy(*context, "_salt").orderBy(F.length(item), item).rowsBetween(W.unboundedPreceding, -1)
    cut = rows.withColumn("_salt", salt).withColumn("_before", F.coalesce(F.sum(letters).over(before), F.lit(0)))
    return cut.withColumn("batch", F.concat_ws("-", "_salt", F.floor(F.col("_before") / width).cast("string"))).drop("_salt", "_before")


def scored(pairs: DataFrame, scorer: Scorer, context: list[str], peptide: str = "peptide", budget: int = TOKEN_BUDGET) -> DataFrame:
    """pairs with score and ok; rows of one context and length in a batch share the model's pass, distinct peptides are scored once."""
    name = context_name(context)
    work = batched(pairs.select(name.alias("_context"), F.col(peptide).alias("_peptide")).distinct(), ["_context"], "_peptide", budget)

    def run(frames: Iterator):
        import pandas as pd

        held = ((None, None), None)
        for pdf in frames:
            out = []
            for c, p in zip(pdf["_context"], pdf["_peptide"], strict=True):
                good = isinstance(p, str) and 1 <= len(p) <= 50 and set(p) <= set(AA20)
                if good and held[0] != (c, len(p)):
                    held = ((c, len(p)), log_softmax(scorer.logits(c, len(p))))
                out.append(float(np.mean([held[1][i, AA20.index(a)] for i, a in enumerate(p)])) if good else None)
            yield pd.DataFrame({"_context": pdf["_context"], "_peptide": pdf["_peptide"], "score": out}).astype({"score": "float64"})

    ready = work.repartition("_context", "batch").sortWithinPartitions("_context", "batch", F.length("_peptide")).select("_context", "_peptide")
    found = ready.mapInPandas(run, "_context string, _peptide string, score double").withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    joined = pairs.withColumn("_name", name).join(found, (F.col("_name") == found["_context"]) & F.col(peptide).eqNullSafe(found["_peptide"]), "left")
    return joined.withColumn("ok", F.col("score").isNotNull()).drop("_name", "_context", "_peptide")


def profiles(contexts: DataFrame, scorer: Scorer, context: list[str], length: str = "peptide_length") -> DataFrame:
    """context columns, length, position, amino_acid, probability of each distinct context."""
    keys = contexts.select(*context, F.col(length).cast("int").alias(length)).distinct()
    kinds = dict(keys.dtypes)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                *c, n = row
                p = np.exp(log_softmax(scorer.logits("|".join("" if x is None else str(x) for x in c), int(n))))
                rows += [(*c, int(n), i + 1, a, float(p[i, j])) for i in range(int(n)) for j, a in enumerate(AA20)]
            yield pd.DataFrame(rows, columns=[*context, length, "position", "amino_acid", "probability"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*context, length)) + ", position int, amino_acid string, probability double"
    return keys.mapInPandas(run, schema)


def score_pmhc(panel: DataFrame, scorer: Scorer, background: int = 1000, seed: int = 0, max_rows: int = 100_000, species: str = "human") -> DataFrame:
    """Every row of the panel with status, score, percentile against a random background of its molecule and length, and reason."""
    named = hla.normalized(panel, "hla", "_mhc", species)
    reason = F.coalesce(
        F.when(F.col("hla").isNull(), "the panel names no molecule"), F.col("_mhc_error"), F.col("_mhc_abstains"), F.when(~F.coalesce(F.col("peptide").rlike(rf"\A[{AA20}]+\z"), F.lit(False)), "the peptide has other letters than the twenty residues"),
        F.when(~F.length("peptide").between(1, 50), "the peptide's length isn't 1 to 50"),
    )
    rows = named.withColumns({"reason": reason, "hla_input": F.col("hla"), "hla": F.coalesce("_mhc", "hla"), "peptide_length": F.length("peptide")}).drop("_mhc", "_mhc_error", "_mhc_abstains")
    fit = rows.filter("reason IS NULL")
    drawn = random_panel(fit.select("hla", "peptide_length"), background, seed, max_rows)
    both = fit.select("hla", "peptide").distinct().withColumn("_bg", F.lit(False)).unionByName(drawn.select("hla", "peptide").withColumn("_bg", F.lit(True)))
    out = scored(both, scorer, ["hla"]).withColumn("peptide_length", F.length("peptide"))
    told = background_percentile(out.filter("NOT _bg").drop("_bg"), out.filter("_bg"), ["hla", "peptide_length"])
    told = told.select(F.col("hla").alias("_h"), F.col("peptide").alias("_p"), "score", "background_n", "background_percentile")
    joined = rows.join(told, rows["hla"].eqNullSafe(told["_h"]) & rows["peptide"].eqNullSafe(told["_p"]) & rows["reason"].isNull(), "left").drop("_h", "_p")
    return joined.withColumn("status", F.when(F.col("score").isNotNull(), "Scored").otherwise("Unresolved"))


def score_repertoire(exported: DataFrame, scorer: Scorer) -> DataFrame:
    """Exported pairs scored, skipped ones kept as Unresolved, ranked within receptor, molecule and length."""
    ready = scored(exported.filter("skip_reason IS NULL"), scorer, ["receptor_id", "hla"]).drop("ok")
    skipped = exported.filter("skip_reason IS NOT NULL").withColumn("score", F.lit(None).cast("double"))
    full = ready.unionByName(skipped).withColumns({"peptide_length": F.length("peptide"), "status": F.when(F.col("score").isNotNull(), "ModelHypothesis").otherwise("Unresolved"), "reason": F.col("skip_reason")})
    return rank_in_context(full.drop("skip_reason"), ["receptor_id", "hla", "peptide_length"])

