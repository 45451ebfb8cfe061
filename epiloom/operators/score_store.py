"""Scores kept from run to run: what is known under the same fingerprint isn't scored again.

The store is a Parquet table partitioned by model and fingerprint.  A run reads
its own fingerprint's partition only, takes away what that has by an anti-join,
scores the rest and appends it; Spark commits the append, so a run that fails
leaves the store as it was.  A fingerprint names everything that a score depends
on; a model whose fingerprint has changed is refused unless the caller says that
its scores are to be made anew, and old ones are never mixed in.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import InputError
from ..sources.staging import staged
from .scoring import Scorer, context_name, scored

SCHEMA = "context string, peptide string, score double, model string, fingerprint string"
VERSION = 1


def fingerprint(scorer: Scorer, context: list[str], species: str = "human", reference: str | None = None) -> str:
    """Of the model, of the species and sequences that it reads molecules by, and of what makes up a context."""
    told = {"version": VERSION, "scorer": scorer.fingerprint(), "context": context, "species": species, "reference": reference}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def require_same(a: str, b: str) -> None:
    """A background ranks only scores of the model that made it."""
    if a != b:
        raise InputError("background and scores come from different models")


@dataclass(frozen=True)
class ScoreStore:
    spark: SparkSession
    path: str

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def known(self, model: str, mark: str) -> DataFrame:
        """context, peptide, score of a fingerprint; two runs at once may have appended the same pair, but not with two scores."""
        rows = self.table().filter((F.col("model") == model) & (F.col("fingerprint") == mark))
        one = rows.groupBy("context", "peptide").agg(F.min("score").alias("score"), F.max("score").alias("most"), (F.count("*") > F.count("score")).alias("failed"), F.count("score").alias("n"))
        apart = (F.col("score") != F.col("most")) | (F.col("failed") & (F.col("n") > 0))
        return one.select("context", "peptide", F.when(apart, F.raise_error(F.lit("the store holds two scores of one pair"))).otherwise(F.col("score")).alias("score"))

    def fingerprints(self, model: str) -> set[str]:
        """Those under which the model has scores: partition values, however many rows they have."""
        return {r[0] for r in self.table().filter(F.col("model") == model).select("fingerprint").distinct().collect()}

    def score(self, pairs: DataFrame, scorer: Scorer, context: list[str], model: str, renew: bool = False, species: str = "human", reference: str | None = None) -> tuple[DataFrame, dict]:
        """pairs with score and ok, and how many distinct pairs were reused and scored; renew: whether a changed fingerprint is meant."""
        mark = fingerprint(scorer, context, species, reference)
        held = self.fingerprints(model)
        if held and mark not in held and not renew:
            raise InputError(f"the scores of {model} are of another fingerprint; renew says that they are to be made anew")
        asked = pairs.select(context_name(context).alias("context"), F.col("peptide")).distinct()
        missing = staged(self._missing(asked, model, mark))
        new = missing.count()
        if new:
            fresh = scored(missing, scorer, ["context"]).select("context", "peptide", "score", F.lit(model).alias("model"), F.lit(mark).alias("fingerprint"))
            fresh.write.mode("append").partitionBy("model", "fingerprint").option("compression", "zstd").parquet(self.path)
        found = self.known(model, mark).withColumnsRenamed({"context": "_context", "peptide": "_peptide"})
        named = pairs.withColumn("_name", context_name(context))
        out = named.join(found, (F.col("_name") == F.col("_context")) & named["peptide"].eqNullSafe(F.col("_peptide")), "left").drop("_name", "_context", "_peptide")
        return out.withColumn("ok", F.col("score").isNotNull()), {"asked": asked.count(), "scored": new, "fingerprint": mark}

    def _missing(self, asked: DataFrame, model: str, mark: str) -> DataFrame:
        known = self.known(model, mark).select(F.col("context").alias("_c"), F.col("peptide").alias("_p"))
        return asked.join(known, (F.col("context") == F.col("_c")) & F.col("peptide").eqNullSafe(F.col("_p")), "left_anti")
