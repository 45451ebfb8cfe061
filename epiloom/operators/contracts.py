"""Contracts of tables that models hand back, checked in the pass that writes them.

Every rule is a count of rows that break it, and the identities of a table are a
sum of hashes that no order changes.  Both are observed beside the write, so a
sound table is read once: where count and both sums agree with those of the
expected identities, which are distinct, none is missing, added or repeated.
Only a table that is refused anyway is looked at again, to name what is wrong.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import InputError, clean
from ..sources.staging import staging_dir
from .ranking import finite

#: A log probability may exceed 0 by this much, as sums of floats do.
ROUNDING = 1e-7
TRUE, FALSE = ("true", "1"), ("false", "0")


@dataclass(frozen=True)
class Contract:
    """identity: columns that name a row; rules: what rows may not do, by name; types: columns that must have a type."""

    identity: list[str]
    rules: dict[str, Column] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)

    def wrong_types(self, df: DataFrame) -> list[str]:
        kinds = dict(df.dtypes)
        return [f"{c} is {kinds.get(c, 'missing')}, not {kind}" for c, kind in self.types.items() if kinds.get(c) != kind]

    def all_rules(self) -> dict[str, Column]:
        missing = {f"{c} is missing": F.col(c).isNull() for c in self.identity}
        return missing | {name: F.coalesce(broken, F.lit(False)) for name, broken in self.rules.items()}


def score_contract(score: str = "score", identity: tuple[str, ...] = ("name", "peptide", "hla"), ok: str = "ok") -> Contract:
    """What a scorer may hand back: a flag of success, and a log probability exactly where it succeeded."""
    flag = F.lower(clean(F.col(ok).cast("string")))
    text = clean(F.col(score).cast("string"))
    value = text.try_cast("double")
    good, failed = flag.isin(*TRUE), flag.isin(*FALSE)
    return Contract(
        list(identity),
        {
            "the flag is neither true nor false": ~F.coalesce(good | failed, F.lit(False)),
            "the score isn't a number": text.isNotNull() & value.isNull(),
            "success without a log probability": good & ~(finite(value) & (value <= ROUNDING)),
            "failure with a score": failed & finite(value),
        },
    )


def sums(identity: list[str]) -> dict[str, Column]:
    """Count and order-free sums of two hashes of the identities; null columns count as such."""
    text = F.to_json(F.array(*[F.col(c).cast("string") for c in identity]))
    return {"rows": F.count("*"), "one": F.sum(F.xxhash64(text).cast("decimal(20,0)")), "other": F.sum(F.xxhash64(F.lit("epiloom"), text).cast("decimal(20,0)"))}


def summed(df: DataFrame, identity: list[str]):
    return df.agg(*[v.alias(k) for k, v in sums(identity).items()]).first()


def differences(df: DataFrame, expected: DataFrame, identity: list[str]) -> DataFrame:
    """rule, n: identities that are missing, that weren't asked for, and rows that repeat one."""
    side = lambda x, here: x.select(*identity, F.lit(here).alias("here"))
    counts = side(df, 1).unionByName(side(expected, 0)).groupBy(*identity).agg(F.sum("here").alias("got"), F.sum(1 - F.col("here")).alias("asked"))
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = counts.agg(
        of(F.when(F.col("got") == 0, 1)).alias("missing"), of(F.when(F.col("asked") == 0, F.col("got"))).alias("added"), of(F.when((F.col("got") > 1) & (F.col("asked") > 0), F.col("got") - 1)).alias("repeated")
    )
    named = [("a row is missing", "missing"), ("a row wasn't asked for", "added"), ("a row is repeated", "repeated")]
    return found.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).alias("n")) for rule, c in named])))


def audit(df: DataFrame, contract: Contract, expected: DataFrame | None = None) -> DataFrame:
    """rule, n: how many rows break each rule (the look at a table that doesn't keep its contract)."""
    rules = contract.all_rules()
    counts = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    out = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)])))
    return out if expected is None else out.unionByName(differences(df, expected, contract.identity))


def checked(df: DataFrame, contract: Contract, expected: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """df, written to path (the shared folder, if none is given) and read again; InputError, and nothing left there, where it breaks the contract.

    expected: the identities that it must have, each once.
    """
    if wrong := contract.wrong_types(df):
        raise InputError("; ".join(wrong))
    path = path or f"{staging_dir(df.sparkSession)}/epiloom-{uuid.uuid4().hex}"
    rules, seen = contract.all_rules(), Observation()
    counts = [F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())]
    df.observe(seen, *counts, *[v.alias(k) for k, v in sums(contract.identity).items()]).write.option("compression", "zstd").parquet(path)
    told = seen.get
    broken = [f"{name} ({told[f'r{i}']} rows)" for i, name in enumerate(rules) if told[f"r{i}"]]
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    if expected is not None and not broken:
        want = summed(expected, contract.identity)
        if any(told[k] != want[k] for k in ("rows", "one", "other")):
            broken = [f"{r.rule} ({r.n} rows)" for r in differences(written, expected, contract.identity).filter("n > 0").collect()]
    if broken:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        raise InputError("; ".join(broken))
    return written
