"""Receptors, references, panels and typings derived from the star-schema tables, by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, LETTERS = "0123456789abcdef", "ACDEFGHIKLMNPQRS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cdr3(key: str, kinds: int = 97) -> str:
    """SQL of a junction that `key` stands for (Spark; DuckDB by `duck`)."""
    return f"concat('C', substr(translate(md5(cast(({key}) % {kinds} as string)), '{HEX}', '{LETTERS}'), 1, cast(6 + ({key}) % 7 as int)), 'F')"


def peptide(key: str, kinds: int = 41) -> str:
    return f"substr(translate(md5(concat('p', cast(({key}) % {kinds} as string))), '{HEX}', '{LETTERS}'), 1, cast(8 + ({key}) % 3 as int))"


def allele(key: str) -> str:
    return f"case ({key}) % 5 when 0 then 'HLA-A*02:01' when 1 then 'HLA-A*03:01' when 2 then 'HLA-B*07:02' when 3 then 'HLA-C*07:01' end"


def gene(prefix: str, key: str, kinds: int = 9) -> str:
    return f"case when ({key}) % 11 = 0 then null else concat('{prefix}', cast(1 + ({key}) % {kinds} as string)) end"


def duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)").replace("as int)", "as bigint)")


RECEPTORS = f"""SELECT concat('r', cast(c_custkey as string)) AS receptor_id, concat('d', cast(c_nationkey as string)) AS donor_id,
  case when c_custkey % 7 = 0 then null else {cdr3('c_custkey * 3')} end AS cdr3a, case when c_custkey % 13 = 0 then null else {cdr3('c_custkey * 5 + 1', 389)} end AS cdr3b,
  {gene('TRAV', 'c_custkey')} AS trav, {gene('TRAJ', 'c_custkey * 2')} AS traj, {gene('TRBV', 'c_custkey * 3')} AS trbv, {gene('TRBJ', 'c_custkey + 4')} AS trbj,
  case when c_custkey % 91 = 0 then 'no_productive_chains' when c_custkey % 7 = 0 then 'single_beta' when c_custkey % 13 = 0 then 'single_alpha' else 'paired' end AS pairing_status, '' AS unusable_chain_context FROM customer"""
REFERENCES = f"""SELECT concat('f', cast(p_partkey as string)) AS reference_id, case when p_partkey % 3 = 0 then null else {cdr3('p_partkey')} end AS cdr3a, {cdr3('p_partkey * 2 + 1', 389)} AS cdr3b,
  {gene('TRAV', 'p_partkey')} AS trav, {gene('TRAJ', 'p_partkey')} AS traj, {gene('TRBV', 'p_partkey')} AS trbv, {gene('TRBJ', 'p_partkey')} AS trbj,
  {peptide('p_partkey')} AS peptide, {allele('p_partkey')} AS hla, p_brand AS source, case p_partkey % 4 when 0 then 'functional' when 1 then 'Multimer' when 2 then 'curated' else 'other' end AS evidence FROM part"""
PANEL = f"SELECT DISTINCT {peptide('s_suppkey')} AS peptide, {allele('s_suppkey')} AS hla FROM supplier"
DONORS = f"SELECT concat('d', cast(n_nationkey as string)) AS donor_id, a.hla FROM nation JOIN (SELECT DISTINCT {allele('r_regionkey')} AS hla, r_regionkey AS k FROM region) a ON (n_nationkey % 4 = a.k OR n_regionkey = a.k) WHERE a.hla IS NOT NULL AND n_nationkey <> 3"


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(_placed(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _placed(sql: str, tables: tuple[str, ...]) -> str:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN|,) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def receptors(spark, sf_dir):
    return derived(spark, sf_dir, RECEPTORS, "customer")


def references(spark, sf_dir):
    return derived(spark, sf_dir, REFERENCES, "part")


def panel(spark, sf_dir):
    return derived(spark, sf_dir, PANEL, "supplier")


def donors(spark, sf_dir):
    return derived(spark, sf_dir, DONORS, "nation", "region")
