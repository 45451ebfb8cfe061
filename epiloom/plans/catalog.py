"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import genes, hla
from ..functions import text as t
from ..operators import background, bridge, contracts, embedding, evaluate, ingest, knn, pairs, profile, ranking, score_store, scoring, sink
from ..operators.edit_join import edit_pairs
from ..operators.screen import screen, unmatched
from ..sources.staging import staging_dir
from ..sources.tables import numbered
from . import synthetic as s
from .synthetic import cdr3, derived, duck, peptide, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- evaluation -------------------------------------------------------------------------------------------------

_SCORES = "SELECT doc_id, lang, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(n_chars % 50 AS DOUBLE) END AS score FROM documents"
_LABELS = "SELECT doc_id, lang, toxic AS label FROM labels JOIN documents USING (doc_id)"
_BOTH = f"s AS ({_SCORES}), l AS (SELECT doc_id, lang, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, count(DISTINCT label) AS n FROM ({_LABELS}) GROUP BY ALL), b AS (SELECT coalesce(s.lang, l.lang) AS lang, s.score, l.label, coalesce(l.n, 0) AS n FROM s FULL JOIN l USING (doc_id))"


def _evaluated(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = docs.select("doc_id", "lang", F.expr("CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(n_chars % 50 AS DOUBLE) END AS score"))
    known = labels.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("toxic").alias("label"))
    return evaluate.evaluate(scores, known, ["doc_id", "lang"], ["lang"])


@query(f"""WITH {_BOTH}, u AS (SELECT lang, score, label FROM b WHERE score IS NOT NULL AND label IS NOT NULL),
a AS (SELECT p.lang, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auroc FROM u p JOIN u n ON p.lang = n.lang AND p.label = 1 AND n.label = 0 GROUP BY 1),
x AS (SELECT lang, score, sum(label) AS p FROM u GROUP BY ALL),
y AS (SELECT x.lang, x.p, (SELECT sum(label) FROM u WHERE u.lang = x.lang AND u.score >= x.score) AS tp, (SELECT count(*) FROM u WHERE u.lang = x.lang AND u.score >= x.score) AS k, (SELECT sum(label) FROM u WHERE u.lang = x.lang) AS pos FROM x)
SELECT a.lang, round(auroc, 6) AS auroc, round((SELECT sum(p / pos * tp / k) FROM y WHERE y.lang = a.lang), 6) AS average_precision FROM a""")
def eval_auroc_ap(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir).filter("auroc IS NOT NULL").select("lang", "auroc", "average_precision"), "auroc", "average_precision")


@query(f"""WITH {_BOTH} SELECT lang, count(*) AS n_keys, count(*) FILTER (WHERE n = 1) AS n_known, count(*) FILTER (WHERE n > 1) AS n_conflicting, count(*) FILTER (WHERE n = 0) AS n_unknown,
count(*) FILTER (WHERE label IS NOT NULL AND score IS NOT NULL) AS n_scored, round(count(*) FILTER (WHERE label IS NOT NULL AND score IS NOT NULL) / count(*) FILTER (WHERE n = 1), 6) AS coverage FROM b GROUP BY lang""")
def eval_full_outer_coverage(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir).select("lang", "n_keys", "n_known", "n_conflicting", "n_unknown", "n_scored", "coverage"), "coverage")


# ---- ranks, percentiles, histograms -----------------------------------------------------------------------------

_ORDER_SCORE = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice / 1000) END"


@query(f"WITH o AS (SELECT o_orderkey, o_orderpriority, {_ORDER_SCORE} AS score FROM orders) SELECT o_orderkey, o_orderpriority, score, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY o_orderpriority ORDER BY score DESC NULLS LAST) END AS rank FROM o")
def rank_min_in_context(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr(f"CAST({_ORDER_SCORE} AS DOUBLE)").alias("score"))
    return ranking.rank_in_context(o, ["o_orderpriority"])


@query("WITH m AS (SELECT l_returnflag, l_partkey, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_partkey, score, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_partkey) AS place FROM m QUALIFY place <= 10")
def topk_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", F.col("l_extendedprice").alias("score"))
    return ranking.top_distinct(rows, ["l_returnflag"], "l_partkey", 10)


@query("WITH m AS (SELECT l_returnflag, l_partkey, max(l_quantity) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY score DESC) AS rank FROM m) SELECT l_orderkey, l_linenumber, rank FROM lineitem JOIN r USING (l_returnflag, l_partkey)")
def rank_distinct_back(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", F.col("l_quantity").alias("score"))
    return ranking.rank_distinct(rows, ["l_returnflag"], "l_partkey").select("l_orderkey", "l_linenumber", "rank")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS ctx, floor(o_totalprice / 500) AS score, o_orderstatus AS st FROM orders),
n AS (SELECT ctx, count(*) AS n FROM o WHERE st <> 'F' GROUP BY 1),
g AS (SELECT ctx, score, count(*) AS c FROM o WHERE st <> 'F' GROUP BY ALL),
x AS (SELECT d.ctx, d.score, coalesce((SELECT sum(c) FROM g WHERE g.ctx = d.ctx AND g.score >= d.score), 0) AS above FROM (SELECT DISTINCT ctx, score FROM o) d)
SELECT o.o_orderkey, n.n AS background_n, round(100.0 * (1 + x.above) / (n.n + 1), 6) AS background_percentile FROM o JOIN n USING (ctx) JOIN x ON x.ctx = o.ctx AND x.score = o.score WHERE st = 'F'""")
def background_percentile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ctx"), F.expr("CAST(floor(o_totalprice / 500) AS DOUBLE)").alias("score"), "o_orderstatus")
    out = ranking.background_percentile(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), ["ctx"])
    return rounded(out.select("o_orderkey", "background_n", "background_percentile"), "background_percentile")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT o_orderstatus AS series, least(floor((o_totalprice - lo) * 24 / (hi - lo)), 23)::INT AS bin, count(*) AS n FROM orders, e GROUP BY ALL)
SELECT series, bin, n, round(n / sum(n) OVER (PARTITION BY series), 6) AS share FROM b""")
def histogram_24(spark, sf_dir):
    return rounded(ranking.histogram(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus"), "share")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_of_each(spark, sf_dir):
    return ranking.first_of_each(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200")
def preview_200(spark, sf_dir):
    return ranking.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")])


# ---- profiles ---------------------------------------------------------------------------------------------------

_PANEL = f"SELECT CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN NULL ELSE p_brand END AS hla, {peptide('p_partkey', 997)} AS peptide FROM part"
_EMPIRICAL = duck(f"""WITH p AS (SELECT DISTINCT hla, peptide, length(peptide) AS length FROM ({_PANEL})), g AS (SELECT hla, length, count(*) AS n_peptides FROM p GROUP BY ALL),
grid AS (SELECT hla, length, n_peptides, position, amino_acid FROM g, unnest(range(1, length + 1)) AS q(position), unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS a(amino_acid)),
c AS (SELECT hla, length, i AS position, substr(peptide, i, 1) AS amino_acid, count(*) AS seen FROM p, unnest(range(1, length + 1)) AS u(i) GROUP BY ALL),
e AS (SELECT grid.*, coalesce(seen, 0) AS count, (coalesce(seen, 0) + 0.5) / (n_peptides + 10) AS frequency FROM grid LEFT JOIN c ON grid.hla IS NOT DISTINCT FROM c.hla AND grid.length = c.length AND grid.position = c.position AND grid.amino_acid = c.amino_acid)""")


def _empirical(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    least = p.agg(F.min("p_brand").alias("least"))
    panel = p.crossJoin(F.broadcast(least)).select(F.expr("CASE WHEN p_brand = least THEN NULL ELSE p_brand END").alias("hla"), F.expr(peptide("p_partkey", 997)).alias("peptide"))  # one row
    return profile.empirical_profile(panel)


@query(f"{_EMPIRICAL} SELECT hla, length, position, amino_acid, count, round(frequency, 9) AS frequency, round(log2(frequency * 20), 6) AS log2_odds, n_peptides FROM e")
def pssm_empirical(spark, sf_dir):
    return rounded(rounded(_empirical(spark, sf_dir), "frequency", digits=9), "log2_odds")


@query(f"{_EMPIRICAL} SELECT hla, length, position, amino_acid, round(frequency, 9) AS probability, round(log2(greatest(frequency, 0.002) / 0.05), 6) AS log2_odds, frequency < 0.002 AS floor_applied FROM e")
def pssm_from_profile(spark, sf_dir):
    given = _empirical(spark, sf_dir).select("hla", "length", "position", "amino_acid", F.col("frequency").alias("probability"))
    return rounded(rounded(profile.pssm(given, floor=0.002), "log2_odds").drop("background"), "probability", digits=9)


@query(f"{_EMPIRICAL}, t AS (SELECT *, max(frequency) OVER (PARTITION BY hla, length, position) AS top FROM e) SELECT hla, length, position, round(greatest(0, log2(20.0) + sum(frequency * log2(frequency))), 6) AS bits, CASE WHEN count(*) FILTER (WHERE abs(frequency - top) <= 1e-12) = 1 THEN max(amino_acid) FILTER (WHERE abs(frequency - top) <= 1e-12) ELSE 'X' END AS consensus FROM t GROUP BY ALL")
def info_content(spark, sf_dir):
    given = _empirical(spark, sf_dir).select("hla", "length", "position", "amino_acid", F.col("frequency").alias("probability"))
    return rounded(profile.information_content(given, "hla", "length"), "bits")


# ---- sequence joins and screening -------------------------------------------------------------------------------


def _junction(key: str) -> str:
    """SQL of a junction that begins like most: families of ten, told apart by one letter and their middles."""
    family = f"({key} - {key} % 10)"
    return f"concat('CASS', substr(translate(md5(cast({family} as string)), '{s.HEX}', '{s.LETTERS}'), 1, cast(6 + {family} % 7 as int)), substr('{s.LETTERS}', cast(1 + {key} % 10 as int), 1), 'EQYF')"


def _edit(k: int):
    def run(spark, sf_dir):
        left = table(spark, sf_dir, "customer").select(F.expr(_junction("c_custkey")).alias("seq"))
        right = table(spark, sf_dir, "part").select(F.expr(_junction("p_partkey")).alias("seq"))
        return edit_pairs(left, right, k)

    run.__name__ = f"edit_join_k{k}"
    a, b = duck(_junction("c_custkey")), duck(_junction("p_partkey"))
    return query(f"WITH a AS (SELECT DISTINCT {a} AS a FROM customer), b AS (SELECT DISTINCT {b} AS b FROM part) SELECT a, b, levenshtein(a, b)::INT AS distance FROM a, b WHERE levenshtein(a, b) <= {k}")(run)


for _k in range(4):
    _edit(_k)

_U = lambda c: f"coalesce(regexp_full_match({c}, 'C[ACDEFGHIKLMNPQRSTVWY]+[FW]'), false)"
_G = lambda g, on: f"CASE WHEN NOT {on} THEN 'skip' WHEN r.{g} IS NULL OR f.{g} IS NULL THEN 'unresolved' WHEN r.{g} = f.{g} THEN 'compatible' ELSE 'conflict' END"
_SCREEN = duck(f"""WITH r AS ({s.RECEPTORS}), f0 AS ({s.REFERENCES}), p AS ({s.PANEL}), d AS (SELECT DISTINCT * FROM ({s.DONORS})),
f AS (SELECT * FROM f0 WHERE peptide IN (SELECT peptide FROM p)),
h AS (SELECT r.receptor_id, r.donor_id, r.pairing_status, f.reference_id, f.peptide, f.hla, f.source, f.evidence, {_U('r.cdr3a')} AND {_U('f.cdr3a')} AS sa, {_U('r.cdr3b')} AND {_U('f.cdr3b')} AS sb,
  levenshtein(r.cdr3a, f.cdr3a) AS da, levenshtein(r.cdr3b, f.cdr3b) AS db, [{_G('trav', 'sa')}, {_G('traj', 'sa')}, {_G('trbv', 'sb')}, {_G('trbj', 'sb')}] AS gs FROM r, f),
k AS (SELECT *, CASE WHEN sa THEN da END AS alpha_distance, CASE WHEN sb THEN db END AS beta_distance, coalesce(CASE WHEN sa THEN da END, 0) + coalesce(CASE WHEN sb THEN db END, 0) AS distance FROM h WHERE sa OR sb),
j AS (SELECT *, CASE WHEN list_contains(gs, 'conflict') THEN 'conflict' WHEN list_contains(gs, 'unresolved') THEN 'unresolved' ELSE 'compatible' END AS gene_status,
  (CASE WHEN distance = 0 THEN 'exact' ELSE 'similar' END) || (CASE WHEN sa AND sb THEN '_paired' ELSE '_single_chain' END) AS evidence_type,
  CASE WHEN hla IN (SELECT d.hla FROM d WHERE d.donor_id = k.donor_id) THEN 'compatible' ELSE 'unresolved' END AS donor_hla_status FROM k WHERE distance <= 1),
e AS (SELECT j.*, p.hla AS panel_hla, CASE WHEN j.hla IS NULL OR p.hla IS NULL THEN 'unresolved' WHEN j.hla = p.hla THEN 'compatible' ELSE 'incompatible' END AS panel_hla_status FROM j JOIN p USING (peptide)),
x AS (SELECT *, CASE WHEN donor_hla_status = 'compatible' AND panel_hla_status = 'compatible' THEN 'compatible' ELSE 'unresolved' END AS hla_status FROM e WHERE panel_hla_status <> 'incompatible'),
y AS (SELECT *, CASE WHEN hla_status = 'compatible' AND gene_status <> 'conflict' THEN 'Candidate' ELSE 'Unresolved' END AS status FROM x)""")
_RANK = """row_number() OVER (PARTITION BY receptor_id ORDER BY status <> 'Candidate', CASE evidence_type WHEN 'exact_paired' THEN 0 WHEN 'exact_single_chain' THEN 1 WHEN 'similar_paired' THEN 2 ELSE 3 END,
  distance, CASE lower(evidence) WHEN 'functional' THEN 0 WHEN 'multimer' THEN 1 WHEN 'curated' THEN 2 ELSE 3 END, reference_id, panel_hla NULLS LAST)"""


def _to_screen(spark, sf_dir):
    return s.receptors(spark, sf_dir), s.references(spark, sf_dir), s.panel(spark, sf_dir), s.donors(spark, sf_dir), 1


@query(f"""{_SCREEN} SELECT receptor_id, status, peptide, hla, evidence_type, reference_id, distance, alpha_distance, beta_distance, hla_status, donor_hla_status, panel_hla, panel_hla_status, gene_status, {_RANK} AS evidence_rank FROM y
UNION ALL SELECT receptor_id, 'Unresolved', NULL, NULL, 'none', NULL, NULL, NULL, NULL, 'unresolved', 'unresolved', NULL, NULL, 'unresolved', 1 FROM r WHERE receptor_id NOT IN (SELECT receptor_id FROM y)""")
def screen_evidence(spark, sf_dir):
    return screen(*_to_screen(spark, sf_dir)).select("receptor_id", "status", "peptide", "hla", "evidence_type", "reference_id", "distance", "alpha_distance", "beta_distance", "hla_status", "donor_hla_status", "panel_hla", "panel_hla_status", "gene_status", "evidence_rank")


@query(f"""{_SCREEN}, n AS (SELECT receptor_id, count(*) AS n FROM e WHERE panel_hla_status = 'incompatible' GROUP BY 1)
SELECT receptor_id, r.pairing_status, coalesce(n.n, 0) AS n_ruled_out FROM r LEFT JOIN n USING (receptor_id) WHERE receptor_id NOT IN (SELECT receptor_id FROM y)""")
def unresolved_receptors(spark, sf_dir):
    none = unmatched(*_to_screen(spark, sf_dir))
    return none.select("receptor_id", "pairing_status", F.coalesce(F.regexp_extract("reason", r"(\d+) comparisons", 1).try_cast("long"), F.lit(0).cast("long")).alias("n_ruled_out"))


# ---- ingestion --------------------------------------------------------------------------------------------------

_CELLS = f"""SELECT concat('o', cast(l_orderkey as string)) AS barcode, concat('d', cast(l_suppkey % 5 as string)) AS sample,
  case l_returnflag when 'A' then 'TRA' when 'R' then 'TRB' else 'IGH' end AS chain, case when l_linenumber = 7 then 'CASX' when l_linenumber = 6 then null else {cdr3('l_partkey', 89)} end AS cdr3,
  case l_linestatus when 'O' then 'True' else case when l_linenumber = 2 then 'F' else '' end end AS productive, case when l_discount > 0.08 then 'f' else 't' end AS high_confidence FROM lineitem"""


def _contigs(spark, sf_dir):
    rows = derived(spark, sf_dir, _CELLS, "lineitem").drop("sample")
    return numbered(rows).withColumn("donor_id", F.lit("d1"))


_CHAINS = duck(f"""WITH c AS ({_CELLS}), q AS (SELECT *, NOT coalesce(regexp_full_match(cdr3, '[ACDEFGHIKLMNPQRSTVWY]+'), true) AS amb, NOT coalesce(regexp_full_match(cdr3, 'C[A-Z*]*[FW]'), false) AS inc,
  CASE WHEN lower(productive) IN ('true', 't') THEN true WHEN lower(productive) IN ('false', 'f') THEN false END AS prod, high_confidence = 't' AS conf FROM c),
e AS (SELECT *, chain IN ('TRA', 'TRB') AND coalesce(prod, true) AND conf AND NOT amb AND NOT inc AS ok FROM q)""")
_STATUS = f"""{_CHAINS}, g AS (SELECT barcode, count(DISTINCT cdr3) FILTER (WHERE ok AND chain = 'TRA') AS na, count(DISTINCT cdr3) FILTER (WHERE ok AND chain = 'TRB') AS nb, bool_or(amb OR inc) AS unsafe, bool_or(NOT conf) AS low FROM e GROUP BY 1)
SELECT barcode AS cell_id, na, nb, CASE WHEN greatest(na, 1) * greatest(nb, 1) > 4 THEN 'excess_chains' WHEN na + nb = 0 AND low THEN 'excluded_quality' WHEN na + nb = 0 AND unsafe THEN 'unresolved_sequence'
  WHEN na + nb = 0 THEN 'no_productive_chains' WHEN na > 1 AND nb > 1 THEN 'ambiguous_pairing' WHEN na > 1 THEN 'dual_alpha' WHEN nb > 1 THEN 'dual_beta' WHEN na = 0 THEN 'single_beta' WHEN nb = 0 THEN 'single_alpha' ELSE 'paired' END AS pairing_status FROM g"""


def _chains(spark, sf_dir):
    return ingest.with_cell_key(ingest.long_chains(_contigs(spark, sf_dir), "10x"))


@query(_STATUS)
def pairing_status(spark, sf_dir):
    return ingest.candidate_pairs(_chains(spark, sf_dir), 4).select("cell_id", "na", "nb", "pairing_status").distinct()


@query(f"""{_CHAINS} SELECT code, n AS count FROM (SELECT count(*) FILTER (WHERE NOT prod) AS nonproductive, count(*) FILTER (WHERE prod IS NULL) AS productivity_unknown, count(*) FILTER (WHERE chain = 'IGH') AS unsupported_locus,
  count(*) FILTER (WHERE amb) AS sequence_ambiguous, count(*) FILTER (WHERE inc) AS junction_incomplete, count(*) FILTER (WHERE NOT conf) AS low_confidence, count(*) AS input_records FROM e) UNPIVOT (n FOR code IN (COLUMNS(*))) WHERE n > 0""")
def quality_counts(spark, sf_dir):
    chains = _chains(spark, sf_dir)
    pair_codes = ["excess_chains", "dual_alpha", "dual_beta", "ambiguous_pairing", "unpaired_airr", "multiple_paired_rows"]
    return ingest.quality(chains, ingest.candidate_pairs(chains)).filter(~F.col("code").isin(pair_codes)).select("code", "count")


@query("SELECT user_id, count(DISTINCT event_type) AS n_groups FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 2")
def cell_collisions(spark, sf_dir):
    return ingest.collisions(table(spark, sf_dir, "events"), "user_id", "event_type", 2)


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return ingest.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


_ID_PARTS = ["donor_id", "cdr3a", "cdr3b", "trav", "traj", "trbv", "trbj", "pairing_status", "unusable_chain_context"]


@query(duck(f"SELECT receptor_id AS customer, concat('tcr_', substr(sha256(concat({', '.join(f'''coalesce(cast(strlen({c}) as varchar) || ':' || {c}, '-1:')''' for c in _ID_PARTS)})), 1, 24)) AS receptor_id FROM ({s.RECEPTORS})"))
def receptor_identity(spark, sf_dir):
    return s.receptors(spark, sf_dir).select(F.col("receptor_id").alias("customer"), t.digest_id("tcr_", t.length_prefixed(*_ID_PARTS)).alias("receptor_id"))


@query(duck(f"""WITH p AS (SELECT {cdr3('c_custkey', 31)} AS a, {cdr3('c_custkey', 17)} AS b, c_nationkey, c_custkey FROM customer) SELECT count(DISTINCT c_custkey) AS cell_count, a AS cdr3a, b AS cdr3b, concat('d', cast(c_nationkey as varchar)) AS donor_id FROM p GROUP BY a, b, c_nationkey"""))
def receptors_collapsed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    wide = c.select(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("donor_id"), F.col("c_custkey").cast("string").alias("cell_id"), F.expr(cdr3("c_custkey", 31)).alias("cdr3a"), F.expr(cdr3("c_custkey", 17)).alias("cdr3b"), F.col("c_custkey").alias("source_row"))
    chains = ingest.with_cell_key(ingest.paired_chains(wide))
    return ingest.receptors_of(ingest.observed_pairs(chains))[0].select("donor_id", "cdr3a", "cdr3b", "cell_count")


_FLAWED = f"case p_partkey % 6 when 0 then null when 1 then concat('C', 'X', {cdr3('p_partkey')}) when 2 then substr({cdr3('p_partkey')}, 2, 9) when 3 then replace({cdr3('p_partkey')}, 'A', '*') when 4 then concat({cdr3('p_partkey')}, ' ') else {cdr3('p_partkey')} end"


@query(duck(f"""WITH j AS (SELECT p_partkey, {_FLAWED} AS seq FROM part) SELECT *, coalesce(regexp_full_match(seq, 'C[ACDEFGHIKLMNPQRSTVWY]+[FW]'), false) AS usable, NOT coalesce(regexp_full_match(seq, 'C[A-Z*]*[FW]'), false) AS incomplete,
  NOT coalesce(regexp_full_match(seq, '[ACDEFGHIKLMNPQRSTVWY]+'), true) AS ambiguous FROM j"""))
def junction_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FLAWED).alias("seq"))
    return p.select("*", t.usable_cdr3("seq").alias("usable"), t.junction_incomplete("seq").alias("incomplete"), t.sequence_ambiguous("seq").alias("ambiguous"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_id % 3 = 0 THEN false END AS flag FROM events")
def tristate_boolean(spark, sf_dir):
    spelled = F.expr("CASE WHEN event_type IN ('click', 'view') THEN ' True' WHEN event_id % 3 = 0 THEN 'f' ELSE '  ' END")
    return table(spark, sf_dir, "events").select("event_id", t.tristate(spelled).alias("flag"))


@query(r"SELECT doc_id, nullif(regexp_replace(regexp_replace(chr(9) || ' ' || text || ' ' || chr(10), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.clean(F.concat(F.lit("\t "), "text", F.lit(" \n"))).alias("cleaned"))


# ---- joins and sets ---------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT c_custkey, nullif(c_nationkey % 7, 0) AS k FROM customer), b AS (SELECT n_nationkey, nullif(n_nationkey % 7, 0) AS k FROM nation) SELECT c_custkey, n_nationkey FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey % 7, 0)").alias("k"))
    b = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("nullif(n_nationkey % 7, 0)").alias("k2"))
    return a.join(b, a["k"].eqNullSafe(b["k2"]), "left").select("c_custkey", "n_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query(duck(f"SELECT p_partkey, p.peptide, l.score, CASE WHEN l.peptide IS NULL THEN 'absent' WHEN l.score IS NULL THEN 'no value' ELSE 'found' END AS outcome FROM (SELECT p_partkey, {peptide('p_partkey')} AS peptide FROM part) p LEFT JOIN (SELECT {peptide('s_suppkey')} AS peptide, max(CASE WHEN s_suppkey % 41 < 20 THEN NULL ELSE s_suppkey % 41 END)::DOUBLE AS score FROM supplier GROUP BY 1) l USING (peptide)"))
def library_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(peptide("p_partkey")).alias("peptide"), F.lit("HLA-A*02:01").alias("hla"))
    library = table(spark, sf_dir, "supplier").groupBy(F.expr(peptide("s_suppkey")).alias("peptide"), F.lit("HLA-A*02:01").alias("hla")).agg(F.max(F.expr("CASE WHEN s_suppkey % 41 < 20 THEN NULL ELSE s_suppkey % 41 END")).alias("score"))
    found = pairs.library_lookup(p, library)
    outcome = F.when(F.col("status") == "PrecomputedScore", "found").when(F.col("reason").contains("isn't in"), "absent").otherwise("no value")
    return p.join(found, ["peptide", "hla"]).select("p_partkey", "peptide", "score", outcome.alias("outcome"))


@query("SELECT o_orderkey AS id, o_totalprice AS price, NULL AS balance FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def union_relaxed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return o.unionByName(c, allowMissingColumns=True)


@query(duck(f"SELECT donor_id, array_to_string(list_sort(list(DISTINCT hla)), ',') AS typing FROM ({s.DONORS}) GROUP BY 1"))
def donor_typing(spark, sf_dir):
    return s.donors(spark, sf_dir).groupBy("donor_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("hla"))).alias("typing"))


@query("WITH c AS (SELECT source, toxic AS label, count(*) AS n_cells FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY source) > 1 AS conflict FROM c")
def clone_label_conflict(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return pairs.clone_labels(both.select("source", F.col("toxic").alias("label")), "source")


# ---- vectors ----------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id AS ref_id, embedding::DOUBLE[] AS b FROM embeddings),
s AS (SELECT query_id, ref_id, list_cosine_similarity(a, b) AS x FROM q, r) SELECT query_id, ref_id, round(x, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, ref_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(knn.cosine_top_k(queries, e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector")), 10), "similarity")


@query("SELECT vec_id, abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) - 1) <= 1e-4 AS unit FROM embeddings")
def unit_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", knn.unit_norm("embedding").alias("unit"))


_EVEN = "array_cat(list_transform(e[1:32], lambda v: v / sqrt(2 * list_dot_product(e[1:32], e[1:32]))), list_transform(e[33:64], lambda v: v / sqrt(2 * list_dot_product(e[33:64], e[33:64]))))"
#: Each vector's reference, and for every third a second one of the same receptor; some name a molecule that isn't expressed.
_EMBEDDED = f"""SELECT vec_id, concat('f', cast(vec_id as string)) AS reference_id, {peptide('vec_id')} AS peptide, case when vec_id % 7 = 3 then 'HLA-A*02:01N' else {s.allele('vec_id')} end AS hla FROM embeddings
UNION ALL SELECT vec_id, concat('g', cast(vec_id as string)), {peptide('vec_id + 1')}, {s.allele('vec_id + 2')} FROM embeddings WHERE vec_id % 3 = 0"""


@query(duck(f"""WITH v AS (SELECT vec_id, {_EVEN} AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), r AS ({_EMBEDDED}), p AS ({s.PANEL}), d AS ({s.DONORS}),
c AS (SELECT r.*, p.hla AS panel_hla, CASE WHEN r.hla = p.hla THEN 'compatible' ELSE 'unresolved' END AS panel_hla_status FROM r JOIN p USING (peptide) WHERE coalesce(r.hla, '') <> 'HLA-A*02:01N' AND coalesce(r.hla = p.hla, true)),
n AS (SELECT q.vec_id AS q, g.vec_id AS g, list_dot_product(q.u, g.u) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, g.u) DESC, sha256(cast(g.vec_id as string))) AS k
  FROM v q JOIN v g ON q.vec_id % 100 = 0 AND g.vec_id IN (SELECT vec_id FROM c) QUALIFY k <= 10)
SELECT concat('q', cast(q as string)) AS receptor_id, reference_id, peptide, hla, panel_hla, panel_hla_status, k AS neighbor_rank, round(s, 6) AS cosine_similarity,
CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.donor_id = concat('d', cast(q // 100 % 25 as string)) AND d.hla = c.hla) THEN 'compatible' ELSE 'unresolved' END AS donor_hla_status FROM n JOIN c ON c.vec_id = n.g""").replace(" as string)", " as varchar)"))
def embedding_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    half = lambda start: F.slice("e", start, 32)
    even = lambda h: F.transform(h, lambda v: v / F.sqrt(2 * F.aggregate(h, F.lit(0.0), lambda a, x: a + x * x)))
    v = e.select("vec_id", F.concat(even(half(1)), even(half(33))).alias("vector"))
    queries = v.filter("vec_id % 100 = 0").select(F.expr("concat('q', vec_id)").alias("receptor_id"), F.expr("concat('d', vec_id div 100 % 25)").alias("donor_id"), "vector")
    told = derived(spark, sf_dir, _EMBEDDED, "embeddings").join(v, "vec_id").withColumns({"identity": F.sha2(F.col("vec_id").cast("string").cast("binary"), 256), "source": F.lit("x"), "evidence": F.lit("curated")})
    out = embedding.embedding_evidence(queries, told, s.panel(spark, sf_dir), s.donors(spark, sf_dir))
    return rounded(out.select("receptor_id", "reference_id", "peptide", "hla", "panel_hla", "panel_hla_status", "neighbor_rank", "cosine_similarity", "donor_hla_status"), "cosine_similarity")


# ---- molecules and genes ----------------------------------------------------------------------------------------


#: Names by the rules that they bring up, one a nation.
_MOLECULES = "HLA-B*35:01 HLA-B*35:03 HLA-B*35:01:02 HLA-B*35:01N HLA-B*35:01S HLA-B*35:01Q HLA-B*35:01L HLA-B*35:01:01G HLA-B*35:01P HLA-B*35 HLA-B*44 HLA-B*3501 HLA-C*35:01 HLA-C*04:01C HLA-DRB1*15:01 HLA-DRB1*15:01:01 HLA-DPB1*02:01 HLA-DRA*01:01 H-2-Kb H-2-Kd H-2-IAb HLA-A*02:01 HLA-A*02 HLA-DRB1*11:01A".split()
_NAMED = "case " + " ".join(f"when n_nationkey = {i} then '{m}'" for i, m in enumerate(_MOLECULES)) + " end"


@query(f"""WITH n AS (SELECT n_nationkey, {_NAMED} AS a FROM nation),
m AS (SELECT *, starts_with(a, 'H-2') AS mouse, regexp_extract(a, '^HLA-([A-Z0-9]+)[*]', 1) AS locus, string_split(regexp_extract(a, '[*]([0-9:]+)', 1), ':') AS f, regexp_extract(a, '[0-9]([A-Z])$', 1) AS mark FROM n),
p AS (SELECT x.n_nationkey AS l, y.n_nationkey AS r, x.a AS xa, y.a AS ya, x.mouse AS xm, y.mouse AS ym, x.locus AS xl, y.locus AS yl, x.f AS xf, y.f AS yf, x.mark || y.mark AS marks, least(2, len(x.f), len(y.f)) AS depth FROM m x, m y)
SELECT l, r, CASE WHEN xa IS NULL OR ya IS NULL THEN 'unresolved' WHEN xm <> ym THEN 'incompatible' WHEN xm THEN CASE WHEN xa = ya THEN 'compatible' ELSE 'incompatible' END
  WHEN regexp_matches(marks, '[NSC]') THEN 'incompatible' WHEN xl <> yl THEN 'incompatible' WHEN regexp_matches(marks, '[GP]') THEN 'unresolved'
  WHEN (len(xf) = 1 AND strlen(xf[1]) > 3) OR (len(yf) = 1 AND strlen(yf[1]) > 3) THEN 'unresolved' WHEN xf[1:depth] <> yf[1:depth] THEN 'incompatible' WHEN depth < 2 THEN 'unresolved'
  WHEN marks <> '' THEN 'unresolved' WHEN xl IN ('DRA', 'DQA1', 'DQB1', 'DPA1', 'DPB1') THEN 'unresolved' ELSE 'compatible' END AS status FROM p""")
def hla_compare(spark, sf_dir):
    n = derived(spark, sf_dir, f"SELECT n_nationkey, {_NAMED} AS a FROM nation", "nation")
    both = n.select(F.col("n_nationkey").alias("l"), F.col("a").alias("la")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("r"), F.col("a").alias("ra"))))  # 25 rows each
    return hla.compared(both, "la", "ra", "status", "reason").select("l", "r", "status")


@query(f"""WITH n AS (SELECT n_nationkey, {_NAMED} AS a FROM nation), m AS (SELECT *, regexp_extract(a, '^HLA-([A-Z0-9]+)[*]', 1) AS locus, string_split(regexp_extract(a, '[*]([0-9:]+)', 1), ':') AS f FROM n)
SELECT n_nationkey, a AS name, a IS NOT NULL AND (starts_with(a, 'H-2') OR (NOT regexp_matches(a, '[A-Z]$') AND len(f) = 2 AND strlen(f[1]) = 2 AND locus IN ('A', 'B', 'C'))) AS given FROM m""")
def model_molecules(spark, sf_dir):
    n = derived(spark, sf_dir, f"SELECT n_nationkey, {_NAMED} AS a FROM nation", "nation")
    return hla.normalized(n, "a", "name").select("n_nationkey", "name", (F.col("name").isNotNull() & F.col("name_abstains").isNull()).alias("given"))


@query(duck(f"WITH g AS (SELECT p_partkey, {s.gene('TRBV', 'p_partkey', 5)} AS a, {s.gene('TRBV', 'p_size', 5)} AS b FROM part) SELECT p_partkey, CASE WHEN a IS NULL OR b IS NULL THEN 'unresolved' WHEN a = b THEN 'compatible' ELSE 'conflict' END AS status FROM g"))
def gene_call_status(spark, sf_dir):
    g = derived(spark, sf_dir, f"SELECT p_partkey, {s.gene('TRBV', 'p_partkey', 5)} AS a, {s.gene('TRBV', 'p_size', 5)} AS b FROM part", "part")
    return g.select("p_partkey", genes.call_status("a", "b", "TRBV").alias("status"))


# ---- pairs, scores, backgrounds ---------------------------------------------------------------------------------

_READY = f"r.cdr3a IS NOT NULL AND r.cdr3b IS NOT NULL AND r.pairing_status = 'paired' AND {_U('r.cdr3a')} AND {_U('r.cdr3b')} AND trav IS NOT NULL AND traj IS NOT NULL AND trbv IS NOT NULL AND trbj IS NOT NULL"
_TEN_PEPTIDES = f"SELECT DISTINCT {peptide('r_regionkey')} AS peptide, {s.allele('r_regionkey')} AS hla FROM region"


#: Molecules of the panel, one a nation: those that a model takes come first.
_GIVEN = "HLA-A*02:01 HLA-B*07:02 HLA-C*07:01 HLA-DQA1*05:01/HLA-DQB1*02:01 HLA-DRA*01:01/HLA-DRB1*15:01".split()
_HELD_BACK = "HLA-A*02:01N HLA-A*02 HLA-A*02:01:01 HLA-A*02:01:01G HLA-A*02:01|HLA-A*02:02 HLA-DQA1*05:01 HLA-DRB1*15:01 HLA-B*07:02Q HLA-B*07:02P H-2-Kb nonsense".split()
_PANEL_NAMES = "case " + " ".join(f"when n_nationkey = {i} then '{m}'" for i, m in enumerate([*_GIVEN, *_HELD_BACK])) + " end"
_MIXED_PANEL = f"SELECT {peptide('n_nationkey')} AS peptide, {_PANEL_NAMES} AS hla FROM nation"


@query(duck(f"""WITH r AS ({s.RECEPTORS}), p AS (SELECT DISTINCT * FROM ({_MIXED_PANEL}))
SELECT receptor_id, peptide, CASE WHEN hla NOT IN ('H-2-Kb', 'nonsense') THEN hla END AS hla, coalesce(hla IN ({', '.join(f"'{m}'" for m in _GIVEN)}), false) AND {_READY} AS exported FROM r, p"""))
def cross_pairs(spark, sf_dir):
    out = pairs.export_pairs(s.receptors(spark, sf_dir), derived(spark, sf_dir, _MIXED_PANEL, "nation"), max_pairs=None)
    return out.select("receptor_id", "peptide", "hla", F.col("skip_reason").isNull().alias("exported"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 3) END AS score, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 <> 1 AS usable FROM events WHERE value IS NOT NULL")
def score_import(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    told = e.select("event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN 'NaN' WHEN event_id % 7 = 0 THEN ' ' ELSE cast(round(value, 3) as string) END").alias("text"), F.expr("CASE WHEN event_id % 3 = 1 THEN 'too long' END").alias("reason"))
    number = pairs.numeric_score("text")
    return told.select("event_id", number.alias("score"), (ranking.finite(number) & t.clean("reason").isNull()).alias("usable"))


def _background(spark, sf_dir):
    contexts = derived(spark, sf_dir, f"SELECT DISTINCT {s.allele('s_suppkey')} AS hla, cast(8 + s_suppkey % 3 as int) AS peptide_length FROM supplier WHERE s_suppkey % 5 <> 4", "supplier")
    return contexts


#: A context's text and its digest, as background.py has them; receptors are null here.
_DIGEST = lambda sampler, seed: f"sha256('{sampler}:{seed}:-1:' || strlen(hla) || ':' || hla || strlen(peptide_length::VARCHAR) || ':' || peptide_length)"
_DRAWS = "unnest(range(200)) AS n(number), unnest(range(1, peptide_length + 1)) AS q(position)"
_U32 = "('0x' || substr(md5(d || ':' || number || ':' || position), 1, 8))::BIGINT"


@query(duck(f"""WITH c AS (SELECT DISTINCT {s.allele('s_suppkey')} AS hla, cast(8 + s_suppkey % 3 as int) AS peptide_length FROM supplier WHERE s_suppkey % 5 <> 4), k AS (SELECT *, {_DIGEST('uniform', 7)} AS d FROM c),
x AS (SELECT *, substr('ACDEFGHIKLMNPQRSTVWY', 1 + {_U32} % 20, 1) AS residue FROM k, {_DRAWS})
SELECT NULL::VARCHAR AS receptor_id, hla, peptide_length::INT AS peptide_length, string_agg(residue, '' ORDER BY position) AS peptide, 'background_' || substr(d, 1, 24) || '_' || number AS background_id FROM x GROUP BY hla, peptide_length, d, number"""))
def uniform_background(spark, sf_dir):
    return background.random_panel(_background(spark, sf_dir), 200, seed=7)


@query(f"""{_EMPIRICAL}, f AS (SELECT hla, length AS peptide_length, position, amino_acid, frequency AS p FROM e WHERE hla IS NOT NULL),
k AS (SELECT *, {_DIGEST('profile', 7)} AS d FROM (SELECT DISTINCT hla, peptide_length FROM f)),
w AS (SELECT hla, peptide_length, position, list(p ORDER BY amino_acid) AS ps FROM f GROUP BY ALL),
x AS (SELECT k.*, number, position, {_U32} / 4294967296.0 AS u FROM k, {_DRAWS}),
y AS (SELECT x.*, 1 + len(list_filter(range(1, 20), lambda i: u >= list_sum(ps[1:i]) / list_sum(ps))) AS spot FROM x JOIN w USING (hla, peptide_length, position))
SELECT NULL::VARCHAR AS receptor_id, hla, peptide_length::INT AS peptide_length, string_agg(substr('ACDEFGHIKLMNPQRSTVWY', spot, 1), '' ORDER BY position) AS peptide, 'background_' || substr(d, 1, 24) || '_' || number AS background_id FROM y GROUP BY hla, peptide_length, d, number""")
def profile_background(spark, sf_dir):
    given = _empirical(spark, sf_dir).filter("hla IS NOT NULL").select("hla", F.col("length").alias("peptide_length"), "position", "amino_acid", F.col("frequency").alias("probability"))
    return background.profile_panel(given.select("hla", "peptide_length"), given, 200, seed=7, max_rows=1_000_000)


@query()
def pmhc_scores(spark, sf_dir):
    panel = derived(spark, sf_dir, f"SELECT {peptide('p_partkey')} AS peptide, {s.allele('p_partkey')} AS hla FROM part", "part")
    return rounded(scoring.score_pmhc(panel, scoring.StubScorer(), 100, max_rows=100_000), "score", "background_percentile")


@query()
def repertoire_scores(spark, sf_dir):
    out = pairs.export_pairs(s.receptors(spark, sf_dir), derived(spark, sf_dir, _TEN_PEPTIDES, "region"), max_pairs=10_000_000)
    return rounded(scoring.score_repertoire(out, scoring.StubScorer()), "score")


# ---- contracts, store, bridge, sinks ----------------------------------------------------------------------------

#: What a scorer hands back for events, with every fault, and what it was asked for.
_RETURNED = f"""SELECT concat('e', cast(event_id as string)) AS name, case when event_id % 97 = 0 then null else {peptide('event_id')} end AS peptide, coalesce({s.allele('event_id')}, 'none') AS hla,
  case when event_id % 11 = 0 then 'maybe' when event_id % 2 = 0 then ' True' else '0' end AS ok, case when event_id % 13 = 0 then 'x' when event_id % 5 = 0 then null when event_id % 7 = 0 then 'NaN' when event_id % 17 = 0 then '0.5' else cast(-(event_id % 9) as string) end AS score, event_id FROM events"""
_ASKED = "event_id % 10 <> 3"
_GOT = "event_id % 10 <> 4"


@query(duck(f"""WITH r AS ({_RETURNED}), g AS (SELECT *, lower(trim(ok)) AS f, TRY_CAST(score AS DOUBLE) AS v FROM r WHERE {_GOT} UNION ALL SELECT *, lower(trim(ok)), TRY_CAST(score AS DOUBLE) FROM r WHERE {_GOT} AND event_id % 1000 = 5)
SELECT 'name is missing' AS rule, count(*) FILTER (WHERE name IS NULL) AS n FROM g UNION ALL SELECT 'peptide is missing', count(*) FILTER (WHERE peptide IS NULL) FROM g UNION ALL SELECT 'hla is missing', count(*) FILTER (WHERE hla IS NULL) FROM g
UNION ALL SELECT 'the flag is neither true nor false', count(*) FILTER (WHERE f NOT IN ('true', '0')) FROM g UNION ALL SELECT 'the score isn''t a number', count(*) FILTER (WHERE score = 'x') FROM g
UNION ALL SELECT 'success without a log probability', count(*) FILTER (WHERE f = 'true' AND NOT coalesce(v <= 0 AND NOT isnan(v), false)) FROM g UNION ALL SELECT 'failure with a score', count(*) FILTER (WHERE f = '0' AND v IS NOT NULL AND NOT isnan(v)) FROM g
UNION ALL SELECT 'a row is missing', count(*) FROM r WHERE {_ASKED} AND NOT {_GOT} UNION ALL SELECT 'a row wasn''t asked for', count(*) FROM r WHERE {_GOT} AND NOT {_ASKED}
UNION ALL SELECT 'a row is repeated', count(*) FROM r WHERE {_GOT} AND {_ASKED} AND event_id % 1000 = 5"""))
def contract_audit(spark, sf_dir):
    r = derived(spark, sf_dir, _RETURNED, "events")
    got = r.filter(_GOT)
    return contracts.audit(got.union(got.filter("event_id % 1000 = 5")), contracts.score_contract(), r.filter(_ASKED))


_STORED = f"SELECT p_partkey, {peptide('p_partkey', 997)} AS peptide, {s.allele('p_partkey')} AS hla FROM part"


@query(duck(f"""WITH a AS (SELECT DISTINCT peptide, coalesce(hla, '') AS hla, p_partkey % 2 = 0 AS half FROM ({_STORED})), n AS (SELECT count(DISTINCT (peptide, hla)) FILTER (WHERE half) AS h, count(DISTINCT (peptide, hla)) AS w FROM a)
SELECT unnest([1, 2, 3, 4]) AS run, unnest([h, w, w, w]) AS asked, unnest([h, w - h, 0, w]) AS scored FROM n"""))
def score_reuse(spark, sf_dir):
    """Half of the pairs, all of them, all again, and all under another seed, each against the store of the runs before."""
    store = score_store.ScoreStore(spark, f"{staging_dir(spark)}/epiloom-{uuid.uuid4().hex}")
    rows = derived(spark, sf_dir, _STORED, "part")
    runs = [(rows.filter("p_partkey % 2 = 0"), 0), (rows, 0), (rows, 0), (rows, 1)]
    told = [store.score(df, scoring.StubScorer(seed), ["hla"], "stub", renew=True)[1] for df, seed in runs]
    return spark.createDataFrame([(i + 1, x["asked"], x["scored"]) for i, x in enumerate(told)], "run int, asked long, scored long")


_BALANCES = "SELECT case when c_custkey % 61 = 0 then null when c_custkey % 50 = 7 then c_custkey - 1 else c_custkey end AS cell, c_nationkey % 2 AS donor, c_acctbal AS balance FROM customer"
_CELL_LABELS = "SELECT case when c_custkey % 40 = 3 then c_custkey + 1 when c_custkey % 9 = 5 then c_custkey + 100000000 else c_custkey end AS cell, c_nationkey % 2 AS donor, c_mktsegment AS label FROM customer WHERE c_custkey % 9 <> 2"


@query(f"""WITH a AS (SELECT cell, donor, count(*) AS n, min(balance) AS b FROM ({_BALANCES}) GROUP BY ALL), z AS (SELECT cell, donor, count(*) AS m, min(label) AS l FROM ({_CELL_LABELS}) GROUP BY ALL)
SELECT coalesce(a.cell, z.cell) AS cell, coalesce(a.donor, z.donor) AS donor, coalesce(n, 0) AS n_left, coalesce(m, 0) AS n_right, CASE WHEN n = 1 THEN b END AS balance, CASE WHEN m = 1 THEN l END AS label,
  CASE WHEN coalesce(a.cell, z.cell) IS NULL THEN 'no identity' WHEN n > 1 OR m > 1 THEN 'multiple' WHEN m IS NULL THEN 'left only' WHEN n IS NULL THEN 'right only' ELSE 'matched' END AS match
FROM a FULL JOIN z ON a.cell IS NOT DISTINCT FROM z.cell AND a.donor IS NOT DISTINCT FROM z.donor""")
def dataset_bridge(spark, sf_dir):
    met = bridge.conserved(derived(spark, sf_dir, _BALANCES, "customer"), derived(spark, sf_dir, _CELL_LABELS, "customer"), ["cell", "donor"])
    return met.select("cell", "donor", "match", "n_left", "n_right", F.col("left.balance").alias("balance"), F.col("right.label").alias("label"))


@query("""WITH v AS (SELECT 'model' AS "column", 'm1' AS v FROM orders UNION ALL SELECT 'metric', CASE WHEN o_orderkey % 1000 <> 3 THEN 'pll' END FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders)
SELECT "column", CASE WHEN count(DISTINCT v) = 1 AND count(v) = count(*) THEN min(v) END AS value, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' WHEN count(v) < count(*) THEN 'missing' ELSE 'one' END AS status FROM v GROUP BY 1""")
def provenance_fold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("m1").alias("model"), F.expr("CASE WHEN o_orderkey % 1000 <> 3 THEN 'pll' END").alias("metric"), F.col("o_orderstatus").alias("status"))
    return bridge.provenance(o, ["model", "metric", "status"])


#: Nine rows of ten belong to one context.
_LOADED = f"SELECT DISTINCT case when p_partkey % 10 = 0 then 'cold' else 'hot' end AS context, {peptide('p_partkey', 100003)} AS peptide FROM part"


@query(duck(f"""WITH r AS ({_LOADED}), k AS (SELECT *, ('0x' || substr(md5(peptide), 1, 4))::BIGINT % 16 AS salt FROM r),
c AS (SELECT *, coalesce(sum(length(peptide)) OVER (PARTITION BY context, salt ORDER BY length(peptide), peptide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT context, peptide, salt || '-' || (before // 151)::BIGINT AS batch FROM c"""))
def score_batches(spark, sf_dir):
    return scoring.batched(derived(spark, sf_dir, _LOADED, "part"), ["context"], "peptide", budget=200)


def _calls(prefix: str, key: str) -> str:
    """Reported and used calls: as they are, padded, with another allele, another gene, or untold."""
    base = f"concat('{prefix}', cast(1 + {key} % 9 as string), '-', cast(1 + {key} % 3 as string))"
    reported = f"case when {key} % 4 = 0 then concat({base}, '*01') when {key} % 7 = 0 then concat('{prefix}0', cast(1 + {key} % 9 as string), '-0', cast(1 + {key} % 3 as string)) when {key} % 31 = 0 then null else {base} end"
    used = f"case when {key} % 29 = 0 then ' ' when {key} % 37 = 0 then null when {key} % 12 = 0 then concat({base}, '*02') when {key} % 5 = 0 then {base} when {key} % 23 = 0 then '{prefix}99*01' else concat({base}, '*01') end"
    return f"{reported} AS {prefix.lower()}, {used} AS recon_{prefix.lower()}"


_RECON = f"SELECT {_calls('TRAV', 'p_partkey')}, {_calls('TRAJ', '(p_partkey + 5)')}, {_calls('TRBV', '(p_partkey * 3)')}, {_calls('TRBJ', '(p_partkey * 7 + 1)')} FROM part"
_PLAIN = lambda c: f"regexp_replace(regexp_replace({c}, '^(TR[AB][VJ])0+([0-9])', '\\1\\2'), '-0+([0-9])', '-\\1', 'g')"
_ALL_GENES = ["trav", "traj", "trbv", "trbj"]
_RESOLVED = "CASE WHEN differs THEN 'inferred_gene_choice' WHEN untold THEN 'unreported' WHEN bare THEN 'alleles_unspecified' WHEN spelled THEN 'nomenclature_normalized' ELSE 'reported_match' END"


@query(duck(f"""WITH r AS (SELECT row_number() OVER () AS id, * FROM ({_RECON})),
e AS ({' UNION ALL '.join(f"SELECT id, '{g}' AS gene, {g} AS call, recon_{g} AS used FROM r" for g in _ALL_GENES)}),
f AS (SELECT *, trim(coalesce(used, '')) = '' AS untold, NOT coalesce(contains(call, '*'), false) AS bare,
  trim(coalesce(used, '')) <> '' AND coalesce({_PLAIN('call')} <> CASE WHEN contains(call, '*') THEN {_PLAIN('used')} ELSE string_split({_PLAIN('used')}, '*')[1] END, false) AS differs FROM e),
g AS (SELECT *, NOT untold AND NOT differs AND coalesce(call <> used, false) AS spelled FROM f),
w AS (SELECT bool_or(differs) AS differs, bool_or(untold) AS untold, bool_or(bare) AS bare, bool_or(spelled) AS spelled FROM g GROUP BY id)
SELECT gene, {_RESOLVED} AS status, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'all', {_RESOLVED}, count(*) FROM w GROUP BY ALL"""))
def gene_resolution_audit(spark, sf_dir):
    return genes.resolution_audit(derived(spark, sf_dir, _RECON, "part"))


_EVIDENCE = """SELECT o_custkey AS receptor_id, case when o_orderstatus = 'F' then 'Candidate' else 'Unresolved' end AS status, case when o_orderstatus = 'P' then 'none' else 'exact_paired' end AS evidence_type,
  row_number() OVER (PARTITION BY o_custkey ORDER BY case when o_orderstatus = 'F' then 0 else 1 end, o_orderkey) AS evidence_rank FROM orders"""


@query(f"""WITH e AS ({_EVIDENCE}), c AS (SELECT count(*) AS evidence_rows, count(*) FILTER (WHERE status = 'Candidate') AS candidate_rows, count(*) FILTER (WHERE status <> 'Candidate') AS unresolved_rows, count(DISTINCT receptor_id) AS receptors,
  count(DISTINCT receptor_id) FILTER (WHERE status = 'Candidate') AS receptors_with_candidates, count(*) FILTER (WHERE evidence_rank = 1 AND evidence_type = 'none') AS receptors_without_evidence FROM e)
SELECT counter, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME counter VALUE n)""")
def sink_summary(spark, sf_dir):
    return sink.summary(derived(spark, sf_dir, _EVIDENCE, "orders"), sink.evidence_counters())


_ROUTED = f"SELECT {peptide('p_partkey', 997)} AS peptide, case p_partkey % 6 when 0 then 'HLA-A*02:01' when 1 then 'HLA-B*07:02' when 2 then 'HLA-DQA1*05:01/HLA-DQB1*02:01' when 3 then 'HLA-A*02' when 4 then 'HLA-C*07:01N' end AS hla, case when p_partkey % 8 = 0 then null else 1.0 / (1 + p_partkey % 8) end AS score FROM part"


@query(duck(f"""WITH r AS (SELECT *, CASE WHEN hla IN ('HLA-A*02:01', 'HLA-B*07:02') THEN 'class_i' WHEN contains(hla, '/') THEN 'class_ii' END AS predictor FROM ({_ROUTED})),
q AS (SELECT predictor, CASE WHEN predictor IS NULL THEN 'unrouted' WHEN NOT length(peptide) BETWEEN CASE predictor WHEN 'class_i' THEN 9 ELSE 10 END AND 15 THEN 'unsupported_length' WHEN hla = 'HLA-B*07:02' THEN 'no_model' WHEN score IS NULL THEN 'failed_score' ELSE 'predicted' END AS route FROM r)
SELECT predictor, count(predictor) AS routed, {', '.join(f"count(*) FILTER (WHERE route = '{x}') AS {x}" for x in sink.ROUTES)} FROM q GROUP BY 1"""))
def routing_counters(spark, sf_dir):
    models = spark.createDataFrame([("class_i", "HLA-A*02:01"), ("class_ii", "HLA-DQA1*05:01/HLA-DQB1*02:01")], "predictor string, hla string")
    return sink.routing_counters(sink.routes(derived(spark, sf_dir, _ROUTED, "part"), models, {"class_i": (9, 15), "class_ii": (10, 15)}))
