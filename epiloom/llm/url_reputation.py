"""Operator 7: empirical-Bayes host reputation for URL filtering (DataFrame operations only).

Each labelled page is an outcome of its host: good (1) or bad (0).  Rates are
shrunk down the tree all -> suffix -> registered domain -> host by
beta-binomial priors.  A level's prior mean is its parent's posterior mean;
its strength (pseudo-outcomes) is estimated from all groups of the level by
the method of moments, between `weakest` and `strongest`.  A host's verdict is
"allow" when a lower bound of its posterior, mean - z * deviation, reaches
`least`; a host without outcomes has its parents' posterior as its own.  A
rule that fits the URL decides before the reputation does.

Defined results: a null url or one without :// has host and path "" and shares
the reputation of host "" (suffix and domain are "" too); a null page_id stays
null; labels of pages that don't exist, null labels and labels whose page_id
is null are no outcomes; several labels of one page are several outcomes;
repeated pages are repeated rows and count as often; with no outcomes at all
the prior is `unlabelled` and verdicts follow from it.  Extra columns aren't read.

Reputation goes by the site: the host without user and port.  A suffix is the
site's last label, or the last two where `suffixes` lists them (a parameter; the
default holds some common ones); a registered domain is one label more.  A site
of digits and dots is an address, its own domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (action, host, path): rules of production.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
Z, LEAST, UNLABELLED, WEAKEST, STRONGEST = 1.645, 0.75, 0.5, 2.0, 1000.0
#: Suffixes of two labels under which domains are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ac.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, site, domain, suffix."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    cut = pages.select(F.col("page_id"), F.coalesce(rest, F.lit("")).alias("rest"))
    cut = cut.select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"\A[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"),
    )
    cut = cut.withColumn("site", F.regexp_replace(F.regexp_replace("host", r"\A.*@", ""), r":[0-9]*\z", ""))
    labels = F.when(F.col("site").rlike(r"\A[0-9.]+\z"), 99).when(F.substring_index("site", ".", -2).isin(*suffixes), 2).otherwise(1)
    last = lambda n: F.array_join(F.slice(F.split("site", r"\."), F.greatest(F.lit(1), F.size(F.split("site", r"\.")) - n + 1), n), ".")
    return cut.withColumn("labels", labels).select("page_id", "host", "path", "site", last(F.col("labels") + 1).alias("domain"), last(F.col("labels")).alias("suffix"))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and action; both null if none fits.  Equal lengths: the earlier in `rules`."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, action = F.when(fits, F.lit(host + path)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _level(below: DataFrame, key: list[str], parent: DataFrame | None, parent_key: list[str]) -> DataFrame:
    """Posterior (alpha, beta, mean) of each group of a level; below has key..., n, k."""
    if parent is None:
        g = below.crossJoin(F.broadcast(below.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(UNLABELLED)).alias("up"))))  # one row
    else:
        g = below.join(parent.select(*parent_key, F.col("mean").alias("up")), parent_key)
    # method of moments: variance of rates about the parent's mean, beyond the binomial's own
    p, own = F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.col("up") * (1 - F.col("up"))
    moments = g.agg(
        F.sum(F.col("n") * F.pow(p - F.col("up"), 2)).alias("seen"), F.sum(F.when(F.col("n") > 0, own)).alias("bound"), F.sum(F.when(F.col("n") > 0, (F.col("n") - 1) * own)).alias("room")
    )
    rho = (F.col("seen") - F.col("bound")) / F.nullif(F.col("room"), F.lit(0.0))
    strength = F.when(rho > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / rho - 1))).otherwise(F.lit(STRONGEST))
    g = g.crossJoin(F.broadcast(moments.select(strength.alias("m"))))  # one row
    g = g.withColumns({"alpha": F.col("k") + F.col("m") * F.col("up"), "beta": F.col("n") - F.col("k") + F.col("m") * (1 - F.col("up"))})
    return g.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def reputations(cut: DataFrame, outcomes: DataFrame) -> DataFrame:
    """site, domain, suffix, n, k, mean, bound of every site in cut (page_id, site, domain, suffix); outcomes: page_id, good."""
    seen = outcomes.filter(F.col("page_id").isNotNull() & F.col("good").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    of_page = cut.select("page_id", "site", "domain", "suffix").join(seen, "page_id", "left")
    # written, as the levels below read them several times
    hosts = written(of_page.groupBy("site", "domain", "suffix").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = _level(suffixes, ["suffix"], None, [])
    d = _level(domains, ["domain", "suffix"], s, ["suffix"])
    h = _level(hosts, ["site", "domain", "suffix"], d, ["domain", "suffix"])
    a, b = F.col("alpha"), F.col("beta")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("site", "domain", "suffix", "n", "k", "mean", (F.col("mean") - Z * deviation).alias("bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bound of each row of pages (page_id, url); outcomes: page_id, good (1 or 0)."""
    cut = parts(pages, suffixes)
    known = reputations(cut, outcomes).select("site", "bound")
    text, action = rule_of(rules)
    told = cut.join(known, "site")  # one row a site; a hot site's pages are split by the skew join
    verdict = F.coalesce(action, F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block")))
    return told.select("page_id", "host", "path", text.alias("rule"), verdict.alias("verdict"), F.round("bound", 6).alias("bound"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """The labels table read as outcomes of the pages with the same number: good when of quality and not toxic."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when((F.col("quality") == 0) | (F.col("toxic") == 1), 0)
    return labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))


def _sql_level(name: str, source: str, keys: str, parent: str | None, using: str) -> str:
    up = f"SELECT t.*, p.mean AS up FROM {source} t JOIN {parent} p USING ({using})" if parent else f"SELECT t.*, coalesce((SELECT sum(k) / nullif(sum(n), 0) FROM {source}), {UNLABELLED}) AS up FROM {source} t"
    return f"""{name}_g AS ({up}),
{name}_r AS (SELECT (sum(n * (k / nullif(n, 0) - up) ** 2) - sum(CASE WHEN n > 0 THEN up * (1 - up) END)) / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * up * (1 - up) END), 0) AS rho FROM {name}_g),
{name}_m AS (SELECT CASE WHEN rho > 0 THEN least({STRONGEST}, greatest({WEAKEST}, 1 / rho - 1)) ELSE {STRONGEST} END AS m FROM {name}_r),
{name} AS (SELECT {keys}, k + m * up AS alpha, n - k + m * (1 - up) AS beta, (k + m * up) / (n + m) AS mean FROM {name}_g, {name}_m)"""


_RULE_CASES = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, a) for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
b2 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM b),
b3 AS (SELECT *, string_split(site, '.') AS ls, CASE WHEN regexp_full_match(site, '[0-9.]+') THEN 99 WHEN array_to_string(string_split(site, '.')[-2:], '.') IN ('{"', '".join(SUFFIXES)}') THEN 2 ELSE 1 END AS m FROM b2),
c AS (SELECT *, array_to_string(ls[-least(len(ls), m + 1):], '.') AS domain, array_to_string(ls[-least(len(ls), m):], '.') AS suffix FROM b3),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS k FROM labels
  WHERE doc_id IS NOT NULL AND ((quality = 1 AND toxic = 0) OR quality = 0 OR toxic = 1) GROUP BY 1),
hs AS (SELECT site, domain, suffix, coalesce(sum(o.n), 0)::DOUBLE AS n, coalesce(sum(o.k), 0)::DOUBLE AS k FROM c LEFT JOIN o USING (page_id) GROUP BY ALL),
ds AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hs GROUP BY ALL),
ss AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM ds GROUP BY ALL),
{_sql_level("s", "ss", "suffix", None, "")},
{_sql_level("d", "ds", "domain, suffix", "s", "suffix")},
{_sql_level("h", "hs", "site", "d", "domain, suffix")},
e AS (SELECT site, round(mean - {Z} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))), 6) AS bound FROM h)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in _RULE_CASES)} END AS rule,
  CASE {" ".join(f"WHEN {w} THEN '{a}'" for w, _, a in _RULE_CASES)} WHEN bound >= {LEAST} THEN 'allow' ELSE 'block' END AS verdict, bound
FROM c JOIN e USING (site)
"""
