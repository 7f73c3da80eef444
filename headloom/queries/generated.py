"""Many generated header lists, whose SQL reads the header strings.

A line of ``LINES`` is text that Spark and SQL both evaluate, so both start from the same strings and nothing is known
by hand about what they hold; orders give the numbers, customers the sites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.operators import counters, findings, recipes, transition
from headloom.plans.enrich import enrich

CRAWL_TS = 1782728294.0
#: column -> (header, its value from n, or null where the header is absent).
LINES = {
    "vary": ("vary", "concat_ws(',', CASE WHEN n % 3 = 0 THEN 'Accept-Encoding' END, CASE WHEN n % 5 = 0 THEN ' User-Agent' END, CASE WHEN n % 7 = 0 THEN 'cookie ' END, CASE WHEN n % 11 = 0 THEN ' * ' END, CASE WHEN n % 13 = 0 THEN 'ACCEPT-ENCODING' END)"),
    "vary2": ("vary", "CASE WHEN n % 6 = 1 THEN 'X-T' || CAST(n % 4 AS STRING) || ',,Cookie' END"),
    "cc": (
        "cache-control",
        "concat_ws(', ', CASE WHEN n % 2 = 0 THEN 'Max-Age=' || CAST(n * 7919 % CASE WHEN n % 3 = 0 THEN 700 ELSE 400000000 END AS STRING) END, CASE WHEN n % 3 = 0 THEN 'no-store' END, CASE WHEN n % 5 = 1 THEN 's-maxage=' || CAST(n * 31 % 100000 AS STRING) END, CASE WHEN n % 7 = 2 THEN 'Public' END, CASE WHEN n % 4 = 3 THEN 'no-cache' END)",
    ),
    "hsts": ("strict-transport-security", "CASE WHEN n % 4 = 1 THEN 'max-age=' || CAST(n * 104729 % 70000000 AS STRING) || CASE WHEN n % 3 = 0 THEN '; includeSubDomains' ELSE '' END END"),
    "age": ("age", "CASE WHEN n % 9 = 4 THEN CAST(n % 5000 AS STRING) END"),
    "pragma": ("pragma", "CASE WHEN n % 9 = 0 THEN 'x, No-Cache' END"),
    "xfo": ("x-frame-options", "CASE WHEN n % 8 = 0 THEN 'DENY' END"),
    "csp": ("content-security-policy", "CASE WHEN n % 6 = 0 THEN 'default-src ''self''; Frame-Ancestors ''none''' WHEN n % 6 = 1 THEN 'img-src *' END"),
    "old_reports": ("report-to", "CASE WHEN n % 10 = 0 THEN '{}' END"),
    "new_reports": ("reporting-endpoints", "CASE WHEN n % 15 = 0 THEN 'd=\"x\"' END"),
    "xss": ("x-xss-protection", "CASE WHEN n % 12 = 5 THEN '0' END"),
}
_EACH = ", ".join(f"{made} AS {c}" for c, (_, made) in LINES.items())
_BASE = f"WITH g AS (SELECT n, site, {_EACH} FROM (SELECT o_orderkey AS n, 's' || CAST(o_custkey AS STRING) AS site FROM orders)),\n"
_BUCKET = (
    "CASE WHEN x < 0 THEN 'negative' WHEN x = 0 THEN '0' WHEN x < 60 THEN '<1 min' WHEN x < 600 THEN '1-10 min' WHEN x < 3600 THEN '10-60 min' WHEN x < 86400 THEN '1-24 hours' "
    "WHEN x < 604800 THEN '1-7 days' WHEN x < 2592000 THEN '7-30 days' WHEN x < 31536000 THEN '30-365 days' WHEN x < 315360000 THEN '1-10 years' ELSE '>10 years' END"
)
_MEMBERS = "t AS (SELECT DISTINCT n, site, lower(trim(x)) AS token FROM (SELECT n, site, unnest(string_split(concat_ws(',', {lines}), ',')) AS x FROM g) WHERE trim(x) <> '')"
_RECIPE = "SELECT recipe, count(*) AS occ, count(DISTINCT site) AS sites FROM (SELECT n, site, string_agg(token, ', ' ORDER BY token) AS recipe FROM ({tokens}) GROUP BY n, site) GROUP BY recipe"
_VARY = _BASE + _MEMBERS.format(lines="vary, vary2") + "\n"
_CC = _BASE + _MEMBERS.format(lines="cc") + "\n"
_HAS = "coalesce({}, false)".format


def _pair(name: str, old: str, new: str) -> str:
    return f"SELECT '{name}' AS pair, {_HAS(old)} AS o, {_HAS(new)} AS w FROM g"


_PAIRS = " UNION ALL ".join([
    _pair("frame_options", "xfo IS NOT NULL", "csp ILIKE '%frame-ancestors%'"),
    _pair("reporting", "old_reports IS NOT NULL", "new_reports IS NOT NULL"),
    _pair("expiry", "false", "regexp_matches(cc, '(?i)(^|, )max-age=')"),
    _pair("permissions_policy", "false", "false"),
    _pair("no_cache", "pragma ILIKE '%no-cache%'", "regexp_matches(cc, '(^|, )no-cache')"),
    _pair("xss_protection", "xss IS NOT NULL", "false"),
])


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("site"))
    lines = [F.when(F.expr(made).isNotNull(), F.struct(F.lit(name).alias("name"), F.expr(made).alias("value"))) for name, made in LINES.values()]
    url = F.concat(F.lit("http://"), F.col("site"), F.lit("/"))
    rows = numbers.select(F.col("n").alias("resp_id"), url.alias("url"), "site", F.lit(CRAWL_TS).alias("crawl_ts"), F.array_compact(F.array(*lines)).alias("headers"))
    return enrich(rows)


_NOTES = ["HSTS_VALID", "HSTS_NO_SUBDOMAINS", "HSTS_SHORT_MAX_AGE", "VARY_ASTERISK"]


def _some_notes(e: DataFrame) -> DataFrame:
    """The findings whose rules the SQL restates."""
    return findings.note_counts(e).filter(F.col("note_id").isin(_NOTES)).select("note_id", "occ", "sites")


_ALL: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "generated_headers": (
        counters.field_counts,
        _BASE + "h AS (" + " UNION ALL ".join(f"SELECT '{name}' AS name FROM g WHERE {c} IS NOT NULL" for c, (name, _) in LINES.items()) + ") SELECT name, count(*) AS occ FROM h GROUP BY name",
    ),
    "generated_vary": (recipes.vary_recipes, _VARY + _RECIPE.format(tokens="SELECT * FROM t")),
    "generated_vary_tokens": (recipes.vary_marginals, _VARY + "SELECT token, count(*) AS occ, count(DISTINCT site) AS sites FROM t WHERE token <> '*' GROUP BY token"),
    "generated_cc": (recipes.cc_recipes, _CC + _RECIPE.format(tokens="SELECT DISTINCT n, site, regexp_replace(token, '=.*', '=N') AS token FROM t")),
    "generated_lifetimes": (
        counters.value_histograms,
        _BASE
        + "m AS (SELECT regexp_extract(lower(cc), '(^|, )max-age=([0-9]+)', 2) AS a, regexp_extract(cc, 's-maxage=([0-9]+)', 1) AS s, regexp_extract(hsts, 'max-age=([0-9]+)', 1) AS h, age FROM g),\n"
        + "l AS (SELECT 'cache_control_max_age' AS histogram, a AS x FROM m UNION ALL SELECT 'freshness_lifetime', a FROM m UNION ALL SELECT 'cache_control_s_maxage', s FROM m UNION ALL SELECT 'hsts_max_age', h FROM m UNION ALL SELECT 'age', age FROM m)\n"
        + f"SELECT histogram, {_BUCKET} AS bucket, count(*) AS occ FROM (SELECT histogram, try_cast(x AS BIGINT) AS x FROM l) WHERE x IS NOT NULL GROUP BY 1, 2",
    ),
    "generated_transitions": (transition.counts, _BASE + f"p AS ({_PAIRS}) SELECT pair, CASE WHEN o AND w THEN 'both' WHEN w THEN 'modern_only' WHEN o THEN 'legacy_only' ELSE 'neither' END AS category, count(*) AS occ FROM p GROUP BY 1, 2"),
    "generated_notes": (
        _some_notes,
        _BASE
        + "f AS (SELECT 'HSTS_VALID' AS note_id, site FROM g WHERE hsts IS NOT NULL UNION ALL SELECT 'HSTS_NO_SUBDOMAINS', site FROM g WHERE hsts NOT LIKE '%includeSubDomains%'\n"
        + " UNION ALL SELECT 'HSTS_SHORT_MAX_AGE', site FROM g WHERE try_cast(regexp_extract(hsts, 'max-age=([0-9]+)', 1) AS BIGINT) < 180 * 86400 UNION ALL SELECT 'VARY_ASTERISK', site FROM g WHERE vary LIKE '%*%')\n"
        + "SELECT note_id, count(*) AS occ, count(DISTINCT site) AS sites FROM f GROUP BY note_id",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, made=made: made(generated(s, d))) for name, (made, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
