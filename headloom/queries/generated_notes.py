"""Findings of generated header lists: SQL restates the rules and reads the same header strings.

``LINES`` is evaluated by both sides, as in ``generated``; one column is one header line. A rule of SQL gives a row for
each time it fires.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom import config
from headloom.functions import structured
from headloom.operators import findings
from headloom.plans import rules
from headloom.plans.enrich import enrich

CRAWL_TS = 1782728294.0
TASKS_A_CORE = 4


def _when(*cases: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases) + " END"


def _joined(by: str, *parts: str) -> str:
    return f"concat_ws('{by}', {', '.join(parts)})"


def _or_none(made: str) -> str:
    return f"nullif({made}, '')"


_N = "CAST({} AS STRING)".format
#: column -> (header, its value from n, or null where the header is absent).
LINES = {
    "p3p": ("p3p", _when(("n % 7 = 0", "'CP=x'"))),
    "pragma": ("pragma", _when(("n % 9 = 0", "'no-cache'"))),
    "cookie": ("cookie", _when(("n % 10 = 3", "'x=1'"))),
    "date": ("date", _when(("n % 5 = 0", f"'Mon, 29 Jun 2026 10:18:' || lpad({_N('n % 60')}, 2, '0') || ' GMT'"), ("n % 5 = 1", f"'yesterday ' || {_N('n % 3')}"), ("n % 5 = 2", "'2026-06-29T10:18:14Z'"))),
    "expires": ("expires", _when(("n % 6 = 0", "'0'"), ("n % 6 = 1", "'Tue, 30 Jun 2026 10:18:14 GMT'"))),
    "age": ("age", _when(("n % 5 = 0", _N("n % 100")), ("n % 5 = 1", "'soon'"))),
    "age2": ("age", _when(("n % 20 = 0", "' 5 '"), ("n % 20 = 1", "'-5'"))),
    "clen": ("content-length", _when(("n % 6 = 0", _N("n")), ("n % 6 = 1", f"{_N('n')} || ' bytes'"))),
    "big": ("x-big", _when(("n % 25 = 0", "repeat('y', CAST(8165 + n % 40 AS INT))"))),
    "name": ("bad name", _when(("n % 30 = 4", "'v'"))),
    "xcto": ("x-content-type-options", _when(("n % 4 = 0", "'nosniff'"), ("n % 4 = 1", "' NoSniff '"), ("n % 12 = 2", "'no'"))),
    "xfo": ("x-frame-options", _when(("n % 8 = 0", "'deny'"), ("n % 8 = 1", "'SameOrigin'"), ("n % 8 = 2", "'ALLOW-FROM x'"))),
    "ctype": ("content-type", _when(("n % 3 = 0", "'Text/Plain; charset=x'"), ("n % 3 = 1", "'text/html'"))),
    "link": ("link", _when(("n % 4 = 2", "'<x>; rel=canonical'"), ("n % 4 = 3", "'<x>; rel=next'"))),
    "vary": ("vary", _or_none(_joined(",", *(_when((f"n % {k} = 0", f"'{v}'")) for k, v in ((2, "accept"), (3, " Cookie"), (5, "origin "), (4, "user-agent"), (6, "x-a"), (7, "x-b"), (9, " * "))), "''"))),
    "cc": (
        "cache-control",
        _or_none(_joined(
            ",",
            _when(("n % 2 = 0", f"'Max-Age=' || {_N('n % 5000')}")), _when(("n % 3 = 0", "' no-store'")), _when(("n % 5 = 0", "'public '")), _when(("n % 7 = 0", "'max-age=soon'")),
            _when(("n % 11 = 0", "'private=\"a, max-age=5, b\"'")), _when(("n % 13 = 0", "'max-stale=5, only-if-cached'")), _when(("n % 17 = 0", "'s-maxage'")), _when(("n % 19 = 0", "'PUBLIC'")),
        )),
    ),
    "hsts": ("strict-transport-security", _when(("n % 4 = 1", f"'max-age=' || {_N('n * 104729 % 70000000')} || {_when(('n % 3 = 0', chr(39) + '; includeSubDomains' + chr(39)), ('n % 3 > 0', chr(39) * 2))}"), ("n % 28 = 2", "'preload'"))),
    "csp": ("content-security-policy", _when(("n % 6 = 0", "'default-src ''self'' ''Unsafe-Inline'''"), ("n % 6 = 1", "'img-src *'"), ("n % 6 = 2", "'script-src ''unsafe-eval'''"))),
    "csp2": ("content-security-policy", _when(("n % 10 = 0", "'script-src ''unsafe-eval'' ''unsafe-inline'''"))),
    "corp": ("cross-origin-resource-policy", _when(("n % 9 = 1", "'same-site'"), ("n % 9 = 2", "' Cross-Origin'"), ("n % 9 = 3", "'anything'"))),
    "sc": (
        "set-cookie",
        _when(("n % 3 = 1", f"'a=' || repeat('v', CAST(n % 9 * 600 AS INT)) || '; Max-Age=' || {_N('n * 7919 % 90000000')} || {_when(('n % 2 = 0', chr(39) + '; Path=/; HttpOnly' + chr(39)), ('n % 2 = 1', chr(39) + '; Foo; Bar=1 ;; SameSite=Lax' + chr(39)))}")),
    ),
    "sc2": ("set-cookie", _when(("n % 4 = 2", "'b=2; Priority=High; Max-Age=-5'"))),
    "pp": (
        "permissions-policy",
        _or_none(_joined(
            ", ",
            _when(("n % 2 = 0", "'camera=()'")), _when(("n % 3 = 0", "'geolocation=(self \"https://a.example, b\")'")), _when(("n % 5 = 0", "'camera=*'")), _when(("n % 7 = 0", "'Usb=()'")), _when(("n % 8 = 0", "'a;b=\"camera=1, \"'")),
            _when(("n % 11 = 0", "'usb=(self'")), _when(("n % 13 = 0", "'b=1.25;c'")),
        )),
    ),
    "prio": ("priority", _when(("n % 12 = 0", "'u=1, i'"), ("n % 12 = 1", "'u=1,'"), ("n % 12 = 2", "'u=1 i'"), ("n % 12 = 3", "'u=3, u=?0'"))),
    "rep": ("reporting-endpoints", _when(("n % 10 = 1", "'d=\"https://r.example/?a=1,b\"'"), ("n % 10 = 2", "'d=https://r.example'"), ("n % 10 = 3", "'d=\"open'"), ("n % 10 = 4", "'d=\"x\", d=\"y\"'"))),
}
_EACH = ", ".join(f"{made} AS {c}" for c, (_, made) in LINES.items())
_BARE = r"""(?:"(?:[\x20\x21\x23-\x5B\x5D-\x7E]|\\["\\])*"|:[A-Za-z0-9+/=]*:|-?(?:\d{1,15}|\d{1,12}\.\d{1,3})|\?[01]|[A-Za-z*][!#$%&'*+.^_`|~:/0-9A-Za-z-]*)"""
_ITEM = rf"{_BARE}(?:; *[a-z*][a-z0-9_.*-]*(?:={_BARE})?)*"
_INNER = rf"\( *(?:{_ITEM}(?: +{_ITEM})* *)?\)"
_PARAMS = rf"(?:; *[a-z*][a-z0-9_.*-]*(?:={_BARE})?)*"
_MEMBER = rf"[a-z*][a-z0-9_.*-]*(?:=(?:{_ITEM}|{_INNER}{_PARAMS})|{_PARAMS})"
DICTIONARY = rf"(?:{_MEMBER}(?:[ \t]*,[ \t]*{_MEMBER})*)?".replace("'", "''")


def _named(names: tuple[str, ...]) -> list[str]:
    """Columns of the headers in ``names``, a header once."""
    return list({name: c for c, (name, _) in reversed(LINES.items()) if name in names}.values())


def _present(note: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{note}' AS note_id, site FROM g WHERE {c} IS NOT NULL" for c in columns)


def _is(note: str, test: str, source: str = "g") -> str:
    return f"SELECT '{note}', site FROM {source} WHERE {test}"


_K = config.fields()
_TWICE = [[c for c, (n, _) in LINES.items() if n == name] for name in dict.fromkeys(n for n, _ in LINES.values()) if name in _K.single]
_CC_NUMBERS = "('max-age', 's-maxage', 'stale-while-revalidate', 'stale-if-error')"
_DICTS = [c for c, (name, _) in LINES.items() if structured.TYPES.get(name) == "dict"]
_FOUND = [
    _present("FIELD_DEPRECATED", _named(_K.deprecated)),
    _present("REQUEST_HDR_IN_RESPONSE", _named(_K.request_only)),
    *(_is("SINGLE_HEADER_REPEAT", " AND ".join(f"{c} IS NOT NULL" for c in cs)) for cs in _TWICE if len(cs) > 1),
    *(_is("FIELD_TOO_LARGE", f"octet_length(encode({c})) + {len(name) + 4} > {rules.MAX_FIELD}") for c, (name, _) in LINES.items()),
    _is("BAD_SYNTAX", "name IS NOT NULL"),
    *(_is("BAD_SYNTAX_DETAILED", f"NOT regexp_full_match(trim({c}), '[0-9]+')") for c in ("age", "age2", "clen")),
    *(_is("BAD_DATE_SYNTAX", f"NOT regexp_full_match({c}, '[A-Z][a-z][a-z], [0-9][0-9] [A-Z][a-z][a-z] [0-9]{{4}} [0-9:]{{8}} GMT')") for c in ("date", "expires")),
    _is("UNKNOWN_VALUE", "lower(trim(xcto)) <> 'nosniff'"),
    _is("UNKNOWN_VALUE", "lower(trim(xfo)) NOT IN ('deny', 'sameorigin')"),
    _is("CONTENT_TYPE_MISMATCH", "ctype ILIKE 'text/plain%' AND link LIKE '%rel=canonical%'"),
    _is("VARY_COMPLEX", f"len(list_filter(string_split(vary, ','), lambda x: trim(x) <> '')) > {rules.MANY_VARY}"),
    _is("VARY_ASTERISK", "vary LIKE '%*%'"),
    "SELECT 'CC_DUP', site FROM directives GROUP BY n, site, name HAVING count(*) > 1",
    _is("BAD_CC_SYNTAX", f"name IN {_CC_NUMBERS} AND NOT regexp_full_match(coalesce(value, ''), '\"?[0-9]+\"?')", "directives"),
    _is("CC_WRONG_MESSAGE", "name IN ('max-stale', 'min-fresh', 'only-if-cached')", "directives"),
    "SELECT 'CC_CONFLICTING', site FROM directives GROUP BY n, site HAVING bool_or(name = 'no-store') AND bool_or(name IN ('max-age', 's-maxage', 'public'))",
    "SELECT 'FRESHNESS_FRESH', site FROM (SELECT n, site, arg_min(value, i) AS v FROM directives WHERE name = 'max-age' GROUP BY n, site) WHERE try_cast(v AS BIGINT) > 0",
    _is("HSTS_VALID", "hsts LIKE 'max-age=%'"),
    _is("HSTS_NO_SUBDOMAINS", "hsts LIKE 'max-age=%' AND hsts NOT ILIKE '%includesubdomains%'"),
    _is("HSTS_SHORT_MAX_AGE", f"try_cast(regexp_extract(hsts, 'max-age=([0-9]+)', 1) AS BIGINT) < {rules.SHORT_HSTS}"),
    _is("CONTENT_SECURITY_POLICY", "csp IS NOT NULL OR csp2 IS NOT NULL"),
    _is("CSP_UNSAFE_INLINE", "concat(csp, csp2) ILIKE '%''unsafe-inline''%'"),
    _is("CSP_UNSAFE_EVAL", "concat(csp, csp2) ILIKE '%''unsafe-eval''%'"),
    _is("CROSS_ORIGIN_RESOURCE_POLICY_BAD_VALUE", "lower(trim(corp)) NOT IN ('same-site', 'same-origin', 'cross-origin')"),
    *(_is("STRUCTURED_FIELD_PARSE_ERROR", f"NOT regexp_full_match(trim({c}), '{DICTIONARY}')") for c in _DICTS),
    *(
        f"SELECT 'DUPLICATE_KEY', site FROM (SELECT n, site, regexp_extract(trim(unnest(regexp_extract_all({c}, '(?:[^,\"(]|\"[^\"]*\"|\\([^)]*\\))+'))), '^[a-z*][a-z0-9_.*-]*') AS k FROM g WHERE regexp_full_match(trim({c}), '{DICTIONARY}')) GROUP BY n, site, k HAVING count(*) > 1"
        for c in _DICTS
    ),
    *(f"SELECT 'SET_COOKIE_UNKNOWN_ATTRIBUTE', site FROM (SELECT site, lower(trim(split_part(unnest(string_split({c}, ';')[2:]), '=', 1))) AS a FROM g) WHERE a <> '' AND a NOT IN {tuple(_K.cookie_attributes)}" for c in ("sc", "sc2")),
    *(_is("SET_COOKIE_LIFETIME_TOO_LONG", f"try_cast(regexp_extract({c}, 'Max-Age=(-?[0-9]+)', 1) AS BIGINT) > {rules.LONG_COOKIE}") for c in ("sc", "sc2")),
    *(_is("SET_COOKIE_VALUE_TOO_LARGE", f"octet_length(encode(regexp_extract({c}, '^[^=;]*=([^;]*)', 1))) > {rules.MAX_COOKIE}") for c in ("sc", "sc2")),
]
_SQL = (
    f"WITH g AS (SELECT n, site, {_EACH} FROM (SELECT o_orderkey AS n, 's' || CAST(o_custkey AS STRING) AS site FROM orders)),\n"
    "pieces AS (SELECT n, site, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT n, site, regexp_extract_all(cc, '(?:[^,\"]|\"[^\"]*\")+') AS ps FROM g)),\n"
    "directives AS (SELECT n, site, i, lower(trim(split_part(p, '=', 1))) AS name, CASE WHEN p LIKE '%=%' THEN trim(substr(p, strpos(p, '=') + 1)) END AS value FROM pieces WHERE trim(split_part(p, '=', 1)) <> ''),\n"
    "f AS (" + "\nUNION ALL ".join(_FOUND) + ")\nSELECT note_id, count(*) AS occ, count(DISTINCT site) AS sites FROM f GROUP BY note_id"
)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("site"))
    # numbers are small and what is made of them is not, so their bytes are no measure of the work: the count of tasks is given
    rows = numbers.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "n").withColumns({f"_{c}": F.expr(made) for c, (_, made) in LINES.items()})
    lines = [F.when(F.col(f"_{c}").isNotNull(), F.struct(F.lit(name).alias("name"), F.col(f"_{c}").alias("value"))) for c, (name, _) in LINES.items()]
    return enrich(rows.select(F.col("n").alias("resp_id"), F.concat(F.lit("http://"), "site", F.lit("/")).alias("url"), "site", F.lit(CRAWL_TS).alias("crawl_ts"), F.array_compact(F.array(*lines)).alias("headers")))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.note_counts(generated(spark, sf_dir)).select("note_id", "occ", "sites")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"generated_findings": _findings}


def oracle_sql() -> dict[str, str]:
    return {"generated_findings": _SQL}
