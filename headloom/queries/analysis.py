"""Queries of the header analysis and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom import config
from headloom.functions import headers as H
from headloom.functions import hll
from headloom.functions import text as T
from headloom.operators import census, cooccur, counters, findings, ranking, recipes, timing, transition
from headloom.plans import store
from headloom.plans.enrich import enrich, keep_sites
from headloom.queries import base_sql
from headloom.queries.testbed import enriched, responses

Made = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Made, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(name: str, made: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A query over enriched responses; its SQL follows the shared beginning."""
    _ALL[name] = (lambda s, d: made(enriched(s, d)), None if sql is None else base_sql.BASE + sql)


def _on(name: str, sql: str | None):
    def put(made: Made) -> Made:
        _ALL[name] = (made, sql)
        return made

    return put


def _in(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


_F = config.fields()
_KNOWN, _OLD = _in(_F.standard + _F.deprecated), _in(_F.deprecated)
_SITES = "count(DISTINCT site) AS sites"

# Counters ---------------------------------------------------------------------------------------------
_of("total_responses", counters.total_responses, "SELECT count(*) AS responses FROM resp")
_of("header_counts", counters.field_counts, "SELECT name, count(*) AS occ FROM hdr GROUP BY name")
_of("unregistered_presence", counters.unregistered, f"SELECT name, count(DISTINCT resp_id) AS responses FROM hdr WHERE name NOT IN ({_KNOWN}) AND name NOT LIKE 'x-crawler-%' GROUP BY name")
_of("severity_rollup", counters.severity, "SELECT s AS severity, count(*) AS responses FROM (SELECT r.resp_id, CASE max(CASE level WHEN 'bad' THEN 4 WHEN 'warn' THEN 3 WHEN 'info' THEN 2 WHEN 'good' THEN 1 ELSE 0 END) WHEN 4 THEN 'bad' WHEN 3 THEN 'warn' WHEN 2 THEN 'info' WHEN 1 THEN 'good' ELSE 'clean' END AS s FROM resp r LEFT JOIN notes n ON n.resp_id = r.resp_id GROUP BY r.resp_id) GROUP BY s")
_of("health_pct", lambda e: counters.severity(e).withColumn("pct", F.round(F.col("responses") * 100.0 / F.sum("responses").over(Window.partitionBy()), 6)), "SELECT s AS severity, count(*) AS responses, round(count(*) * 100.0 / (SELECT count(*) FROM resp), 6) AS pct FROM (SELECT r.resp_id, CASE max(CASE level WHEN 'bad' THEN 4 WHEN 'warn' THEN 3 WHEN 'info' THEN 2 WHEN 'good' THEN 1 ELSE 0 END) WHEN 4 THEN 'bad' WHEN 3 THEN 'warn' WHEN 2 THEN 'info' WHEN 1 THEN 'good' ELSE 'clean' END AS s FROM resp r LEFT JOIN notes n ON n.resp_id = r.resp_id GROUP BY r.resp_id) GROUP BY s")
_of("byte_economics", counters.header_bytes, "SELECT name, CAST(sum(n) AS BIGINT) AS bytes FROM bytes GROUP BY name")
_of("byte_callouts", counters.byte_callouts, "SELECT name, CAST(sum(n) AS BIGINT) AS bytes, round(sum(n) * 100.0 / (SELECT sum(n) FROM bytes), 6) AS pct FROM bytes WHERE name IN ('set-cookie', 'content-security-policy') GROUP BY name")
_of("total_header_bytes", counters.total_header_bytes, "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_header_bytes FROM bytes")
_of("block_hist", lambda e: counters.block_histogram(e).drop("ord"), "SELECT CASE WHEN b < 256 THEN '<256 B' WHEN b < 1024 THEN '256-1023 B' ELSE '1-4 KB' END AS bucket, count(*) AS responses FROM (SELECT r.resp_id, coalesce(sum(n), 0) AS b FROM resp r LEFT JOIN bytes USING (resp_id) GROUP BY r.resp_id) GROUP BY 1")
_of("category_split", counters.category_bytes, f"SELECT c.category, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes FROM (VALUES ('standard'), ('deprecated'), ('proprietary')) c(category) LEFT JOIN (SELECT n, CASE WHEN name IN ({_OLD}) THEN 'deprecated' WHEN name IN ({_KNOWN}) THEN 'standard' ELSE 'proprietary' END AS category FROM bytes) USING (category) GROUP BY 1")
_CSP = "SELECT site, CAST(max(n) AS BIGINT) AS size FROM (SELECT r.site, r.resp_id, coalesce(sum(strlen(h.value)), 0) AS n FROM resp r LEFT JOIN hdr h ON h.resp_id = r.resp_id AND h.name = 'content-security-policy' GROUP BY 1, 2) GROUP BY site"
_of("csp_max_by_site", counters.policy_sizes, _CSP)
_of("csp_buckets", counters.policy_buckets, f"SELECT CASE WHEN size = 0 THEN 'No CSP header' WHEN size < 100 THEN '1-99 B' ELSE '100-499 B' END AS bucket, count(*) AS sites FROM ({_CSP}) GROUP BY 1")
_of("layer_counts", counters.layer_counts, "SELECT coalesce(layer, '__unmatched__') AS layer, count(*) AS responses FROM resp LEFT JOIN lay USING (resp_id) GROUP BY 1")
_of("layer_coverage", lambda e: e.agg(F.count(F.lit(1)).alias("responses"), F.round(F.avg((F.size("layers") > 0).cast("double")), 6).alias("coverage")), "SELECT count(*) AS responses, round(avg(CASE WHEN resp_id IN (SELECT resp_id FROM lay) THEN 1.0 ELSE 0 END), 6) AS coverage FROM resp")
_of("field_by_layer", counters.field_by_layer, "SELECT name, layer, count(*) AS occ FROM hdr JOIN lay USING (resp_id) GROUP BY 1, 2")
_of("asn_lpm", lambda e: e.select("resp_id", F.coalesce("asn", F.lit(0)).alias("asn")), "SELECT resp_id, coalesce(asn, 0) AS asn FROM resp")
_of("asn_counts", counters.asn_counts, "SELECT asn, count(*) AS responses FROM resp WHERE asn IS NOT NULL GROUP BY asn")
_of("asn_top", lambda e: counters.networks(ranking.top(counters.asn_counts(e), 50, "responses", "asn")), "SELECT asn, count(*) AS responses, CASE asn WHEN 13335 THEN 'Cloudflare' WHEN 20940 THEN 'Akamai' WHEN 54113 THEN 'Fastly' END AS operator, CASE asn WHEN 13335 THEN 'cloudflare' WHEN 20940 THEN 'akamai' WHEN 54113 THEN 'fastly' END AS layer FROM resp WHERE asn IS NOT NULL GROUP BY asn ORDER BY responses DESC, asn LIMIT 50")
_of("value_hist", counters.value_histograms, "SELECT histogram, bucket, count(*) AS occ FROM resp JOIN hk USING (k) GROUP BY 1, 2")

# Recipes ----------------------------------------------------------------------------------------------


def _recipe_sql(rows: str) -> str:
    return f"SELECT recipe, count(*) AS occ, {_SITES} FROM (SELECT resp_id, site, string_agg(DISTINCT token, ', ' ORDER BY token) AS recipe FROM {rows} GROUP BY 1, 2) GROUP BY recipe"


_AE = "(SELECT resp_id, site, CASE WHEN count(*) FILTER (token <> 'accept-encoding') = 0 THEN '(accept-encoding only)' ELSE string_agg(DISTINCT token, ', ' ORDER BY token) FILTER (token <> 'accept-encoding') END AS recipe FROM vary GROUP BY 1, 2)"
_of("vary_recipes", recipes.vary_recipes, _recipe_sql("vary"))
_of("vary_marginals", recipes.vary_marginals, f"SELECT token, count(DISTINCT resp_id) AS occ, {_SITES} FROM vary WHERE token <> '*' GROUP BY token")
_of("vary_factored", recipes.vary_factored, f"SELECT recipe, count(*) AS occ, {_SITES} FROM {_AE} GROUP BY recipe")
_of("vary_axes", recipes.vary_axes, f"SELECT a.token, count(DISTINCT resp_id) AS occ, {_SITES} FROM (VALUES ('accept-encoding'), ('user-agent'), ('cookie'), ('accept-language')) a(token) LEFT JOIN vary USING (token) GROUP BY 1")
_of("vary_nonstandard", recipes.vary_nonstandard, f"SELECT token, count(DISTINCT resp_id) AS occ, {_SITES} FROM vary WHERE token = 'x-device' GROUP BY token")
_of("cc_recipes", recipes.cc_recipes, _recipe_sql("cc"))
_of("cc_marginals", recipes.cc_marginals, f"SELECT split_part(token, '=', 1) AS token, count(DISTINCT resp_id) AS occ, {_SITES} FROM cc GROUP BY 1")
_of("cc_nonstandard", recipes.cc_nonstandard, f"SELECT 'ext' AS token, count(DISTINCT resp_id) AS occ, {_SITES} FROM cc WHERE token = 'ext=N' HAVING count(*) > 0")
_of("vary_sites_hll", lambda e: recipes.site_estimates(e, H.vary_tokens(F.col("headers"))), None)

# Co-occurrence ----------------------------------------------------------------------------------------
_SEC = cooccur.security
_PAIRS = "pc AS (SELECT a.token || ', ' || b.token AS pair, a.token AS a, b.token AS b, a.site FROM {0} a JOIN {0} b ON a.resp_id = b.resp_id AND a.token < b.token)"
_of("cooccur_bundles", lambda e: cooccur.bundles(e, _SEC(e)), f"SELECT bundle, count(*) AS occ, {_SITES} FROM bun GROUP BY bundle")
_of("cooccur_empty", lambda e: cooccur.empty_bundles(e, _SEC(e)), f"SELECT bundle, count(*) AS occ, {_SITES} FROM bun WHERE bundle = '(none)' GROUP BY bundle")
_of("cooccur_marginals", lambda e: cooccur.marginal_counts(e, _SEC(e)), f"SELECT token, count(*) AS occ, {_SITES} FROM sec GROUP BY token")
_of("cooccur_pairs", lambda e: cooccur.pair_counts(e, _SEC(e)), ", " + _PAIRS.format("sec") + f" SELECT pair, count(*) AS occ, {_SITES} FROM pc GROUP BY pair")
_of("header_lifts", lambda e: cooccur.lifts(e, _SEC(e)), ", " + _PAIRS.format("sec") + ", m AS (SELECT token, count(*) AS n FROM sec GROUP BY token), j AS (SELECT pair, a, b, count(*) AS joint FROM pc GROUP BY ALL ORDER BY joint DESC, pair LIMIT 25) SELECT j.a, j.b, joint, round(joint / nb.n, 6) AS p_a_given_b, round(joint / na.n, 6) AS p_b_given_a, round(joint * (SELECT count(*) FROM resp) / (na.n * nb.n), 6) AS lift FROM j JOIN m na ON na.token = a JOIN m nb ON nb.token = b")
_of("cooccur_by_layer", lambda e: cooccur.by_layer(e, _SEC(e)), "SELECT bundle, layer, count(*) AS occ FROM bun JOIN lay USING (resp_id) GROUP BY 1, 2")
_of("layer_modal_bundle", lambda e: cooccur.layer_defaults(e, _SEC(e)), "SELECT layer, CAST(total AS BIGINT) AS responses, bundle, round(occ / total, 6) AS share FROM (SELECT layer, bundle, count(*) AS occ, sum(count(*)) OVER (PARTITION BY layer) AS total FROM bun JOIN lay USING (resp_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY occ DESC, bundle) = 1")

# Findings ---------------------------------------------------------------------------------------------
_of("note_counts", findings.note_counts, f"SELECT note_id, count(*) AS occ, {_SITES} FROM notes GROUP BY note_id")
_of("note_by_layer", findings.note_by_layer, "SELECT note_id, layer, count(*) AS occ FROM notes JOIN lay USING (resp_id) GROUP BY 1, 2")
_of("note_vars", findings.note_vars, "SELECT note_id, var, val, count(*) AS occ FROM vars GROUP BY ALL")
_of("note_categories", findings.by_category, "SELECT category, CAST(sum(occ) AS BIGINT) AS occ, count(*) AS types, round(sum(occ) * 100.0 / sum(sum(occ)) OVER (), 6) AS share FROM (SELECT note_id, count(*) AS occ, CASE WHEN note_id LIKE 'VARY%' THEN 'CONNEG' WHEN note_id LIKE '%CC%' OR note_id LIKE 'FRESH%' THEN 'CACHING' WHEN note_id LIKE 'HSTS%' OR note_id LIKE 'CSP%' OR note_id LIKE 'CONTENT_SEC%' OR note_id LIKE 'CROSS%' THEN 'SECURITY' WHEN note_id LIKE 'SET_COOKIE%' THEN 'COOKIES' ELSE 'GENERAL' END AS category FROM notes GROUP BY note_id) GROUP BY category")
_of("note_samples", findings.note_samples, "SELECT note_id, site, url, rank FROM (SELECT note_id, site, min(url) AS url, CAST(row_number() OVER (PARTITION BY note_id ORDER BY min(url)) AS INTEGER) AS rank FROM notes GROUP BY 1, 2) WHERE rank <= 5")
_of("sample_gate", lambda e: findings.note_samples(e, e.filter("site LIKE 'm.%'")), "SELECT note_id, site, url, rank FROM (SELECT note_id, site, min(url) AS url, CAST(row_number() OVER (PARTITION BY note_id ORDER BY min(url)) AS INTEGER) AS rank FROM notes WHERE site LIKE 'm.%' GROUP BY 1, 2) WHERE rank <= 5")
_of("var_samples", lambda e: findings.var_samples(e).select("note_id", "var", "val", "site", "url", "rank"), "SELECT note_id, var, val, site, url, rank FROM (SELECT note_id, var, val, site, min(url) AS url, CAST(row_number() OVER (PARTITION BY note_id, var, val ORDER BY min(url)) AS INTEGER) AS rank FROM vars WHERE var IN ('field_name', 'vary_count') GROUP BY 1, 2, 3, 4) WHERE rank <= 15")
_of("note_bundles", findings.note_bundles, f"SELECT bundle, count(*) AS occ, {_SITES} FROM (SELECT r.resp_id, r.site, coalesce(string_agg(note_id, ', ' ORDER BY note_id), '(none)') AS bundle FROM resp r LEFT JOIN fired f ON f.resp_id = r.resp_id GROUP BY 1, 2) GROUP BY bundle")
_of("note_marginals", findings.note_marginals, f"SELECT note_id, count(*) AS occ, {_SITES} FROM fired GROUP BY note_id")
_of("note_pairs_lineage", findings.note_pairs, f"SELECT a.note_id || ', ' || b.note_id AS pair, count(*) AS occ, count(DISTINCT a.site) AS sites FROM fired a JOIN fired b ON a.resp_id = b.resp_id AND a.note_id < b.note_id WHERE NOT EXISTS (FROM fnd WHERE (fnd.note_id = a.note_id AND fnd.parent = b.note_id) OR (fnd.note_id = b.note_id AND fnd.parent = a.note_id)) GROUP BY 1")
_of("unseen_anti", findings.unseen, f"SELECT note_id, kind FROM (VALUES {', '.join(repr(x) for x in [(r.id, 'reachable') for r in findings.rules.rules()] + [(x, 'request_only') for x in findings.rules.REQUEST_ONLY] + [(x, 'body_only') for x in findings.rules.BODY_ONLY])}) t(note_id, kind) WHERE note_id NOT IN (SELECT note_id FROM notes)")
_of("fires_per_occurrence", findings.fires_per_occurrence, "SELECT note_id, val, occ, field_occ, round(occ / field_occ, 6) AS rate FROM (SELECT note_id, val, count(*) AS occ FROM vars WHERE var = 'field_name' GROUP BY 1, 2) LEFT JOIN (SELECT name AS val, count(*) AS field_occ FROM hdr GROUP BY 1) USING (val)")
_of("layer_rates", findings.layer_rates, "SELECT note_id, layer, occ, round(occ * 100.0 / total, 6) AS share, round(occ * 100.0 / responses, 6) AS rate FROM (SELECT note_id, layer, count(*) AS occ FROM notes JOIN lay USING (resp_id) GROUP BY 1, 2) JOIN (SELECT note_id, count(*) AS total FROM notes GROUP BY 1) USING (note_id) JOIN (SELECT layer, count(*) AS responses FROM lay GROUP BY 1) USING (layer)")

_of("note_lifts", findings.note_lifts, """, pc AS (SELECT a.note_id AS a, b.note_id AS b, count(*) AS joint FROM fired a JOIN fired b ON a.resp_id = b.resp_id AND a.note_id < b.note_id WHERE NOT EXISTS (FROM fnd WHERE (fnd.note_id = a.note_id AND fnd.parent = b.note_id) OR (fnd.note_id = b.note_id AND fnd.parent = a.note_id)) GROUP BY 1, 2),
m AS (SELECT note_id, count(*) AS n FROM fired GROUP BY note_id), j AS (SELECT * FROM pc ORDER BY joint DESC, a || ', ' || b LIMIT 25)
SELECT j.a, j.b, joint, round(joint / nb.n, 6) AS p_a_given_b, round(joint / na.n, 6) AS p_b_given_a, round(joint * (SELECT count(*) FROM resp) / (na.n * nb.n), 6) AS lift FROM j JOIN m na ON na.note_id = a JOIN m nb ON nb.note_id = b""")
_of("findings_by_field", findings.by_field, "SELECT lower(val) AS field, count(*) AS occ, count(DISTINCT note_id) AS types FROM vars WHERE var = 'field_name' GROUP BY 1")
_of("byte_means", counters.mean_bytes, "SELECT name, CAST(sum(n) AS BIGINT) AS bytes, occ, round(sum(n) / occ, 6) AS mean FROM bytes JOIN (SELECT name, count(*) AS occ FROM hdr GROUP BY name) USING (name) GROUP BY name, occ")

_CATEGORY = "CASE WHEN note_id LIKE 'VARY%' THEN 'CONNEG' WHEN note_id LIKE '%CC%' OR note_id LIKE 'FRESH%' THEN 'CACHING' WHEN note_id LIKE 'HSTS%' OR note_id LIKE 'CSP%' OR note_id LIKE 'CONTENT_SEC%' OR note_id LIKE 'CROSS%' THEN 'SECURITY' WHEN note_id LIKE 'SET_COOKIE%' THEN 'COOKIES' ELSE 'GENERAL' END"


def _notes_by_category(e: DataFrame) -> DataFrame:
    """Findings with their category and level, and the share of sites that have them."""
    sites = e.agg(F.countDistinct("site")).scalar()
    rows = findings.described(findings.note_counts(e))
    return rows.select("category", "note_id", "level", "occ", "sites", F.round(ranking.share(F.col("sites"), sites), 6).alias("site_pct"))


_of("notes_by_category", _notes_by_category, f"SELECT {_CATEGORY} AS category, note_id, any_value(level) AS level, count(*) AS occ, {_SITES}, round(count(DISTINCT site) * 100.0 / (SELECT count(DISTINCT site) FROM resp), 6) AS site_pct FROM notes GROUP BY note_id")
_of("field_errors", lambda e: findings.field_errors(findings.note_vars(e)), "SELECT split_part(val, ': ', 1) AS field, substr(val, strpos(val, ': ') + 2) AS problem, count(*) AS occ FROM vars WHERE var = 'field_error' GROUP BY 1, 2")
_ROLES = ", ".join(f"('{x.id}', '{x.role}')" for x in config.layers())
_of("layer_roles", lambda e: counters.layer_roles(counters.layer_counts(e)), f"SELECT l AS layer, coalesce(role, '') AS role, responses FROM (SELECT coalesce(layer, '__unmatched__') AS l, count(*) AS responses FROM resp LEFT JOIN lay USING (resp_id) GROUP BY 1) LEFT JOIN (VALUES {_ROLES}) r(layer, role) ON r.layer = l")
_of("recipe_trim", lambda e: ranking.top(recipes.cc_recipes(e), 3, "occ", "recipe"), _recipe_sql("cc") + " ORDER BY occ DESC, recipe LIMIT 3")
_of("bundle_layers_trim", lambda e: ranking.surviving(cooccur.by_layer(e, _SEC(e)), ranking.top(cooccur.bundles(e, _SEC(e)), 3, "occ", "bundle"), ["bundle"]), "SELECT bundle, layer, count(*) AS occ FROM bun JOIN lay USING (resp_id) WHERE bundle IN (SELECT bundle FROM (SELECT bundle, count(*) AS c FROM bun GROUP BY bundle ORDER BY c DESC, bundle LIMIT 3)) GROUP BY 1, 2")


def _sampled_values(e: DataFrame) -> DataFrame:
    """Samples of the five commonest values of header names alone."""
    best = ranking.top(findings.note_vars(e).filter("var = 'field_name'"), 5, "occ", "note_id", "val")
    return ranking.surviving(findings.var_samples(e), best, ["note_id", "var", "val"]).select("note_id", "var", "val", "site", "url", "rank")


_of("var_samples_trim", _sampled_values, "SELECT note_id, var, val, site, url, rank FROM (SELECT note_id, var, val, site, min(url) AS url, CAST(row_number() OVER (PARTITION BY note_id, var, val ORDER BY min(url)) AS INTEGER) AS rank FROM vars SEMI JOIN (SELECT note_id, val, count(*) AS c FROM vars WHERE var = 'field_name' GROUP BY ALL ORDER BY c DESC, note_id, val LIMIT 5) b USING (note_id, val) WHERE var = 'field_name' GROUP BY 1, 2, 3, 4) WHERE rank <= 15")

# Stores: what two halves of the responses keep, merged --------------------------------------------------


def _halves(name: str) -> Callable[[DataFrame], DataFrame]:
    def made(e: DataFrame) -> DataFrame:
        even, odd = e.filter("resp_id % 2 = 0"), e.filter("resp_id % 2 <> 0")
        return store.fold(store.aggregate(even, name).unionByName(store.aggregate(odd, name)), name)

    return made


_of("store_merge_notes", _halves("notes"), "SELECT note_id, count(*) AS occ FROM notes GROUP BY note_id")
_of("store_merge_values", _halves("note_vars"), "SELECT note_id, var, val, count(*) AS occ FROM vars GROUP BY ALL")
_of("store_merge_bundles", _halves("bundles"), "SELECT bundle, count(*) AS occ FROM bun GROUP BY bundle")
_of("store_merge_transitions", _halves("transitions"), "SELECT pair, category, count(*) AS occ FROM moves GROUP BY 1, 2")
_of("store_merge_policies", _halves("policies"), _CSP)
_of("store_merge_samples", _halves("note_samples"), "SELECT note_id, site, url, rank FROM (SELECT note_id, site, min(url) AS url, CAST(row_number() OVER (PARTITION BY note_id ORDER BY min(url)) AS INTEGER) AS rank FROM notes GROUP BY 1, 2) WHERE rank <= 5")

# Transition and census --------------------------------------------------------------------------------
_of("transition_occ", transition.counts, "SELECT pair, category, count(*) AS occ FROM moves GROUP BY 1, 2")
_TR = '''SELECT p.*, count(*) FILTER (category = 'both') AS "both", count(*) FILTER (category = 'modern_only') AS modern_only, count(*) FILTER (category = 'legacy_only') AS legacy_only, count(*) FILTER (category = 'neither') AS neither, count(DISTINCT site) FILTER (category IN ('both', 'modern_only')) AS modern_sites, count(DISTINCT site) FILTER (category IN ('both', 'legacy_only')) AS legacy_sites FROM pk p LEFT JOIN moves m USING (pair) GROUP BY ALL'''
_of("transition_rows", transition.rows, f'''SELECT *, "both" + modern_only AS modern_present, "both" + legacy_only AS legacy_present, 2 * "both" + modern_only + legacy_only AS scoped, round(("both" + modern_only) / nullif(2 * "both" + modern_only + legacy_only, 0), 6) AS ratio FROM ({_TR})''')
_CENSUS = f"""cen AS (SELECT name, responses, coalesce(bytes, 0) AS bytes,
  CASE WHEN name IN ('cf-ray', 'cf-cache-status') THEN 'cloudflare' WHEN name IN ('x-amz-cf-id', 'x-amz-cf-pop') THEN 'cloudfront' WHEN name IN ('x-served-by', 'x-timer') THEN 'fastly' WHEN name IN ('akamai-grn', 'x-akamai-transformed') THEN 'akamai'
       WHEN name IN ('x-vercel-id', 'x-vercel-cache') THEN 'vercel' WHEN name = 'x-azure-ref' THEN 'azure-front-door' WHEN name LIKE 'x-envoy-%' THEN 'envoy' WHEN name = 'x-nextjs-cache' THEN 'nextjs' ELSE '__unattributed__' END AS vendor,
  CASE WHEN name IN ('x-served-by', 'x-amz-cf-pop') THEN 'routing' WHEN name IN ('cf-cache-status', 'x-vercel-cache', 'x-nextjs-cache', 'x-proxy-cache') THEN 'caching'
       WHEN name IN ('cf-ray', 'x-amz-cf-id', 'x-timer', 'x-vercel-id', 'x-azure-ref', 'akamai-grn', 'x-request-id') OR name LIKE 'x-envoy-%' THEN 'observability' WHEN name = 'x-aspnet-version' THEN 'security' ELSE '__other__' END AS family,
  regexp_extract(name, '^(x-[^-]+|[^-]+)', 1) AS prefix, name IN ('x-request-id', 'x-powered-by', 'x-aspnet-version') AS well_known
  FROM (SELECT name, count(DISTINCT resp_id) AS responses FROM hdr WHERE name NOT IN ({_KNOWN}) AND name NOT LIKE 'x-crawler-%' GROUP BY name) LEFT JOIN (SELECT name, CAST(sum(n) AS BIGINT) AS bytes FROM bytes GROUP BY name) USING (name))"""
_of("census_entries", census.entries, f", {_CENSUS} SELECT * FROM cen")
_of("census_totals", lambda e: census.totals(census.entries(e)), f", {_CENSUS} SELECT count(*) AS names, CAST(sum(responses) AS BIGINT) AS responses, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (well_known) AS well_known_names, count(*) FILTER (NOT well_known) AS novel_names FROM cen")
for _axis in ("vendor", "family", "prefix"):
    _of(
        f"census_{_axis}",
        lambda e, axis=_axis: census.clusters(census.entries(e), axis, "cluster"),
        f", {_CENSUS}, r AS (SELECT *, row_number() OVER (PARTITION BY {_axis} ORDER BY responses DESC, name) AS nth FROM cen) SELECT {_axis} AS cluster, count(*) AS names, CAST(sum(responses) AS BIGINT) AS responses, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(name, ', ' ORDER BY nth) FILTER (nth <= 8) AS members FROM r GROUP BY 1",
    )
def _trimmed(e: DataFrame) -> DataFrame:
    """The ten commonest headers, and what the cut leaves out."""
    counts = counters.field_counts(e)
    n = counts.agg(F.count(F.lit(1))).scalar()
    return ranking.top(counts, 10, "occ", "name").withColumn("n_total", n).withColumn("truncated", F.col("n_total") > 10)


_of("census_top", lambda e: ranking.top(census.entries(e).select("name", "responses"), 10, "responses", "name"), f", {_CENSUS} SELECT name, responses FROM cen ORDER BY responses DESC, name LIMIT 10")
_of("trim_topk", _trimmed, "SELECT name, count(*) AS occ, (SELECT count(DISTINCT name) FROM hdr) AS n_total, (SELECT count(DISTINCT name) > 10 FROM hdr) AS truncated FROM hdr GROUP BY name ORDER BY occ DESC, name LIMIT 10")
_of("trim_semi", lambda e: ranking.surviving(counters.field_by_layer(e), ranking.top(counters.field_counts(e), 10, "occ", "name"), ["name"]), "SELECT name, layer, count(*) AS occ FROM hdr JOIN lay USING (resp_id) WHERE name IN (SELECT name FROM (SELECT name, count(*) AS c FROM hdr GROUP BY name ORDER BY c DESC, name LIMIT 10)) GROUP BY 1, 2")
_of("pragma_token", lambda e: e.select("resp_id", H.pragma_no_cache(F.col("headers")).alias("no_cache")), "SELECT resp_id, k IN (2, 11) AS no_cache FROM resp")
_of("csp_directives", lambda e: e.select(F.explode(F.array_distinct(H.csp_directives(F.col("headers")))).alias("directive")).groupBy("directive").agg(F.count(F.lit(1)).alias("responses")), "SELECT directive, count(*) AS responses FROM resp JOIN (VALUES (1, 'default-src'), (1, 'frame-ancestors'), (3, 'script-src'), (3, 'frame-ancestors'), (9, 'upgrade-insecure-requests')) d(k, directive) USING (k) GROUP BY directive")
_of("distinct_sites_exact", lambda e: e.agg(F.countDistinct("site").alias("sites")), "SELECT count(DISTINCT site) AS sites FROM resp")
_of("distinct_sites_hll", lambda e: hll.estimate(hll.registers(e.withColumn("every", F.lit(1)), ["every"], "site", hll.GLOBAL), ["every"], hll.GLOBAL).select("sites"), None)
_of("headline", lambda e: e.agg(F.count(F.lit(1)).alias("responses"), F.countDistinct("site").alias("sites"), F.sum(F.size("notes")).alias("findings")), "SELECT count(*) AS responses, count(DISTINCT site) AS sites, (SELECT count(*) FROM notes) AS findings FROM resp")

# Plain tables -----------------------------------------------------------------------------------------
_SITE = r"lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', ''))"


@_on("site_normalize", f"SELECT page_id, {_SITE} AS site FROM pages")
def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.site("url").alias("site"))


@_on("topsite_semijoin", f"SELECT page_id AS resp_id, {_SITE} AS site FROM pages WHERE {_SITE} IN (SELECT s FROM (SELECT {_SITE} AS s, count(*) AS c FROM pages GROUP BY 1 ORDER BY c DESC, s LIMIT 20))")
def _top_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the twenty commonest sites; the filter stands before anything reads headers."""
    rows = responses(spark, sf_dir)
    best = ranking.top(rows.groupBy("site").count(), 20, "count", "site")
    return keep_sites(rows, best).select("resp_id", "site")


@_on("http_dates", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def _http_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three forms of a date, in turn, and one that is none."""
    day = F.col("o_orderdate")
    form = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "EEEE, dd-MMM-yy HH:mm:ss 'GMT'"))
    padded = F.concat_ws(" ", F.date_format(day, "EEE MMM"), F.lpad(F.dayofmonth(day).cast("string"), 2, " "), F.date_format(day, "HH:mm:ss yyyy"))
    form = form.when(F.col("o_orderkey") % 4 == 2, padded).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.http_date(form).alias("seconds"))


@_on("latin1_text", r"SELECT doc_id, md5(regexp_replace(text, '[^\x{0}-\x{FF}]', '?', 'g')) AS digest FROM documents")
def _latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.latin1(F.col("text")).cast("binary")).alias("digest"))


@_on("exit_failures", "SELECT failure, count(*) AS workers FROM (SELECT CASE WHEN event_id % 23 = 22 THEN 'warc_exit_unknown' WHEN event_id % 23 < 20 THEN CASE 14 - event_id % 23 - 12 WHEN 0 THEN 'warc_exit_zero' WHEN 1 THEN 'warc_exit_nonzero' WHEN 2 THEN 'warc_exit_nonzero' WHEN -9 THEN 'warc_signal_sigkill' WHEN -10 THEN 'warc_signal_sigbus' WHEN -11 THEN 'warc_signal_sigsegv' WHEN -15 THEN 'warc_signal_sigterm' ELSE 'warc_signal_other' END ELSE 'warc_exit_nonzero' END AS failure FROM events) GROUP BY 1")
def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes from 2 down to -17, 137 and none."""
    turn = F.col("event_id") % 23
    code = F.when(turn < 20, 2 - turn).when(turn < 22, 137)
    return table(spark, sf_dir, "events").groupBy(T.failure(code).alias("failure")).agg(F.count(F.lit(1)).alias("workers"))


@_on("shown_values", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(CASE WHEN length(v) > 300 THEN left(v, 300) || '…[truncated]' ELSE v END) END AS shown
FROM (SELECT doc_id, regexp_replace('/p?token=abc&q=1 ' || text, '([?&](signature|sig|s|token|access_token|auth|key|apikey|api_key|hmac|x-amz-signature|x-amz-security-token|x-goog-signature)=)[^&[:space:]]+', '\\1[redacted]', 'gi') AS v FROM documents)""")
def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header values for display: secrets gone, long ones cut, none of a secret header."""
    field = F.when(F.col("doc_id") % 5 == 0, "Set-Cookie").otherwise("Location")
    value = T.shown_value(field, F.concat(F.lit("/p?token=abc&q=1 "), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(value.cast("binary")).alias("shown"))


@_on("redact", "SELECT page_id, regexp_replace(url || '?Token=SEKRET&p=' || page_id || '&x-amz-signature=ZZ%20Z', '((?:[?&])(?:signature|sig|s|token|access_token|auth|key|apikey|api_key|hmac|x-amz-signature|x-amz-security-token|x-goog-signature)=)[^&[:space:]]+', '\\1[redacted]', 'gi') AS url FROM pages")
def _redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("url", F.lit("?Token=SEKRET&p="), F.col("page_id").cast("string"), F.lit("&x-amz-signature=ZZ%20Z"))
    return table(spark, sf_dir, "pages").select("page_id", T.redact(made).alias("url"))


@_on(
    "cooccur_lifts",
    """WITH t AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type AS token FROM events), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, day FROM t)),
m AS (SELECT token, count(*) AS c FROM t GROUP BY token), j AS (SELECT a.token AS a, b.token AS b, count(*) AS joint FROM t a JOIN t b ON a.user_id = b.user_id AND a.day = b.day AND a.token < b.token GROUP BY 1, 2)
SELECT j.a, j.b, joint, round(joint / nb.c, 6) AS p_a_given_b, round(joint / na.c, 6) AS p_b_given_a, round(joint * (SELECT n FROM n) / (na.c * nb.c), 6) AS lift FROM j JOIN m na ON na.token = j.a JOIN m nb ON nb.token = j.b""",
)
def lifts_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of a user's day go together."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("tokens"))
    rows = days.select(F.col("user_id").cast("string").alias("site"), "tokens")
    return cooccur.lifts(rows, F.col("tokens"))


@_on("order_recipes", "SELECT recipe, count(*) AS occ, count(DISTINCT o_custkey) AS sites FROM (SELECT o_orderkey, o_custkey, string_agg(DISTINCT l_returnflag || l_linestatus, ', ' ORDER BY l_returnflag || l_linestatus) AS recipe FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY recipe")
def _order_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of line states by order, with customers as sites."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tokens"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("site"))
    return recipes.recipes(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")), F.col("tokens"))


@_on("event_severity", "SELECT s AS severity, count(*) AS responses FROM (SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 2 END) WHEN 4 THEN 'bad' WHEN 3 THEN 'warn' WHEN 2 THEN 'info' ELSE 'good' END AS s FROM events GROUP BY user_id, CAST(ts AS DATE)) GROUP BY s")
def _event_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "view", "good").otherwise("info")
    note = F.struct(F.col("event_type").alias("note_id"), level.alias("level"))
    return counters.severity(table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.collect_list(note).alias("notes")))


@_on("ship_delay_hist", "SELECT CASE WHEN s < 0 THEN 'negative' WHEN s = 0 THEN '0' WHEN s < 60 THEN '<1 min' WHEN s < 600 THEN '1-10 min' WHEN s < 3600 THEN '10-60 min' WHEN s < 86400 THEN '1-24 hours' WHEN s < 604800 THEN '1-7 days' WHEN s < 2592000 THEN '7-30 days' WHEN s < 31536000 THEN '30-365 days' WHEN s < 315360000 THEN '1-10 years' ELSE '>10 years' END AS bucket, count(*) AS occ FROM (SELECT epoch(l_shipdate) - epoch(o_orderdate) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def _ship_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")
    return rows.groupBy(T.bucket(gap, T.LIFETIME).alias("bucket")).agg(F.count(F.lit(1)).alias("occ"))


@_on(
    "timing_percentiles",
    """WITH t AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY floor(value * 100)) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(sum(ms) AS BIGINT) AS sum, CAST(trunc(sum(ms) / count(*)) AS BIGINT) AS mean, CAST(trunc(avg(ms) FILTER (i IN ((n + 1) // 2, n // 2 + 1))) AS BIGINT) AS median, max(ms) FILTER (i = greatest(1, CAST(trunc(n * 90 / 100) AS BIGINT))) AS p90, max(ms) FILTER (i = greatest(1, CAST(trunc(n * 99 / 100) AS BIGINT))) AS p99, max(ms) AS max FROM t GROUP BY event_type""",
)
def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.summary(table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("ms")), ["event_type"], "ms")


@_on("segment_bytes", "SELECT source AS layer, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def _source_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("layer")).agg(F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@_on("largest_lines", "SELECT 'FIELD_TOO_LARGE' AS note_id, name AS field_name, max(n) AS largest FROM (SELECT 'x-part-' || doc_id % 3 AS name, strlen(text) + 12 AS n FROM documents) WHERE n > 8192 GROUP BY name")
def _largest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as header values under three names."""
    name = F.concat(F.lit("x-part-"), (F.col("doc_id") % 3).cast("string"))
    header = F.struct(name.alias("name"), F.coalesce("text", F.lit("")).alias("value"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resp_id"), F.lit("").alias("url"), F.lit("").alias("site"), F.array(header).alias("headers"))
    return findings.numeric_max(enrich(rows))


@_on("path_rewrite", "SELECT page_id, replace(p, '/warc/', '/wat/') AS path FROM (SELECT page_id, 'crawl-data/' || page_id % 7 || '/warc/' || page_id || '.warc.wat.gz' AS p FROM pages)")
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headloom.sources.paths import wat_path

    n = F.col("page_id")
    made = F.concat(F.lit("crawl-data/"), (n % 7).cast("string"), F.lit("/warc/"), n.cast("string"), F.lit(".warc.gz"))
    return table(spark, sf_dir, "pages").select("page_id", wat_path(made).alias("path"))


def queries() -> dict[str, Made]:
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ALL.items() if v[1]}
