"""What the SQL side starts from: the same header lists as values, and findings and layers derived by hand."""

from __future__ import annotations

from headloom.queries.testbed import VARIANTS

K = len(VARIANTS)


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


#: By header list: note, level, parent.
FOUND = [
    (0, "FRESHNESS_FRESH", "good", None),
    (1, "CC_CONFLICTING", "warn", None), (1, "FRESHNESS_FRESH", "good", None), (1, "HSTS_VALID", "good", None), (1, "CONTENT_SECURITY_POLICY", "info", None),
    (2, "FIELD_DEPRECATED", "warn", None), (2, "FIELD_DEPRECATED", "warn", None), (2, "REQUEST_HDR_IN_RESPONSE", "bad", None),
    (3, "HSTS_VALID", "good", None), (3, "HSTS_NO_SUBDOMAINS", "info", "HSTS_VALID"), (3, "HSTS_SHORT_MAX_AGE", "warn", "HSTS_VALID"), (3, "CONTENT_SECURITY_POLICY", "info", None),
    (3, "CSP_UNSAFE_INLINE", "warn", "CONTENT_SECURITY_POLICY"), (3, "CSP_UNSAFE_EVAL", "warn", "CONTENT_SECURITY_POLICY"),
    (4, "VARY_ASTERISK", "warn", None),
    (5, "FIELD_DEPRECATED", "warn", None), (5, "SINGLE_HEADER_REPEAT", "bad", None), (5, "DUPLICATE_KEY", "warn", None),
    (6, "BAD_SYNTAX_DETAILED", "bad", None), (6, "BAD_DATE_SYNTAX", "bad", None), (6, "SET_COOKIE_UNKNOWN_ATTRIBUTE", "info", None), (6, "SET_COOKIE_LIFETIME_TOO_LONG", "warn", None),
    (8, "UNKNOWN_VALUE", "warn", None), (8, "CC_DUP", "warn", None), (8, "BAD_CC_SYNTAX", "bad", None), (8, "CROSS_ORIGIN_RESOURCE_POLICY_BAD_VALUE", "bad", None),
    (9, "VARY_COMPLEX", "warn", None), (9, "HSTS_VALID", "good", None), (9, "CONTENT_SECURITY_POLICY", "info", None), (9, "STRUCTURED_FIELD_PARSE_ERROR", "bad", None),
    (10, "CC_WRONG_MESSAGE", "bad", None), (10, "CC_WRONG_MESSAGE", "bad", None),
    (11, "FIELD_DEPRECATED", "warn", None), (11, "FIELD_DEPRECATED", "warn", None), (11, "REQUEST_HDR_IN_RESPONSE", "bad", None), (11, "REQUEST_HDR_IN_RESPONSE", "bad", None),
]
#: By header list: note, variable, value.
VARS = [
    (0, "FRESHNESS_FRESH", "freshness_left_bucket", "1-24 hours"), (1, "FRESHNESS_FRESH", "freshness_left_bucket", "10-60 min"),
    (1, "CC_CONFLICTING", "directive_conflicts", "no-store → max-age"),
    (2, "FIELD_DEPRECATED", "field_name", "pragma"), (2, "FIELD_DEPRECATED", "field_name", "x-xss-protection"), (2, "REQUEST_HDR_IN_RESPONSE", "field_name", "pragma"),
    (5, "FIELD_DEPRECATED", "field_name", "feature-policy"), (5, "SINGLE_HEADER_REPEAT", "field_name", "content-type"),
    (5, "DUPLICATE_KEY", "field_name", "permissions-policy"), (5, "DUPLICATE_KEY", "field_name_key", "permissions-policy: geolocation"),
    (6, "BAD_SYNTAX_DETAILED", "field_name", "age"), (6, "BAD_DATE_SYNTAX", "field_name", "date"), (6, "SET_COOKIE_UNKNOWN_ATTRIBUTE", "attribute", "foo"), (6, "SET_COOKIE_LIFETIME_TOO_LONG", "duration_bucket", ">1 year"),
    (8, "UNKNOWN_VALUE", "field_name", "x-content-type-options"), (8, "UNKNOWN_VALUE", "value", "sniff"), (8, "CC_DUP", "directive", "max-age"), (8, "BAD_CC_SYNTAX", "bad_directive", "max-age"), (8, "CROSS_ORIGIN_RESOURCE_POLICY_BAD_VALUE", "value", "anything"),
    (9, "VARY_COMPLEX", "vary_count", "6"), (9, "STRUCTURED_FIELD_PARSE_ERROR", "field_error", "reporting-endpoints: member expected"), (9, "STRUCTURED_FIELD_PARSE_ERROR", "field_name", "reporting-endpoints"),
    (10, "CC_WRONG_MESSAGE", "other_message", "request"), (10, "CC_WRONG_MESSAGE", "other_message", "request"),
    (11, "FIELD_DEPRECATED", "field_name", "pragma"), (11, "FIELD_DEPRECATED", "field_name", "p3p"), (11, "REQUEST_HDR_IN_RESPONSE", "field_name", "cookie"), (11, "REQUEST_HDR_IN_RESPONSE", "field_name", "pragma"),
]
#: By header list: layers that headers alone show.
LAYERS = [(0, "nginx"), (1, "cloudflare"), (2, "apache"), (3, "cloudfront"), (4, "nginx"), (4, "fastly"), (5, "vercel"), (5, "nextjs"), (6, "azure-front-door"), (8, "akamai"), (10, "envoy"), (11, "nginx"), (11, "nuxt")]
#: By header list: cache directives with their values elided, Vary members, security headers; None where there are none.
CACHE = [(0, "max-age=N"), (0, "public"), (1, "private"), (1, "no-store"), (1, "max-age=N"), (2, "no-cache"), (2, "no-store"), (2, "must-revalidate"), (4, "max-age=N"), (4, "ext=N"), (4, "s-maxage=N"), (5, "public"), (5, "max-age=N"), (5, "must-revalidate"), (8, "s-maxage=N"), (8, "max-age=N"), (10, "only-if-cached"), (10, "max-stale=N"), (11, "no-cache")]
VARY = [(0, "accept-encoding"), (1, "cookie"), (1, "accept-encoding"), (1, "user-agent"), (4, "*"), (9, "accept"), (9, "accept-encoding"), (9, "accept-language"), (9, "cookie"), (9, "origin"), (9, "user-agent"), (10, "x-device"), (10, "accept-encoding")]
SECURITY = [
    (1, "strict-transport-security"), (1, "content-security-policy"), (1, "x-content-type-options"), (2, "x-frame-options"), (2, "x-xss-protection"),
    (3, "strict-transport-security"), (3, "content-security-policy"), (3, "x-frame-options"), (3, "x-content-type-options"), (4, "report-to"), (4, "nel"), (5, "permissions-policy"),
    (8, "cross-origin-resource-policy"), (8, "cross-origin-opener-policy"), (8, "referrer-policy"), (8, "x-content-type-options"), (9, "reporting-endpoints"), (9, "strict-transport-security"), (9, "content-security-policy"), (10, "origin-agent-cluster"),
]
#: By header list: pair, category; pairs that are not listed are ``neither``.
MOVES = [
    (1, "frame_options", "modern_only"), (2, "frame_options", "legacy_only"), (3, "frame_options", "both"),
    (4, "reporting", "legacy_only"), (9, "reporting", "modern_only"),
    (0, "expiry", "modern_only"), (1, "expiry", "modern_only"), (2, "expiry", "legacy_only"), (4, "expiry", "both"), (5, "expiry", "modern_only"), (8, "expiry", "modern_only"), (10, "expiry", "legacy_only"),
    (5, "permissions_policy", "both"), (2, "no_cache", "both"), (11, "no_cache", "both"), (2, "xss_protection", "legacy_only"),
]
#: By header list: histogram, bucket.
LIFETIMES = [
    (0, "cache_control_max_age", "1-24 hours"), (0, "freshness_lifetime", "1-24 hours"), (1, "cache_control_max_age", "10-60 min"), (1, "freshness_lifetime", "10-60 min"), (1, "hsts_max_age", "1-10 years"),
    (2, "cookie_lifetime", "1-7 days"), (2, "expires_date_delta", "negative"), (2, "freshness_lifetime", "negative"), (3, "age", "1-10 min"), (3, "hsts_max_age", "1-24 hours"),
    (4, "cache_control_s_maxage", "1-10 years"), (4, "freshness_lifetime", "1-7 days"), (4, "expires_date_delta", "1-7 days"), (5, "cache_control_max_age", "0"), (5, "freshness_lifetime", "0"),
    (6, "cookie_lifetime", "1-7 days"), (6, "cookie_lifetime", "1-10 years"), (8, "cache_control_s_maxage", "1-7 days"), (8, "cache_control_max_age", "<1 min"),
    (9, "hsts_max_age", "1-10 years"), (10, "expires_date_delta", "negative"), (10, "freshness_lifetime", "negative"),
]

_ROWS = [(k, i, n, v) for k, variant in enumerate(VARIANTS) for i, (n, v) in enumerate(variant)]
BASE = f"""WITH v(k, pos, name, value) AS ({values(_ROWS)}),
resp AS (SELECT page_id AS resp_id, url, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '')) AS site, page_id % {K} AS k,
  CASE WHEN page_id % 50 = 0 THEN NULL WHEN page_id % 13 = 0 THEN CASE WHEN page_id % 3 = 1 THEN 54113 ELSE 64510 END
       WHEN page_id % 4 = 1 AND page_id % 7 = 2 THEN 64502 WHEN page_id % 4 = 1 THEN 13335 WHEN page_id % 4 = 2 THEN 20940 ELSE 64500 END::BIGINT AS asn FROM pages),
hdr AS (SELECT resp_id, site, url, k, pos, name, value FROM resp JOIN v USING (k)),
fnd(k, note_id, level, parent) AS ({values(FOUND)}),
notes AS (SELECT resp_id, site, url, k, note_id, level, parent FROM resp JOIN fnd USING (k)),
fv(k, note_id, var, val) AS ({values(VARS)}),
vars AS (SELECT resp_id, site, url, k, note_id, var, val FROM resp JOIN fv USING (k)),
lk(k, layer) AS ({values(LAYERS)}),
lay AS (SELECT resp_id, layer FROM resp JOIN lk USING (k)
  UNION SELECT resp_id, CASE asn WHEN 13335 THEN 'cloudflare' WHEN 54113 THEN 'fastly' WHEN 20940 THEN 'akamai' END FROM resp WHERE asn IN (13335, 54113, 20940)),
ck(k, token) AS ({values(CACHE)}), cc AS (SELECT resp_id, site, token FROM resp JOIN ck USING (k)),
vk(k, token) AS ({values(VARY)}), vary AS (SELECT resp_id, site, token FROM resp JOIN vk USING (k)),
sk(k, token) AS ({values(SECURITY)}), sec AS (SELECT resp_id, site, token FROM resp JOIN sk USING (k)),
mk(k, pair, category) AS ({values(MOVES)}),
pk(ord, pair, legacy, modern, legacy_only_pair) AS (VALUES (0, 'frame_options', 'X-Frame-Options', 'CSP frame-ancestors', false), (1, 'reporting', 'Report-To', 'Reporting-Endpoints', false),
  (2, 'expiry', 'Expires', 'Cache-Control: max-age', false), (3, 'permissions_policy', 'Feature-Policy', 'Permissions-Policy', false), (4, 'no_cache', 'Pragma: no-cache', 'Cache-Control: no-cache', false), (5, 'xss_protection', 'X-XSS-Protection', '(no replacement)', true)),
moves AS (SELECT r.resp_id, r.site, p.pair, coalesce(m.category, 'neither') AS category FROM resp r CROSS JOIN pk p LEFT JOIN mk m ON m.k = r.k AND m.pair = p.pair),
hk(k, histogram, bucket) AS ({values(LIFETIMES)}),
bytes AS (SELECT resp_id, name, strlen(name) + strlen(value) + 4 AS n FROM hdr WHERE name NOT LIKE 'x-crawler-%'),
bun AS (SELECT r.resp_id, r.site, coalesce(string_agg(s.token, ', ' ORDER BY s.token), '(none)') AS bundle FROM resp r LEFT JOIN sec s ON s.resp_id = r.resp_id GROUP BY 1, 2),
fired AS (SELECT DISTINCT resp_id, site, note_id FROM notes WHERE level IN ('bad', 'warn'))
"""
