"""Responses over the test tables, which hold no HTTP headers: every page gets one of a few header lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.functions.text import site
from headloom.plans.enrich import enrich
from headloom.sources.tables import prefixes

CRAWL_TS = 1782728294.0  # Mon, 29 Jun 2026 10:18:14 GMT

VARIANTS: list[list[tuple[str, str]]] = [
    [("date", "Mon, 29 Jun 2026 10:18:14 GMT"), ("server", "nginx/1.25"), ("content-type", "text/html"), ("cache-control", "max-age=3600, public"), ("vary", "Accept-Encoding"), ("x-crawler-content-length", "100")],
    [("server", "cloudflare"), ("cf-ray", "8a1-FRA"), ("cf-cache-status", "HIT"), ("strict-transport-security", "max-age=31536000; includeSubDomains"), ("content-security-policy", "default-src 'self'; frame-ancestors 'none'"), ("x-content-type-options", "nosniff"), ("vary", "Cookie, accept-encoding"), ("vary", "User-Agent"), ("cache-control", "private"), ("cache-control", "no-store, max-age=600")],
    [("server", "Apache/2.4"), ("pragma", "no-cache"), ("expires", "Thu, 01 Jan 1970 00:00:00 GMT"), ("date", "Mon, 29 Jun 2026 10:18:14 GMT"), ("cache-control", "no-cache, no-store, must-revalidate"), ("x-frame-options", "SAMEORIGIN"), ("x-xss-protection", "1; mode=block"), ("set-cookie", "sid=abc; Path=/; HttpOnly; Max-Age=86400")],
    [("x-amz-cf-id", "k1"), ("x-amz-cf-pop", "FRA56"), ("via", "1.1 abc.cloudfront.net (CloudFront)"), ("x-cache", "Hit from cloudfront"), ("age", "120"), ("strict-transport-security", "max-age=3600"), ("content-security-policy", "script-src 'unsafe-inline' 'unsafe-eval'"), ("content-security-policy", "frame-ancestors 'self'"), ("x-frame-options", "DENY"), ("x-content-type-options", "nosniff")],
    [("server", "nginx"), ("x-served-by", "cache-1"), ("x-timer", "S1"), ("vary", "*"), ("cache-control", 'max-age="60", ext="a,b", s-maxage=31536000'), ("expires", "Tue, 30 Jun 2026 10:18:14 GMT"), ("report-to", "{}"), ("nel", "{}")],
    [("x-powered-by", "Next.js"), ("x-vercel-id", "fra1"), ("x-vercel-cache", "HIT"), ("x-nextjs-cache", "HIT"), ("content-type", "text/html"), ("content-type", "text/plain"), ("cache-control", "public, max-age=0, must-revalidate"), ("permissions-policy", "geolocation=(), geolocation=()"), ("feature-policy", "camera 'none'")],
    [("server", "Microsoft-IIS/10"), ("x-azure-ref", "z1"), ("x-aspnet-version", "4.0"), ("set-cookie", "a=1; Expires=Wed, 01 Jul 2026 10:18:14 GMT; Foo=1"), ("set-cookie", "b=2; Max-Age=99999999"), ("set-cookie", "c=3"), ("age", "soon"), ("date", "yesterday")],
    [],
    [("server-timing", "ak_p; desc=1"), ("akamai-grn", "0.1"), ("x-akamai-transformed", "9"), ("cross-origin-resource-policy", "anything"), ("cross-origin-opener-policy", "same-origin"), ("referrer-policy", "no-referrer"), ("x-content-type-options", "sniff"), ("cache-control", "s-maxage=86400, max-age=abc, max-age=5")],
    [("vary", "accept, accept-encoding, accept-language, cookie, origin, user-agent"), ("reporting-endpoints", "default=\"https://r.example/x?token=SEKRET&p=1\","), ("x-ab-bucket", "7"), ("x-request-id", "q"), ("strict-transport-security", "max-age=63072000; includeSubDomains; preload"), ("content-security-policy", "upgrade-insecure-requests")],
    [("server", "envoy"), ("x-envoy-upstream-service-time", "5"), ("expires", "Sun, 28 Jun 2026 10:18:14 GMT"), ("date", "Mon, 29 Jun 2026 10:18:14 GMT"), ("cache-control", "only-if-cached, max-stale=5"), ("x-device", "m"), ("vary", "X-Device, Accept-Encoding"), ("origin-agent-cluster", "?1")],
    [("server", "nginx"), ("x-powered-by", "Nuxt"), ("access-control-allow-origin", "*"), ("cookie", "x=1"), ("cache-control", "no-cache"), ("pragma", "x, No-Cache"), ("x-proxy-cache", "MISS"), ("x-custom", "é"), ("p3p", "CP=x")],
]
PREFIXES = ["# prefix\tlength\tas", "10.0.0.0\t8\t64500", "10.1.0.0\t16\t13335", "10.1.2.0\t24\t64502_64503", "10.1.2.9\t24\t1", "10.2.0.0\t16\t20940", "2001:db8::\t32\t{64510,64511}", "2001:db8:1::\t48\t54113", "junk\tx\ty"]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page n has header list n modulo their number, and an address made from n."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("resp_id"), "url")
    n, k = F.col("resp_id"), len(VARIANTS)
    lists = F.array(*[F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("value")) for a, b in v]) if v else F.array().cast("array<struct<name:string,value:string>>") for v in VARIANTS])
    text = lambda c: c.cast("string")
    ip = F.when(n % 50 == 0, "10.1.2").when(n % 13 == 0, F.concat(F.lit("2001:db8:"), text(n % 3), F.lit("::1")))
    ip = ip.otherwise(F.concat_ws(".", F.lit("10"), text(n % 4), text(n % 7), text(n % 250)))
    status = F.when(n % 9 == 0, "404").otherwise("200")
    return pages.select("resp_id", "url", site("url").alias("site"), ip.alias("ip"), F.lit(CRAWL_TS).alias("crawl_ts"), status.alias("status"), lists[(n % k).cast("int")].alias("headers"))


def prefix_table(spark: SparkSession) -> DataFrame:
    return prefixes(spark.createDataFrame([(x,) for x in PREFIXES], "value string").coalesce(1))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(responses(spark, sf_dir), prefix_table(spark))
