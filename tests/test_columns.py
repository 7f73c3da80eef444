import pytest
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions import hll
from headloom.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


def headers(*rows):
    return F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("value")) for a, b in rows])


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.Example.com/x", "example.com"), ("http://user:pw@a.example:8080/p?q#f", "a.example"), ("http://[::1]:80/", "::1"), ("http://", None), ("", None), (None, None),
        ("www.example.com", "example.com"), ("example.com:8080", "example.com:8080"), ("http://a_b.example/", "a_b.example"), ("https://faß.de/", "xn--fa-hia.de"), ("https://www.münchen.de", "xn--mnchen-3ya.de"),
        ("http://www.www.example/", "www.example"),
    ],
)
def test_site(spark, url, want):
    assert one(spark, T.site("u"), u=url) == want


def test_buckets(spark):
    x = F.col("x")
    cases = [(T.DURATION, 59.0, "<1 min"), (T.DURATION, 60.0, "1-10 min"), (T.DURATION, 1e9, ">1 year"), (T.LIFETIME, -1.0, "negative"), (T.LIFETIME, 0.0, "0"), (T.LIFETIME, 31536000.0, "1-10 years"), (T.LIFETIME, 1e12, ">10 years"), (T.LIFETIME, float("nan"), ">10 years"), (T.BYTES, 255.0, "<256 B"), (T.BYTES, 32768.0, "32+ KB")]
    for table, value, want in cases:
        assert one(spark, T.bucket(x, table), x=value) == want
    assert [one(spark, T.policy_bucket(x), x=v) for v in (0, 1, 99, 100, 10000)] == ["No CSP header", "1-99 B", "1-99 B", "100-499 B", "10000+ B"]
    assert one(spark, T.bucket_rank(F.lit("1-4 KB"), T.BYTES)) == 3


def test_redaction(spark):
    url = "/cb?token=SEKRET&x-amz-signature=ZZZ&p=1"
    assert one(spark, T.redact(F.col("v")), v=url) == "/cb?token=[redacted]&x-amz-signature=[redacted]&p=1"
    assert one(spark, T.redact(F.col("v")), v="?TOKEN=a b") == "?TOKEN=[redacted] b"
    assert one(spark, T.shown_value(F.lit("Set-Cookie"), F.col("v")), v="sid=1") is None
    assert one(spark, T.shown_value(F.lit("server"), F.col("v")), v="x" * 400) == "x" * 300 + "…[truncated]"


def test_dates(spark):
    for text in ("Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994"):
        got = one(spark, T.http_date(F.col("d")), d=text)
        assert got in (784111777, 784111777 + 3155760000)  # two-digit years may be read in this century
    assert one(spark, T.http_date(F.col("d")), d="0") is None


def test_latin1_and_failures(spark):
    assert one(spark, T.latin1(F.col("s")), s="aé€") == "aé?"
    codes = {-9: "warc_signal_sigkill", -11: "warc_signal_sigsegv", -10: "warc_signal_sigbus", -15: "warc_signal_sigterm", -1: "warc_signal_other", 0: "warc_exit_zero", 1: "warc_exit_nonzero", 137: "warc_exit_nonzero"}
    for code, want in codes.items():
        assert one(spark, T.failure(F.col("c")), c=code) == want
    assert one(spark, T.failure(F.lit(None).cast("int"))) == "warc_exit_unknown"


def test_recipes_and_pairs(spark):
    tokens = F.array(*[F.lit(x) for x in ("b", "a", "b", "c")])
    assert one(spark, H.recipe(tokens)) == "a, b, c"
    assert one(spark, H.recipe_tokens(F.lit("a, b"))) == ["a", "b"] and one(spark, H.recipe_tokens(F.lit(""))) == []
    assert one(spark, H.pairs(tokens)) == ["a, b", "a, c", "b, c"]
    empty = F.array().cast("array<string>")
    assert one(spark, H.pairs(empty)) == [] and one(spark, H.bundle(empty)) == "(none)"


def test_cache_control(spark):
    assert one(spark, H.cache_tokens(headers(("cache-control", "max-age=5, max-age=10")))) == ["max-age=N", "max-age=N"]
    got = one(spark, H.cache_tokens(headers(("cache-control", 'Private="a,b", No-Store,, '), ("cache-control", "no-cache=None, =x"))))
    assert got == ["private=N", "no-store", "no-cache"]
    assert one(spark, H.token_name(F.lit("max-age=N"))) == "max-age"


def test_vary_csp_pragma(spark):
    assert one(spark, H.vary_tokens(headers(("vary", "Cookie, ,X"), ("vary", "*")))) == ["cookie", "x", "*"]
    assert one(spark, H.csp_directives(headers(("content-security-policy", "Default-Src 'self'; ;  img-src *")))) == ["default-src", "img-src"]
    assert one(spark, H.pragma_no_cache(headers(("pragma", "a,No-Cache")))) and not one(spark, H.pragma_no_cache(headers(("pragma", "no-cachex"))))


def test_names(spark):
    name = F.col("n")
    prefixes = {"x-amz-cf-id": "x-amz", "x-forwarded-for": "x-forwarded", "x-cache": "x-cache", "cf-ray": "cf", "p3p": "p3p", "surrogate-key": "surrogate"}
    for n, want in prefixes.items():
        assert one(spark, H.name_prefix(name), n=n) == want
    assert one(spark, H.family(name), n="x-proxy-cache") == "caching" and one(spark, H.family(name), n="zzz") == "__other__"
    assert one(spark, H.category(name), n="pragma") == "deprecated" and one(spark, H.category(name), n="x-cache") == "standard" and one(spark, H.category(name), n="cf-ray") == "proprietary"
    assert one(spark, H.vendor(name), n="x-amz-cf-id") == "cloudfront" and one(spark, H.vendor(name), n="cf-new") == "cloudflare" and one(spark, H.vendor(name), n="x-amz-request-id") is None
    assert one(spark, H.well_known(name), n="x-request-id") and not one(spark, H.well_known(name), n="x-own")


def test_layers(spark):
    rows = [("server", "CloudFlare"), ("via", "1.1 x (CloudFront)"), ("server-timing", "cdn, AK_P; d=1"), ("x-nextjs-cache", "")]
    assert one(spark, H.matched_layers(headers(*rows))) == ["cloudflare", "cloudfront", "akamai", "nextjs"]
    assert one(spark, H.matched_layers(headers(("a", "b")), F.lit(54113))) == ["fastly"]
    assert one(spark, H.matched_layers(headers(("server-timing", "xak_px")), F.lit(None).cast("long"))) == []


def python_hll(items, p):
    import math
    import zlib

    m = 1 << p
    reg = [0] * m
    for x in items:
        h = zlib.crc32(x.encode())
        rest = h >> p
        reg[h & (m - 1)] = max(reg[h & (m - 1)], 32 - p - rest.bit_length() + 1)
    e = 0.7213 / (1 + 1.079 / m) * m * m / sum(2.0**-r for r in reg)
    zeros = reg.count(0)
    return int(m * math.log(m / zeros) if e <= 2.5 * m and zeros else e)


@pytest.mark.parametrize("p", [6, 8, 12])
@pytest.mark.parametrize("n", [1, 100, 1000, 5000])
def test_hll_equals_the_formula(spark, p, n):
    items = [f"site-{i}.example" for i in range(n)]
    df = spark.createDataFrame([(1, x) for x in items * 2] + [(1, ""), (1, None)], "k int, s string")
    assert hll.estimate(hll.registers(df, ["k"], "s", p), ["k"], p).first()["sites"] == python_hll(items, p)
