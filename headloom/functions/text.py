"""Sites, buckets, redaction, dates, latin-1: scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values: (label, exclusive upper bound); the last bucket takes the rest.
DURATION = [("<1 min", 60), ("1-10 min", 600), ("10-60 min", 3600), ("1-24 hours", 86400), ("1-7 days", 604800), ("7-30 days", 2592000), ("30-365 days", 31536000), (">1 year", None)]
BYTES = [("<256 B", 256), ("256-1023 B", 1024), ("1-4 KB", 4096), ("4-8 KB", 8192), ("8-16 KB", 16384), ("16-32 KB", 32768), ("32+ KB", None)]
LIFETIME = [("negative", 0), ("0", 0), *DURATION[:-1], ("1-10 years", 315360000), (">10 years", None)]
#: Inclusive ranges of policy sizes in bytes.
POLICY_SIZE = [("No CSP header", 0), ("1-99 B", 99), ("100-499 B", 499), ("500-999 B", 999), ("1000-1999 B", 1999), ("2000-4999 B", 4999), ("5000-9999 B", 9999), ("10000+ B", None)]
#: Query parameters and headers whose values are secrets.
SECRET_PARAMS = ["signature", "sig", "s", "token", "access_token", "auth", "key", "apikey", "api_key", "hmac", "x-amz-signature", "x-amz-security-token", "x-goog-signature"]
SECRET_HEADERS = ["set-cookie", "set-cookie2", "cookie", "authorization", "proxy-authorization", "www-authenticate", "proxy-authenticate"]
RAW_VARS = ["value", "context"]
MAX_VALUE = 300


@F.pandas_udf(StringType())
def _to_ascii(hosts):
    import idna

    def one(host):
        try:
            return idna.encode(host, uts46=True).decode("ascii")
        except UnicodeError:
            return host

    return hosts.map(one, na_action="ignore")


def site(url: Column | str) -> Column:
    """Host of a URL (or a bare host, whose port stays), lower case, without one leading ``www.``; null if there is
    none. Only hosts that aren't ASCII take the Python branch."""
    url = F.col(url) if isinstance(url, str) else url
    # authority after "//", without user info and port; brackets of an IPv6 address go
    authority = F.regexp_extract(url, r"^[^:/?#]*:?//([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":.*$", ""))
    host = F.when(F.contains(url, F.lit("://")), host).otherwise(url)
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when(F.length(F.coalesce(url, F.lit(""))) == 0, None).when(host == "", None).when(host.rlike(r"[^\x00-\x7F]"), _to_ascii(F.when(host.rlike(r"[^\x00-\x7F]"), host))).otherwise(host)


def bucket(value: Column, table: list) -> Column:
    """First label whose bound exceeds the value."""
    if table is LIFETIME:
        out = F.when(value < 0, "negative").when(value == 0, "0")
        table = table[2:]
        for label, high in table[:-1]:
            out = out.when(value < high, label)
    else:
        (label, high), *rest = table
        out = F.when(value < high, label)
        for label, high in rest[:-1]:
            out = out.when(value < high, label)
    return F.when(value.isNotNull(), out.otherwise(table[-1][0]))


def policy_bucket(size: Column) -> Column:
    (label, high), *rest = POLICY_SIZE
    out = F.when(size <= high, label)
    for label, high in rest[:-1]:
        out = out.when(size <= high, label)
    return out.otherwise(POLICY_SIZE[-1][0])


def bucket_rank(label: Column, table: list) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x, _ in table]), label).cast("int")


def redact(value: Column) -> Column:
    """Values of secret query parameters give way to ``[redacted]``."""
    names = "|".join(x.replace("-", r"\-") for x in SECRET_PARAMS)
    return F.regexp_replace(value, rf"(?i)([?&](?:{names})=)[^&\s]+", "$1[redacted]")


def shown_value(field: Column, value: Column) -> Column:
    """A header value for display: none for secret headers, redacted and cut for others."""
    clean = redact(value)
    cut = F.when(F.length(clean) > MAX_VALUE, F.concat(F.left(clean, F.lit(MAX_VALUE)), F.lit("…[truncated]"))).otherwise(clean)
    return F.when(F.lower(field).isin(SECRET_HEADERS), None).otherwise(cut)


def latin1(text: Column) -> Column:
    """Characters outside latin-1 become question marks."""
    return F.regexp_replace(text, "[^\\u0000-\\u00FF]", "?")


def http_date(text: Column) -> Column:
    """Seconds since 1970 of the three date forms of RFC 9110, or null."""
    t = F.trim(text)
    fixed = F.regexp_extract(t, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    short = F.regexp_extract(t, r"^\w+, (\d{2}-\w{3}-\d{2} \d{2}:\d{2}:\d{2}) GMT$", 1)
    # years of two digits are those from 1969 on
    old = F.regexp_replace(F.regexp_replace(short, r"-((?:69|[789]\d) )", "-19$1"), r"-(\d{2} )", "-20$1")
    plain = F.regexp_replace(F.regexp_extract(t, r"^\w{3} (\w{3} [ \d]\d \d{2}:\d{2}:\d{2} \d{4})$", 1), "  ", " 0")
    found = F.coalesce(
        F.try_to_timestamp(F.nullif(fixed, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(F.nullif(old, F.lit("")), F.lit("dd-MMM-yyyy HH:mm:ss")),
        F.try_to_timestamp(F.nullif(plain, F.lit("")), F.lit("MMM dd HH:mm:ss yyyy")),
    )
    return F.unix_timestamp(found)


def failure(exit_code: Column) -> Column:
    """Bucket of a worker's exit code."""
    named = {-9: "sigkill", -11: "sigsegv", -10: "sigbus", -15: "sigterm"}
    out = F.when(exit_code.isNull(), "warc_exit_unknown").when(exit_code == 0, "warc_exit_zero").when(exit_code > 0, "warc_exit_nonzero")
    for code, name in named.items():
        out = out.when(exit_code == code, f"warc_signal_{name}")
    return out.otherwise("warc_signal_other")
