"""Counts of responses, headers, bytes, layers, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headloom import config
from headloom.functions import headers as H
from headloom.functions.counting import rows_in
from headloom.functions import text as T
from headloom.plans.enrich import header_rows
from headloom.plans.rules import RANK


UNMATCHED = "__unmatched__"


def total_responses(e: DataFrame) -> DataFrame:
    return e.agg(rows_in().alias("responses"))


def field_counts(e: DataFrame) -> DataFrame:
    """Occurrences of each header name."""
    return header_rows(e).groupBy("name").agg(rows_in().alias("occ"))


def unregistered(e: DataFrame) -> DataFrame:
    """Responses that carry each unregistered name; names that the crawler adds don't count."""
    rows = e.select(F.explode(F.array_distinct(H.names(F.col("headers")))).alias("name"))
    return rows.filter(~H.is_registered(F.col("name")) & ~H.from_crawler(F.col("name"))).groupBy("name").agg(rows_in().alias("responses"))


def severity(e: DataFrame) -> DataFrame:
    """Responses by their most severe finding; ``clean`` without any."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    most = F.array_max(F.transform("notes", lambda n: F.coalesce(F.try_element_at(rank, n["level"]), F.lit(0))))
    names = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (v, k)])
    label = F.coalesce(F.try_element_at(names, most), F.lit("clean"))
    return e.select(label.alias("severity")).groupBy("severity").agg(rows_in().alias("responses"))


def header_bytes(e: DataFrame) -> DataFrame:
    """Bytes of each header over all its lines, framing included."""
    rows = e.select(F.explode("headers").alias("h")).filter(~H.from_crawler(F.col("h.name")))
    return rows.groupBy(F.col("h.name").alias("name")).agg(F.sum(H.line_bytes(F.col("h"))).alias("bytes"))


def mean_bytes(e: DataFrame) -> DataFrame:
    """Bytes, lines and mean size of each header."""
    return means_of(header_bytes(e), field_counts(e))


def means_of(sizes: DataFrame, counts: DataFrame) -> DataFrame:
    both = sizes.join(counts, "name")
    return both.select("name", "bytes", "occ", F.round(F.col("bytes") / F.col("occ"), 6).alias("mean"))


def _block(e: DataFrame) -> DataFrame:
    own = F.filter("headers", lambda h: ~H.from_crawler(h["name"]))
    return e.select(F.aggregate(own, F.lit(0).cast("long"), lambda s, h: s + H.line_bytes(h)).alias("bytes"))


def total_header_bytes(e: DataFrame) -> DataFrame:
    return _block(e).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_header_bytes"))


def block_histogram(e: DataFrame) -> DataFrame:
    """Responses by the size of their header block."""
    rows = _block(e).select(T.bucket(F.col("bytes"), T.BYTES).alias("bucket"))
    return rows.groupBy("bucket").agg(rows_in().alias("responses")).withColumn("ord", T.bucket_rank(F.col("bucket"), T.BYTES))


def category_bytes(e: DataFrame) -> DataFrame:
    """Bytes in standard, deprecated and proprietary headers."""
    return categories_of(header_bytes(e))


#: Single headers that a report of bytes points at.
CALLOUTS = ["set-cookie", "content-security-policy"]


def byte_callouts(e: DataFrame) -> DataFrame:
    """Bytes of the headers in ``CALLOUTS`` that occur, and their per cent of all header bytes."""
    return callouts_of(header_bytes(e))


def callouts_of(sizes: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.sum(F.when(F.col("name") == n, F.col("bytes"))).alias("bytes")) for n in CALLOUTS])
    rows = sizes.agg(F.sum("bytes").alias("whole"), each.alias("each")).select("whole", F.explode("each").alias("x")).filter("x.bytes > 0")
    return rows.select("x.name", "x.bytes", F.round(F.col("x.bytes") * 100.0 / F.col("whole"), 6).alias("pct"))


def categories_of(sizes: DataFrame) -> DataFrame:
    kinds = sizes.sparkSession.createDataFrame([("standard",), ("deprecated",), ("proprietary",)], "category string")
    sums = sizes.groupBy(H.category(F.col("name")).alias("category")).agg(F.sum("bytes").alias("bytes"))
    return kinds.join(sums, "category", "left").na.fill(0, ["bytes"])


def policy_sizes(e: DataFrame) -> DataFrame:
    """Per site the largest response's bytes of content security policy; 0 where a site has none."""
    lines = H.values(F.col("headers"), "content-security-policy")
    size = F.aggregate(lines, F.lit(0).cast("long"), lambda s, v: s + F.octet_length(v))
    return e.filter("site is not null").select("site", size.alias("size")).groupBy("site").agg(F.max("size").alias("size"))


def policy_buckets(e: DataFrame) -> DataFrame:
    return policy_buckets_of(policy_sizes(e))


def policy_buckets_of(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy(T.policy_bucket(F.col("size")).alias("bucket")).agg(rows_in().alias("sites"))


def layer_counts(e: DataFrame) -> DataFrame:
    """Responses by layer; a response may have several, and ``__unmatched__`` has none."""
    return e.select(F.explode_outer("layers").alias("l")).groupBy(F.coalesce("l", F.lit(UNMATCHED)).alias("layer")).agg(rows_in().alias("responses"))


def field_by_layer(e: DataFrame) -> DataFrame:
    return header_rows(e).select("name", F.explode("layers").alias("layer")).groupBy("name", "layer").agg(rows_in().alias("occ"))


def asn_counts(e: DataFrame) -> DataFrame:
    return e.filter("asn is not null").groupBy("asn").agg(rows_in().alias("responses"))


def networks(counts: DataFrame) -> DataFrame:
    """Operator and layer of each network; null where none is known."""
    names = [x for k, v in config.fields().asn_operators.items() for x in (F.lit(k), F.lit(v))]
    layer = F.when(F.lit(False), "")
    for x in config.layers():
        if x.asns:
            layer = layer.when(F.col("asn").isin(list(x.asns)), x.id)
    return counts.withColumns({"operator": F.try_element_at(F.create_map(*names), F.col("asn").cast("int")), "layer": layer})


def layer_roles(counts: DataFrame) -> DataFrame:
    """Role of each layer; empty where the table has none."""
    role = F.create_map(*[x for layer in config.layers() for x in (F.lit(layer.id), F.lit(layer.role))])
    return counts.withColumn("role", F.coalesce(F.try_element_at(role, F.col("layer")), F.lit("")))


def value_histograms(e: DataFrame) -> DataFrame:
    """Seven lifetimes that headers declare, in buckets."""
    h = F.col("headers")

    def directive(name: str):
        hits = F.filter(H.cache_pairs(h), lambda x: x["name"] == name)
        return F.transform(hits, lambda x: F.when(x["value"].rlike(r"^-?\d+$"), x["value"].try_cast("double")))

    def number(name: str, pattern: str):
        return F.array(F.regexp_extract(F.lower(H.last_value(h, name)), pattern, 1).try_cast("double"))

    def cookie(v):
        age = F.regexp_extract(v, r"(?i);\s*max-age\s*=\s*(-?\d+)", 1).try_cast("double")
        until = T.http_date(F.regexp_extract(v, r"(?i);\s*expires\s*=\s*([^;]+)", 1))
        return F.coalesce(age, until - F.floor("crawl_ts"))

    expires, date = T.http_date(H.last_value(h, "expires")), T.http_date(H.last_value(h, "date"))
    delta = expires - F.coalesce(date, F.floor("crawl_ts"))
    age = F.try_element_at(directive("max-age"), F.lit(1))
    found = {
        "cache_control_max_age": directive("max-age"),
        "cache_control_s_maxage": directive("s-maxage"),
        "age": number("age", r"^\s*(\d+)\s*$"),
        "hsts_max_age": number("strict-transport-security", r"max-age\s*=\s*\"?(\d+)"),
        "cookie_lifetime": F.transform(H.values(h, "set-cookie"), cookie),
        "freshness_lifetime": F.array(F.coalesce(age, F.when(~H.has(h, "cache-control") | age.isNull(), delta.cast("double")))),
        "expires_date_delta": F.array(delta.cast("double")),
    }

    def named(k: str):
        return lambda x: F.struct(F.lit(k).alias("histogram"), x.cast("double").alias("x"))

    rows = [F.transform(v, named(k)) for k, v in found.items()]
    rows = e.select(F.explode(F.concat(*rows)).alias("r")).filter("r.x is not null")
    rows = rows.select("r.histogram", T.bucket(F.col("r.x"), T.LIFETIME).alias("bucket"))
    return rows.groupBy("histogram", "bucket").agg(rows_in().alias("occ"))
