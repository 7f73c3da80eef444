"""Crawl metadata archives (WAT) as a DataFrame of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.functions.text import latin1, site

RESPONSE = (
    "resp_id long, url string, site string, ip string, crawl_ts double, status string, reason string, version string, "
    "headers array<struct<name: string, value: string>>"
)
_RECORD = (
    "Envelope struct<`WARC-Header-Metadata`: struct<`WARC-Target-URI`: string, `WARC-IP-Address`: string, `WARC-Date`: string>, "
    "`Payload-Metadata`: struct<`HTTP-Response-Metadata`: struct<`Response-Message`: struct<Status: string, Reason: string, Version: string>, "
    "Headers: map<string, variant>>>>"
)


def read_lines(spark: SparkSession, paths: str | list[str], record_limit: int = 0) -> DataFrame:
    """JSON lines of metadata records: path, line. With ``record_limit``, the first so many of each file, in
    file order (a whole gzip file is one task, so the order within it is that of its lines)."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("line")).filter(F.col("line").startswith("{"))
    if record_limit:
        from pyspark.sql import Window

        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        place = F.row_number().over(Window.partitionBy("path").orderBy("at"))
        lines = numbered.withColumn("nth", place).filter(F.col("nth") <= record_limit).drop("at", "nth")
    return lines


def header_list(raw: Column) -> Column:
    """``map<name, variant>`` to a header list. A JSON array gives one header a member; anything else gives one, a string
    its own text and another value its JSON text. Of a name that a record repeats, the last value counts."""
    entries = F.map_entries(raw)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))

    def lines(e: Column) -> Column:
        many = F.try_variant_get(e["value"], "$", "array<string>")
        texts = F.coalesce(many, F.array(F.try_variant_get(e["value"], "$", "string")))
        return F.transform(texts, lambda v: F.struct(F.lower(latin1(e["key"])).alias("name"), latin1(F.coalesce(v, F.lit("null"))).alias("value")))

    return F.flatten(F.transform(last, lines))


def parse_responses(lines: DataFrame) -> DataFrame:
    """Responses, and only lines that are JSON and hold response metadata; malformed lines give null and go (text
    after a whole record is not looked at). Header
    values stay typed, so that a string which looks like an array is one value."""
    record = F.from_json("line", _RECORD)
    rows = lines.withColumn("r", record)
    meta, head = F.col("r.Envelope.`Payload-Metadata`.`HTTP-Response-Metadata`"), F.col("r.Envelope.`WARC-Header-Metadata`")
    rows = rows.filter(meta.isNotNull()).select(
        "path",
        head["WARC-Target-URI"].alias("url"),
        head["WARC-IP-Address"].alias("ip"),
        F.unix_timestamp(F.try_to_timestamp(head["WARC-Date"])).cast("double").alias("crawl_ts"),
        meta["Response-Message"]["Status"].alias("status"),
        F.coalesce(meta["Response-Message"]["Reason"], F.lit("")).alias("reason"),
        F.coalesce(meta["Response-Message"]["Version"], F.lit("HTTP/1.1")).alias("version"),
        F.coalesce(header_list(meta["Headers"]), F.array().cast("array<struct<name: string, value: string>>")).alias("headers"),
    )
    return rows.select(F.monotonically_increasing_id().alias("resp_id"), "url", site("url").alias("site"), "ip", "crawl_ts", "status", latin1(F.col("reason")).alias("reason"), latin1(F.col("version")).alias("version"), "headers")


def read_wat(spark: SparkSession, paths: str | list[str], record_limit: int = 0) -> DataFrame:
    return parse_responses(read_lines(spark, paths, record_limit))


def outcome(line: Column) -> Column:
    """malformed, no_response or response."""
    record = F.from_json(line, _RECORD)
    meta = record["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    return F.when(record["Envelope"].isNull(), "malformed").when(meta.isNull(), "no_response").otherwise("response")


def parse_outcomes(lines: DataFrame) -> DataFrame:
    """How many lines parsed, were malformed, or held no response, by a pass of its own; ``plans.outcomes`` counts
    them in the scan itself."""
    return lines.groupBy(outcome(F.col("line")).alias("outcome")).count()
