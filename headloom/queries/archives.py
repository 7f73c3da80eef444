"""Queries over archives that are made from the test tables, whose SQL starts from the same strings."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.operators import findings
from headloom.plans import rules
from headloom.plans.enrich import enrich
from headloom.sources import warc, wat
from headloom.sources.scratch import ARROW_BYTES, each_row, shared_path, small_batches

#: JSON members of a record's headers, as text made from n that Spark and SQL both evaluate.
_MEMBERS = [
    """CASE WHEN n % 2 = 0 THEN '"Server":"nginx/1.' || CAST(n % 30 AS STRING) || '"' END""",
    """CASE WHEN n % 3 = 0 THEN '"Vary":["Accept-Encoding","X-' || CAST(n % 7 AS STRING) || '"]' END""",
    """CASE WHEN n % 5 = 0 THEN '"X-List":"[1,' || CAST(n AS STRING) || ']"' END""",
    """CASE WHEN n % 7 = 0 THEN '"X-Empty":"[]"' END""",
    """CASE WHEN n % 7 = 1 THEN '"X-None":[]' END""",
    """CASE WHEN n % 11 = 0 THEN '"Age":' || CAST(n AS STRING) END""",
    """CASE WHEN n % 13 = 0 THEN '"Set-Cookie":["a=1","b=[2]",' || CAST(n % 5 AS STRING) || ']' END""",
]
_HEAD = '''"WARC-Target-URI":"' || url || '","WARC-IP-Address":"10.0.0.1","WARC-Date":"2026-06-29T10:18:14Z"'''
_WHOLE = (
    f"""'{{"Envelope":{{"WARC-Header-Metadata":{{{_HEAD}}},"Payload-Metadata":{{' || CASE WHEN n % 17 = 0 THEN '"HTTP-Request-Metadata":{{}}' """
    f"""ELSE '"HTTP-Response-Metadata":{{"Response-Message":{{"Status":"200","Reason":"OK"}},"Headers":{{' || concat_ws(',', {', '.join(_MEMBERS)}) || '}}}}' END || '}}}}}}'"""
)
_LINE = f"CASE WHEN n % 19 = 0 THEN left({_WHOLE}, 150) ELSE {_WHOLE} END"  # some lines are cut short


def wat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"), "url")
    return pages.select(F.lit("made").alias("path"), F.expr(_LINE).alias("line"))


def _wat_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wat.parse_responses(wat_lines(spark, sf_dir)).select("url", F.explode("headers").alias("h"))
    return rows.groupBy("url", "h.name", "h.value").agg(F.count(F.lit(1)).alias("occ"))


_WAT_SQL = f"""
WITH lines AS (SELECT url, {_LINE} AS line FROM (SELECT page_id AS n, url FROM pages)),
heads AS (SELECT url, json_extract(line, '$.Envelope.Payload-Metadata.HTTP-Response-Metadata.Headers') AS h FROM lines WHERE json_valid(line)),
members AS (SELECT url, lower(e.key) AS name, e.value AS v FROM heads, json_each(h) AS e),
texts AS (
  SELECT url, name, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END) AS x FROM members
)
SELECT url, name, CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE CAST(x AS VARCHAR) END AS value, count(*) AS occ FROM texts GROUP BY ALL
"""

KINDS = 12


def _coded(html: bytes, kind: int) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and body of a page sent in one of ``KINDS`` ways; six of them are unsound."""
    packed, flat, small = gzip.compress(html, mtime=0), zlib.compress(html), pa.compress(html, "brotli", asbytes=True)
    if kind == 4:
        half = len(packed) // 2
        body = b"".join(b"%x;x=y\r\n%b\r\n" % (len(x), x) for x in (packed[:half], packed[half:]) if x) + b"0\r\nTrailer: t\r\n\r\n"
        return [("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")], body
    cut = gzip.compress(html[:9], mtime=0) + gzip.compress(html[9:], mtime=0)
    both = pa.compress(packed, "brotli", asbytes=True)
    ways = [("", html, 0), ("gzip", packed, 0), ("deflate", flat, 0), ("br", small, 0), None, ("gzip, br", both, 0), ("gzip", packed[:-9], 0), ("", html, 3)]
    ways += [("deflate", packed, 0), ("br", b"\xff" * 40, 0), ("x-gzip", html, -1), ("gzip", cut, 0)]
    coding, body, off = ways[kind]
    return ([("Content-Encoding", coding)] if coding else []) + [("Content-Length", str(len(body) + off))], body


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request, a response and a metadata record of every page."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, room = [], 0
        for n, url, html, line in each_row(batches, ("n", "url", "html", "line")):
            headers, body = _coded((html or "").encode(), n % KINDS)
            top = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("Server", "nginx"), *headers]) + "\r\n"
            for kind, content, block in (
                ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n"),
                ("response", "application/http; msgtype=response", top.encode() + body),
                ("metadata", "application/json", line.encode()),
            ):
                rows.append({"rec_type": kind, "url": url, "ip": "10.0.0.1", "date": "2026-06-29T10:18:14Z", "content_type": content, "block": block})
                room += len(block) + 1000
            if room > ARROW_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, room = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(c, pa.binary() if c == "block" else pa.string()) for c in ("rec_type", "url", "ip", "date", "content_type", "block")])
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"), "url", "html")
    return pages.repartition("n").withColumn("line", F.expr(_LINE)).mapInArrow(made, warc.WRITTEN)


def page_archive(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_path(spark, "archive")
    warc.write_warc(page_records(spark, sf_dir), folder)
    return folder


def _warc_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sound responses held, by decoding."""
    found = warc.read_warc(spark, page_archive(spark, sf_dir), ("response",))
    return found.filter("body_error is null").select("url", "status", "decoded_bytes", "decoded_sha256")


def _warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.outcomes(warc.read_warc(spark, page_archive(spark, sf_dir)))


def _warc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of bodies, counted with all others."""
    found = warc.responses(warc.read_warc(spark, page_archive(spark, sf_dir), ("response",)))
    return findings.note_counts(enrich(found)).filter(F.col("note_id").isin(rules.BODY_ONLY)).select("note_id", "occ")


def _warc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of both kinds of records, by what names them."""
    found = warc.responses(warc.read_warc(spark, page_archive(spark, sf_dir)))
    return found.groupBy("url", F.exists("headers", lambda h: h["name"] == "content-length").alias("has_length")).agg(F.count(F.lit(1)).alias("occ"))


_SOUND = f"page_id % {KINDS} NOT IN (6, 8, 9, 10)"
_ERROR = f"CASE page_id % {KINDS} WHEN 6 THEN 'gzip: truncated' WHEN 8 THEN 'deflate: incorrect header check' WHEN 9 THEN 'br: bad data' WHEN 10 THEN 'gzip: incorrect header check' END"
_LENGTH = f"page_id % {KINDS} <> 4"

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "wat_headers": (_wat_headers, _WAT_SQL),
    "warc_bodies": (_warc_bodies, f"SELECT url, '200' AS status, octet_length(encode(html)) AS decoded_bytes, sha256(html) AS decoded_sha256 FROM pages WHERE {_SOUND}"),
    "warc_records": (
        _warc_records,
        f"SELECT 'response' AS rec_type, {_ERROR} AS error, count(*) AS records FROM pages GROUP BY ALL UNION ALL SELECT t, NULL, count(*) FROM pages, (VALUES ('request'), ('metadata')) AS v(t) GROUP BY t",
    ),
    "warc_notes": (
        _warc_notes,
        f"SELECT note_id, count(*) AS occ FROM pages JOIN (VALUES (6, 'BAD_GZIP'), (10, 'BAD_GZIP'), (7, 'CL_INCORRECT'), (10, 'CL_INCORRECT'), (8, 'BAD_ZLIB'), (9, 'BAD_BROTLI')) AS v(k, note_id) ON page_id % {KINDS} = k GROUP BY note_id",
    ),
    "warc_responses": (
        _warc_responses,
        f"SELECT url, has_length, count(*) AS occ FROM (SELECT url, {_LENGTH} AS has_length FROM pages UNION ALL SELECT url, false FROM (SELECT url, {_LINE} AS line FROM (SELECT page_id AS n, url FROM pages)) WHERE json_valid(line) AND line LIKE '%HTTP-Response-Metadata%') GROUP BY ALL",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, (made, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
