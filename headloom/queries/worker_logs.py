"""Queries over worker logs that are made from the events, whose SQL reads the same lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.plans import timings
from headloom.sources import logs

_MS = "CAST(abs(floor(coalesce(value, 0) * 100)) AS BIGINT)"
_PATH = "'crawl/part-' || CAST(event_id % 977 AS VARCHAR(20)) || '/' || event_type"
#: A line of an event, as text that Spark and SQL both evaluate.
_LINE = f"""CASE
  WHEN event_id % 23 = 0 THEN '10:18:14 ERROR: failed WARC 3: ' || {_PATH} || ' | exit_code=-9 signal=9'
  WHEN event_id % 23 = 1 THEN 'ERROR: failed WARC 4: ' || {_PATH} || ' | exit_code=' || CAST(event_id % 3 AS VARCHAR(20))
  WHEN event_id % 23 = 2 THEN 'ERROR: timeout WARC 5: ' || {_PATH} || ' after 900s; terminating child'
  WHEN event_id % 23 = 3 THEN 'INFO: mapper_init finished successfully in ' || CAST(event_id % 500 AS VARCHAR(20)) || 'ms'
  WHEN event_id % 23 = 4 THEN 'INFO: jitter sleep ' || CAST(event_id % 4 AS VARCHAR(20)) || '.5s'
  WHEN event_id % 23 = 5 THEN 'INFO: finished WARC 6: ' || {_PATH} || ' | records=none'
  ELSE 'INFO: finished WARC 7: ' || {_PATH} || ' | records=' || CAST(event_id % 1000 AS VARCHAR(20)) || ' total_ms=' || CAST({_MS} AS VARCHAR(20))
    || ' process_ms=' || CAST({_MS} - {_MS} % 7 AS VARCHAR(20)) || ' iterator_download_ms=' || CAST({_MS} % 7 AS VARCHAR(20)) || ' heap=1' END"""
_CONTAINER = "'container-' || CAST(user_id % 41 AS VARCHAR(20))"

_PARSED = f"""WITH line AS (SELECT {_CONTAINER} AS container, {_LINE} AS line FROM events),
a AS (SELECT container, CAST(regexp_extract(line, 'records=([0-9]+)', 1) AS BIGINT) AS records, CAST(regexp_extract(line, 'total_ms=([0-9]+)', 1) AS BIGINT) AS total_ms,
        CAST(regexp_extract(line, 'process_ms=([0-9]+)', 1) AS BIGINT) AS process_ms, CAST(regexp_extract(line, 'iterator_download_ms=([0-9]+)', 1) AS BIGINT) AS iterator_ms
      FROM line WHERE regexp_matches(line, 'INFO: finished WARC .*total_ms=')),
s AS (SELECT container, coalesce(max(TRY_CAST(regexp_extract(line, 'successfully in ([0-9]+)ms', 1) AS BIGINT)), 0) AS init_ms,
        coalesce(max(CAST(TRY_CAST(regexp_extract(line, 'jitter sleep ([0-9.]+)s', 1) AS DOUBLE) * 1000 AS BIGINT)), 0) AS jitter_ms FROM line GROUP BY container),
m AS (SELECT container, init_ms, jitter_ms, init_ms + jitter_ms + w.ms AS elapsed_ms FROM (SELECT container, sum(total_ms) AS ms FROM a GROUP BY container) w JOIN s USING (container))
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container, line: a log line an event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_CONTAINER).alias("container"), F.expr(_LINE).alias("line"))


def _parsed(spark: SparkSession, sf_dir: str) -> timings.Timings:
    return timings.parse(lines(spark, sf_dir))


_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "log_totals": (
        lambda spark, sf_dir: timings.totals(_parsed(spark, sf_dir)),
        _PARSED
        + """SELECT (SELECT count(*) FROM m) AS mappers, (SELECT count(*) FROM a) AS warcs_completed, CAST(count_if(line LIKE '%failed WARC%') AS BIGINT) AS warcs_failed,
  CAST(count_if(line LIKE '%timeout WARC%') AS BIGINT) AS warcs_timed_out, (SELECT CAST(sum(records) AS BIGINT) FROM a) AS records_seen,
  (SELECT sum(process_ms) * CAST(100 AS DOUBLE) / sum(total_ms) FROM a) AS processing_pct FROM line""",
    ),
    "log_spreads": (
        lambda spark, sf_dir: timings.spreads(_parsed(spark, sf_dir)),
        _PARSED
        + """, x AS (SELECT 'warc_ms' AS part, unnest(['total', 'process', 'iterator_download']) AS metric, unnest([total_ms, process_ms, iterator_ms]) AS ms FROM a
  UNION ALL SELECT 'mapper_ms', unnest(['elapsed', 'jitter', 'init']), unnest([elapsed_ms, jitter_ms, init_ms]) FROM m),
o AS (SELECT part, metric, list_sort(list(CAST(ms AS BIGINT))) AS xs FROM x GROUP BY ALL)
SELECT part, metric, CAST(list_sum(xs) AS BIGINT) AS sum, CAST(trunc(list_sum(xs) / len(xs)) AS BIGINT) AS mean, CAST(trunc((xs[(len(xs) + 1) // 2] + xs[len(xs) // 2 + 1]) / 2) AS BIGINT) AS median,
  xs[greatest(1, len(xs) * 90 // 100)] AS p90, xs[greatest(1, len(xs) * 99 // 100)] AS p99, xs[len(xs)] AS max FROM o""",
    ),
    "log_failures": (
        lambda spark, sf_dir: logs.failures_by_kind(lines(spark, sf_dir)).select("kind", F.col("count").alias("occ")),
        _PARSED
        + """SELECT CASE code WHEN '-9' THEN 'warc_signal_sigkill' WHEN '0' THEN 'warc_exit_zero' ELSE 'warc_exit_nonzero' END AS kind, count(*) AS occ
FROM (SELECT regexp_extract(line, 'exit_code=([^ ]+)', 1) AS code FROM line WHERE line LIKE '%failed WARC%') GROUP BY ALL""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, (made, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
