"""Worker logs: timings, failures and timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """container, line of every ``stderr.gz`` below ``path``; the container is the file's folder."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "stderr.gz").text(path)
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("container"), F.col("value").alias("line"))


def _fields(lines: DataFrame, pattern: str, *names: tuple[str, str]) -> DataFrame:
    found = lines.filter(F.col("line").rlike(pattern))
    return found.select("container", *[F.regexp_extract("line", pattern, i + 1).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)])


#: What a worker's lines look like.
FINISHED = r"INFO: finished WARC \d+: (.+?) \| records=(\d+) total_ms=(\d+) process_ms=(\d+) iterator_download_ms=(\d+)"
FAILED = r"ERROR: failed WARC \d+: (.+?) \| exit_code=([^ ]+)(?: signal=(\d+))?"
TIMED_OUT = r"ERROR: timeout WARC \d+: (.+?) after (\d+)s; terminating child"
STARTED = r"mapper_init finished successfully in (\d+)ms"
JITTER = r"jitter sleep ([0-9.]+)s"


def telling(lines: DataFrame) -> DataFrame:
    """The lines that one of the patterns finds."""
    return lines.filter(F.col("line").rlike("|".join((FINISHED, FAILED, TIMED_OUT, STARTED, JITTER))))


def finished(lines: DataFrame) -> DataFrame:
    return _fields(lines, FINISHED, ("path", "string"), ("records", "long"), ("total_ms", "long"), ("process_ms", "long"), ("iterator_ms", "long"))


def failed(lines: DataFrame) -> DataFrame:
    return _fields(lines, FAILED, ("path", "string"), ("exit_code", "string"), ("signal", "string"))


def timed_out(lines: DataFrame) -> DataFrame:
    return _fields(lines, TIMED_OUT, ("path", "string"), ("timeout_s", "long"))


def mappers(lines: DataFrame) -> DataFrame:
    """Per container: start-up, jitter and sums over its finished archives."""
    start = F.max(F.regexp_extract("line", STARTED, 1).try_cast("long")).alias("init_ms")
    jitter = F.max((F.regexp_extract("line", JITTER, 1).try_cast("double") * 1000).cast("long")).alias("jitter_ms")
    sums = finished(lines).groupBy("container").agg(
        F.sum("total_ms").alias("warc_total_ms"), F.sum("process_ms").alias("process_ms"), F.sum("iterator_ms").alias("iterator_ms"), F.sum("records").alias("records"), F.count(F.lit(1)).alias("warcs")
    )
    return sums.join(lines.groupBy("container").agg(start, jitter), "container", "left").na.fill(0, ["init_ms", "jitter_ms"]).withColumn("elapsed_ms", F.col("init_ms") + F.col("jitter_ms") + F.col("warc_total_ms"))


def slowest_of(archives: DataFrame, n: int = 10) -> DataFrame:
    """The archives that took longest."""
    return archives.orderBy(F.desc("total_ms"), "path").limit(n)


def slowest(lines: DataFrame, n: int = 10) -> DataFrame:
    return slowest_of(finished(lines), n)


def summary(lines: DataFrame) -> DataFrame:
    """metric, sum, mean, median, p90, p99, max over finished archives."""
    from headloom.operators.timing import summary as spread

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("records", "total_ms", "process_ms", "iterator_ms")]))
    return spread(finished(lines).select(each.alias("m")).select("m.metric", "m.x"), ["metric"], "x")


def processing_share(lines: DataFrame) -> DataFrame:
    """Per cent of the archives' time that went into processing; 0 where there is none."""
    return finished(lines).agg(F.coalesce(F.try_divide(F.sum("process_ms") * 100.0, F.sum("total_ms")), F.lit(0.0)).alias("pct"))


def failures_by_kind(lines: DataFrame) -> DataFrame:
    from headloom.functions.text import failure

    return failed(lines).groupBy(failure(F.col("exit_code").try_cast("int")).alias("kind")).count()
