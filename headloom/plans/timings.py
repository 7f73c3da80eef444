"""Summary of worker logs: how long archives and workers took, what failed and what is slow.

Numbers are aggregated by Spark; the driver gets one row of totals, six rows of percentiles and, for the Markdown, at most ``top`` rows a list.
Lists of failures and timeouts are as long as a crawl has archives and are written as JSON lines of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headloom.operators import timing
from headloom.plans.report import Section, markdown
from headloom.sources import logs
from headloom.sources.scratch import shared_path

#: Parts and metrics of the summary, with the columns they come from.
ARCHIVE_METRICS = {"total": "total_ms", "process": "process_ms", "iterator_download": "iterator_ms"}
WORKER_METRICS = {"elapsed": "elapsed_ms", "jitter": "jitter_ms", "init": "init_ms"}
TOTALS = ["mappers", "warcs_completed", "warcs_failed", "warcs_timed_out", "records_seen"]
STATISTICS = ["sum", "mean", "median", "p90", "p99", "max"]


@dataclass
class Timings:
    """Tables of one set of logs, parsed once."""

    archives: DataFrame
    workers: DataFrame
    failures: DataFrame
    timeouts: DataFrame


def parse(lines: DataFrame) -> Timings:
    """``lines``: container, line. The few lines that say something are kept in the shared folder."""
    path = shared_path(lines.sparkSession, "log-lines")
    logs.telling(lines.select("container", "line")).write.parquet(path)
    kept = lines.sparkSession.read.schema("container string, line string").parquet(path)
    return Timings(logs.finished(kept), logs.mappers(kept), logs.failed(kept), logs.timed_out(kept))


def _counts(found: Timings) -> DataFrame:
    """name, n: the numbers behind the totals, a row each."""
    number = lambda df, name, n=None: df.agg(F.coalesce(n if n is not None else F.count(F.lit(1)), F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    rows = [number(found.workers, "mappers"), number(found.archives, "warcs_completed"), number(found.failures, "warcs_failed"), number(found.timeouts, "warcs_timed_out")]
    rows += [number(found.archives, name, F.sum(c)) for name, c in (("records_seen", "records"), ("process_ms", "process_ms"), ("total_ms", "total_ms"))]
    return reduce(DataFrame.unionByName, rows)


def totals(found: Timings) -> DataFrame:
    """One row: workers, archives that were completed, failed or timed out, records, and the share of processing."""
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("n")))
    share = F.coalesce(F.try_divide(at("process_ms") * 100.0, at("total_ms")), F.lit(0.0))
    return _counts(found).agg(*[at(name).alias(name) for name in TOTALS], share.alias("processing_pct"))


def spreads(found: Timings) -> DataFrame:
    """part (warc_ms, mapper_ms), metric, sum, mean, median, p90, p99, max."""

    def numbers(df: DataFrame, part: str, metrics: dict[str, str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("long").alias("ms")) for m, c in metrics.items()]))
        return df.select(each.alias("x")).select(F.lit(part).alias("part"), "x.metric", "x.ms")

    whole = numbers(found.archives, "warc_ms", ARCHIVE_METRICS).unionByName(numbers(found.workers, "mapper_ms", WORKER_METRICS))
    return timing.summary(whole, ["part", "metric"], "ms")


def summary_row(found: Timings) -> DataFrame:
    """One row of nested structs: totals, warc_ms, mapper_ms. Where nothing was measured, every number is 0."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("long").alias("n")) for s in STATISTICS]))
    rows = spreads(found).select("part", "metric", each.alias("x")).select("part", "metric", "x.name", "x.n")
    rows = rows.unionByName(_counts(found).select(F.lit("totals").alias("part"), F.lit("").alias("metric"), "name", "n"))

    def at(part: str, metric: str, name: str) -> Column:
        here = (F.col("part") == part) & (F.col("metric") == metric) & (F.col("name") == name)
        return F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0).cast("long")).alias(name)

    nested = [F.struct(*[F.struct(*[at(part, m, s) for s in STATISTICS]).alias(m) for m in metrics]).alias(part) for part, metrics in (("warc_ms", ARCHIVE_METRICS), ("mapper_ms", WORKER_METRICS))]
    return rows.agg(F.struct(*[at("totals", "", name) for name in TOTALS]).alias("totals"), *nested)


def write_json(found: Timings, folder: str) -> None:
    """``folder``/summary holds one JSON object, ``folder``/failures and ``folder``/timeouts one a line."""
    summary_row(found).coalesce(1).write.json(f"{folder}/summary")
    found.failures.write.json(f"{folder}/failures")
    found.timeouts.write.json(f"{folder}/timeouts")


def _seconds(ms: int) -> str:
    return f"{ms / 1000:.1f}s"


def _first(title: str, df: DataFrame, columns: list[str], order: list[Column | str], top: int, total: int) -> Section:
    rows = [tuple("-" if x in (None, "") else x for x in r) for r in df.select(*columns).orderBy(*order).limit(top).collect()]
    return Section(title, columns, rows, max(0, total - len(rows)))


def sections(found: Timings, top: int = 10) -> list[Section]:
    """Raises where no archive was finished: the logs then hold no timings."""
    whole = totals(found).first()
    if not whole["warcs_completed"]:
        raise ValueError("no line of these logs says that an archive was finished")
    parts = [Section("Totals", ["what", "number"], [(k, whole[k]) for k in whole.asDict() if k != "processing_pct"])]
    if whole["warcs_failed"]:
        parts.append(_first("Failed archives", found.failures, ["exit_code", "signal", "container", "path"], ["container", "path", "exit_code"], top, whole["warcs_failed"]))
    if whole["warcs_timed_out"]:
        parts.append(_first("Timed-out archives", found.timeouts, ["timeout_s", "container", "path"], ["container", "path", "timeout_s"], top, whole["warcs_timed_out"]))
    spread = {(r["part"], r["metric"]): r for r in spreads(found).collect()}
    shown = ["sum", "mean", "median", "p90", "max"]
    for title, part, metrics in (("Archive timings", "warc_ms", ARCHIVE_METRICS), ("Worker timings", "mapper_ms", WORKER_METRICS)):
        parts.append(Section(title, ["metric", *shown], [(m, *(_seconds(spread[part, m][s]) for s in shown)) for m in metrics if (part, m) in spread]))
    parts[-2].notes.append(f"Processing share: {whole['processing_pct']:.1f}%")
    slow = logs.slowest_of(found.archives, top).collect()
    parts.append(Section(f"Slowest {top} archives", ["total", "process", "iterator_download", "records", "path"], [(_seconds(r.total_ms), _seconds(r.process_ms), _seconds(r.iterator_ms), r.records, r.path) for r in slow]))
    return parts


def write_markdown(found: Timings, path: str, top: int = 10) -> list[Section]:
    parts = sections(found, top)
    Path(path).write_text(markdown(parts, "Timing summary"), "utf-8")
    return parts
