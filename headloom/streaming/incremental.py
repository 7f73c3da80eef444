"""Windowed counts over a stream, and registers of distinct sites that merge across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headloom.functions import hll


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Responses by time window and keys; what comes later than the watermark allows is dropped by the engine."""
    timed = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return timed.agg(F.count(F.lit(1)).alias("responses"), F.approx_count_distinct("site").alias("sites"))


def merge_registers(known: DataFrame | None, batch: DataFrame, keys: list[str], item: str, p: int = hll.GLOBAL) -> DataFrame:
    """Registers after one more batch, for ``foreachBatch``: the union by maximum."""
    fresh = hll.registers(batch, keys, item, p)
    both = fresh if known is None else known.unionByName(fresh)
    return both.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))
