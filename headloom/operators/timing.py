"""Distribution of numbers: nearest-rank percentiles without gathering a group anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headloom.sources.scratch import shared_path

RANGES = 1024


def _staged(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in names], F.lit(True))


def at_ranks(counts: DataFrame, wanted: DataFrame, group: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``group``, label, value: of each group the value at each wanted rank (from 1). ``counts``: group, value, c;
    ``wanted``: group, label, rank, low, high, where all values lie between low and high.

    The interval of a rank is cut into ranges, whose counts say which of them holds the rank; that one is cut again,
    from its least to its largest value, until it is one value. A step reads the counts once and orders no more than
    ``ranges`` rows of a group; for whole numbers there are ``log(high - low, ranges)`` steps at most."""
    while True:
        open_ = wanted.filter("low < high")
        if open_.isEmpty():
            return wanted.select(*group, "label", F.col("low").alias(value))
        spans = open_.select(*group, "low", "high").distinct()
        inside = counts.join(spans, _same(counts, spans, group) & counts[value].between(spans["low"], spans["high"]))
        share = (F.col(value).cast("double") - F.col("low")) / (F.col("high").cast("double") - F.col("low"))
        cut = inside.select(*[counts[c] for c in group], "low", "high", F.least(F.lit(ranges - 1), F.floor(share * ranges)).alias("range"), value, "c")
        sums = cut.groupBy(*group, "low", "high", "range").agg(F.sum("c").alias("c"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        upto = Window.partitionBy(*group, "low", "high").orderBy("range")
        sums = sums.withColumn("upto", F.sum("c").over(upto))
        hit = _same(open_, sums, [*group, "low", "high"]) & (open_["rank"] <= sums["upto"]) & (open_["rank"] > sums["upto"] - sums["c"])
        closer = open_.join(sums, hit).select(*[open_[c] for c in group], "label", (open_["rank"] - sums["upto"] + sums["c"]).alias("rank"), sums["_low"].alias("low"), sums["_high"].alias("high"))
        wanted = _staged(wanted.filter("low = high").select(closer.columns).unionByName(closer), "ranks")


def summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """sum, mean, median, p90, p99 and max of the values that aren't null. A percentile is the value at rank
    int(n * p / 100), counted from 1; a median of an even number lies between two values."""
    counts = _staged(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("c")), "value-counts")
    whole = counts.groupBy(*group).agg(F.sum(F.col(value) * F.col("c")).alias("sum"), F.sum("c").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    ranks = {"m1": "(n + 1) div 2", "m2": "n div 2 + 1", "p90": "greatest(1, int(n * 90 / 100))", "p99": "greatest(1, int(n * 99 / 100))"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.expr(r).cast("long").alias("rank")) for k, r in ranks.items()])).alias("w")
    wanted = _staged(whole.select(*group, each, "low", "high").select(*group, "w.label", "w.rank", "low", "high"), "ranks")
    found = at_ranks(counts, wanted, group, value).groupBy(*group).agg(*[F.max(F.when(F.col("label") == k, F.col(value))).alias(k) for k in ranks])
    both = whole.join(found, _same(whole, found, group)).select(*[whole[c] for c in group], "sum", "n", *ranks, F.col("high").alias("max"))
    return both.select(*group, "sum", F.expr("cast(sum / n as bigint)").alias("mean"), F.expr("cast((m1 + m2) / 2 as bigint)").alias("median"), "p90", "p99", "max")
