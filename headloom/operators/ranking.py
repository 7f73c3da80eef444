"""Totally ordered top-k with a truncation flag, and the semi-joins that follow a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k rows of the largest ``by``; ties go to the smaller key. Sorts only what it keeps."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_in(df: DataFrame, group: list[str], k: int, by: str, *ties: str) -> DataFrame:
    """The same within groups, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), *ties))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def cut(df: DataFrame, k: int) -> DataFrame:
    """n_total, truncated: whether a cut to k rows loses any."""
    return df.agg(F.count(F.lit(1)).alias("n_total")).withColumn("truncated", F.col("n_total") > k)


def surviving(detail: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Detail rows whose keys outlived a cut."""
    return detail.join(kept.select(*keys).distinct(), keys, "left_semi")


def share(part: Column, whole: Column) -> Column:
    """Per cent, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
