"""Counting rows, and values that are used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_in() -> Column:
    return F.count(F.lit(1))


def with_sites(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and distinct sites of each key."""
    return rows.groupBy(*keys).agg(rows_in().alias("occ"), F.countDistinct("site").alias("sites"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` reads it: the engine shares no common part of functions over arrays."""
    return F.transform(F.array(value), body)[0]
