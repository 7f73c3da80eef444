"""HyperLogLog from rows: registers are (key, index, rho) rows and merge by max, so they aggregate like any sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLOBAL, TOKEN, RECIPE = 12, 8, 6


def register(item: Column, p: int) -> tuple[Column, Column]:
    """Index and rho of an item: crc32 of its UTF-8 bytes, low p bits as index, leading zeros of the rest."""
    h = F.crc32(F.encode(item, "UTF-8"))
    rest = F.shiftright(h, p)
    bits = F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    return (h.bitwiseAND((1 << p) - 1)).cast("int"), (32 - p - bits + 1).cast("int")


def registers(df: DataFrame, keys: list[str], item: str, p: int) -> DataFrame:
    """Null and empty items don't count."""
    index, rho = register(F.col(item), p)
    rows = df.filter(F.length(F.coalesce(item, F.lit(""))) > 0).withColumns({"idx": index, "rho": rho})
    return union(rows, keys)


def union(rows: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Registers of the union of all sets that share ``keys``; beyond ``width``, the least of several widths, none count."""
    rows = rows if width is None else rows.filter(F.col("idx") < width)
    return rows.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def estimate(rows: DataFrame, keys: list[str], p: int, out: str = "sites") -> DataFrame:
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    found = rows.groupBy(*keys).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("used"))
    empty = m - F.col("used")
    raw = alpha * m * m / (F.col("s") + empty)
    linear = m * F.log(m / empty)
    value = F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw)
    return found.select(*keys, F.floor(value).cast("long").alias(out))
