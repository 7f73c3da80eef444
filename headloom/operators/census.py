"""Census of proprietary header names along three axes: vendor, family, prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions.counting import rows_in
from headloom.operators.counters import header_bytes, unregistered


def entries(e: DataFrame) -> DataFrame:
    """name, responses, bytes, vendor, family, prefix, well_known."""
    return entries_of(unregistered(e), header_bytes(e))


def entries_of(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    name = F.col("name")
    rows = seen.filter(H.category(name) == "proprietary").join(sizes, "name", "left").na.fill(0, ["bytes"])
    vendor = F.coalesce(H.vendor(name), F.lit("__unattributed__"))
    return rows.withColumns({"vendor": vendor, "family": H.family(name), "prefix": H.name_prefix(name), "well_known": H.well_known(name)})


def clusters(found: DataFrame, axis: str | Column, out: str, members: int = 8) -> DataFrame:
    """Names, responses and bytes by axis, with the commonest members."""
    found = found.withColumn(out, F.col(axis) if isinstance(axis, str) else axis)
    sums = found.groupBy(out).agg(rows_in().alias("names"), F.sum("responses").alias("responses"), F.sum("bytes").alias("bytes"))
    nth = F.row_number().over(Window.partitionBy(out).orderBy(F.desc("responses"), "name"))  # the engine keeps the first few of a group as it sorts
    first = found.withColumn("nth", nth).filter(F.col("nth") <= members).groupBy(out).agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("m"))
    shown = F.array_join(F.transform("m", lambda x: x["name"]), ", ").alias("members")
    return sums.join(first, out).select(out, "names", "responses", "bytes", shown)


def totals(found: DataFrame) -> DataFrame:
    known = F.sum(F.col("well_known").cast("long"))
    return found.agg(rows_in().alias("names"), F.sum("responses").alias("responses"), F.sum("bytes").alias("bytes"), known.alias("well_known_names"), (rows_in() - known).alias("novel_names"))
