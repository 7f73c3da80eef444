"""Lists of archive paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.sources.scratch import shared_path

#: Where a row stands: its file, the split of it that was read, and the line's number in the scan.
PLACE = ["file", "block", "line"]


def read_paths(spark: SparkSession, source: str | list[str], limit: int = 0) -> DataFrame:
    """Paths, one a line, plain or gzip, in file order; blank lines and ``#`` lines don't count. ``limit`` is over all
    files together. ``file``, ``block`` and ``line`` say where a path stands."""
    lines = spark.read.text(source)
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()}
    paths = lines.withColumns(place).withColumn("path", F.trim("value")).filter("path <> '' and not startswith(path, '#')").select("path", *PLACE)
    return paths.orderBy(*PLACE).limit(limit) if limit else paths


def wat_path(path: Column | str) -> Column:
    """Archive path to metadata path; a metadata path stays as it is."""
    path = F.col(path) if isinstance(path, str) else path
    moved = F.replace(path, F.lit("/warc/"), F.lit("/wat/"))
    return F.when(moved.endswith(".warc.gz"), F.regexp_replace(moved, r"\.warc\.gz$", ".warc.wat.gz")).otherwise(moved)


def chunks(paths: DataFrame, n: int) -> DataFrame:
    """Adds ``chunk``: contiguous runs of ceil(rows / n) paths, in file order where the rows have their places and in path order
    else; the last chunks may be missing. Ranges of rows are numbered side by side, each from the counts of those before it; the ranges are
    written down first, as a partition's number is not the same in two plans of it."""
    order = [*PLACE, "path"] if set(PLACE) <= set(paths.columns) else ["path"]
    where = shared_path(paths.sparkSession, "ranges")
    paths.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(where)
    dealt = paths.sparkSession.read.parquet(where)
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_part").count().select("_part", before.alias("_start"), F.sum("count").over(Window.partitionBy()).alias("_all"))  # a row a range
    size = F.greatest(F.lit(1), F.ceil(F.col("_all") / n))
    numbered = dealt.withColumn("_nth", nth).join(starts, "_part")
    return numbered.withColumn("chunk", F.floor((F.col("_start") + F.col("_nth")) / size).cast("int")).select(*paths.columns, "chunk")
