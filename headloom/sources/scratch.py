"""Folders for tables that driver and executors share, and memory of Python workers."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ARROW_BYTES = 4 << 20
_ROWS = 64


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; a local session that has none set gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="headloom-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows unless told otherwise; of pages and records, 10,000 can be any number of bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def each_row(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows as tuples, of which only a few are Python's at a time. At the end freed memory goes back to the system, as
    a worker process outlives its task."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
    give_back()


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
