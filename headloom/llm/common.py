"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_U = np.uint64
ARROW_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Texts are long: Arrow batches of a few MB keep a task's memory small. Queries and stages begin with this."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def give_back() -> None:
    """Return freed memory to the system, as a worker process outlives its task and waits for the next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A ``mapInArrow`` function that gives memory back at its end."""

    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share. Where that is unset, the first local session
    makes one of its own; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="headloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors,
    and gives the planner real sizes (small sides are then broadcast, skewed joins split)."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_start(counts: DataFrame, key: str, n: str, out: str, fan: int = 4096) -> DataFrame:
    """For each row the sum of ``n`` over all smaller ``key`` (non-negative, unique): sums inside blocks of
    ``fan`` keys, then over the blocks, so that the one ordered task gets a row a block."""
    block = F.floor(F.col(key) / fan)
    before = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("_block", block).withColumn("_in", F.coalesce(F.sum(n).over(before), F.lit(0)))
    sums = counts.groupBy(block.alias("_block")).agg(F.sum(n).alias("_n"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    return inner.join(sums, "_block").withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_block", "_in", "_base")


def size_of(text: str | Column) -> Column:
    return F.octet_length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


# Hashing of bytes and words inside tasks, vectorised -------------------------------------------------

_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def strides(data: np.ndarray, width: int, dtype: str) -> np.ndarray:
    """The ``width`` bytes at every place of ``data``, as values of ``dtype``; a view."""
    return np.ndarray((len(data) - width + 1,), dtype, np.ascontiguousarray(data), 0, (1,))


def string_hashes(data: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``width`` bytes at every place. Hashes of halves are mixed into hashes of wholes, level by
    level: nothing about it is linear, so strings built from each other in patterns don't collide."""
    if width < 8:
        raise ValueError("a string has eight bytes at least")
    if len(data) < width:
        return np.zeros(0, np.uint64)
    h, have = mix(strides(data, 8, "<u8") + _U((_GOLDEN * (2 * salt + 1)) % 2**64)), 8
    while have < width:
        step = min(have, width - have)
        h = mix(h[: len(h) - step] * _U(_GOLDEN) + h[step:])
        have += step
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PART = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) bytes, a megabyte of text at a time."""
    found, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, at + _PART)
        end = cut.start() if cut else len(data)
        words = data[at:end].lower().split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle, none make an empty set."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, _U(width))
    for i in range(width):
        out = mix(out * _U(_GOLDEN) + words[i : n - width + 1 + i])
    return np.unique(out)
