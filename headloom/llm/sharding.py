"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters rows uniformly over memory-sized buckets by a seeded hash of what a row holds and, where rows
are equal, of their number among their equals; so copies of a text, and equal rows too, spread like any other
rows, and neither file layout nor partitioning matters. Pass two puts a bucket in the order of those hashes,
permutes it by Fisher-Yates swaps drawn from a hash of seed, bucket and step, and writes it: the order (bucket,
place in bucket) is cut into runs whose lengths differ by one row at most, each run a shard with files of its own.

Equal rows are interchangeable: they are counted and made anew, in chunks, so a row that occurs very often is
never gathered.

Edge cases: a null text has no bytes and the size 1; null ids, repeated rows and columns of any name (of types
that can be grouped) pass through unchanged inside the struct of the row; an empty table gives empty shards and no
files. A text longer than a bucket makes that bucket as long as the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from headloom.llm.common import read_table, running_start, shared_path, size_of, staged

BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 4096
CHUNK = 10_000
SEED = 20240229


def permuted(n: Column, seed: int, bucket: Column) -> Column:
    """Fisher-Yates permutation of 0..n-1 (n below 65,536): two bytes a number, swapped in place from the end."""
    number = lambda i: F.substring(F.hex(i + 65536), 2, 4)
    start = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), number), ""))

    def swap(p: Column, i: Column) -> Column:
        a, b = (i * 2 + 1).cast("int"), (F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1) * 2 + 1).cast("int")
        once = F.overlay(p, F.substring(p, b, F.lit(2)), a, F.lit(2))
        return F.overlay(once, F.substring(p, a, F.lit(2)), b, F.lit(2))

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    places = F.sequence(F.lit(0), n - 1)
    return F.aggregate(steps, start, swap, lambda p: F.transform(places, lambda i: F.conv(F.hex(F.substring(p, (i * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")))


def _numbered(counted: DataFrame, keep: list[str]) -> DataFrame:
    """``counted`` (n and others) with a row for each number ``nth`` below n, long runs in chunks that may part."""
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    chunks = chunks.repartition(F.col("key"), F.col("chunk"))
    low = F.col("chunk") * CHUNK
    return chunks.withColumn("nth", F.explode(F.sequence(low, F.least(low + CHUNK, F.col("n")) - 1))).select(*keep, "nth")


def write_shards(
    df: DataFrame, path: str, shards: int, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Write ``df`` in shuffled order below ``path``, a folder ``shard=k`` for each shard, as rows (slot, rec); returns
    what a reader of those files gets."""
    spark = df.sparkSession
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("rec"), (size_of(df[text_col]) + 64).cast("long").alias("size"))
    rows = rows.withColumn("key", F.xxhash64("rec"))
    keys = staged(rows.select("key", "size"), "shard-keys")
    total, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes), -(-total // bucket_rows))
    place = F.pmod(F.xxhash64("key", "nth", F.lit(seed)), F.lit(buckets))
    times = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    repeats = staged(times.filter("n > 1"), "shard-repeats")
    numbers = times.filter("n = 1").select("key", F.lit(0).cast("long").alias("nth")).unionByName(_numbered(repeats, ["key"]))
    counts = numbers.groupBy(place.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    starts = staged(running_start(counts, "bucket", "rows", "start").select("bucket", "start"), "shard-starts")

    own = ["key", "rec"]
    single = rows.join(repeats.select("key"), "key", "left_anti").select(*own, F.lit(0).cast("long").alias("nth"))
    equal = rows.join(repeats.select("key"), "key", "left_semi").groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    scattered = single.unionByName(_numbered(equal, own)).withColumn("bucket", place)
    held = scattered.groupBy("bucket").agg(F.collect_list(F.struct("key", "nth", "rec")).alias("xs")).join(starts, "bucket")
    # rows reach a bucket in any order; sorted by hash and number, they are permuted by seed and bucket alone
    held = held.withColumn("order", F.array_sort(F.transform("xs", lambda x, i: F.struct(x["key"], x["nth"], i.alias("i")))))
    held = held.withColumn("to", permuted(F.size("xs"), seed, F.col("bucket")))
    dealt = held.select("start", "xs", "order", F.posexplode("to").alias("place", "from"))
    dealt = dealt.select((F.col("start") + F.col("place")).alias("at"), F.col("xs")[F.col("order")[F.col("from")]["i"]]["rec"].alias("rec"))
    short, extra = divmod(total, shards)  # the first ``extra`` shards have one row more
    late = F.lit(extra) + F.floor((F.col("at") - extra * (short + 1)) / max(short, 1))
    shard = F.when(F.col("at") < extra * (short + 1), F.floor(F.col("at") / (short + 1))).otherwise(late).cast("int")
    first = F.col("shard") * short + F.least(F.col("shard"), F.lit(extra))
    dealt = dealt.withColumn("shard", shard).select("shard", (F.col("at") - first).cast("long").alias("slot"), "rec")
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    shape = StructType([StructField("slot", LongType()), rows.schema["rec"], StructField("shard", IntegerType())])
    return spark.read.schema(shape).parquet(path) if total else spark.createDataFrame([], shape)


def op4_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, read from the files of the shards."""
    read = write_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "shards"), shards)
    text = F.coalesce(F.col("rec.text"), F.lit(""))
    return read.select(
        F.col("rec.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
