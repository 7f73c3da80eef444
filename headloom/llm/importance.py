"""Importance resampling towards a target: hashed n-gram features, gains of buckets, Gumbel top-k.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts whose A-Z are lower-cased; features are all runs of one to
three words, joined by a blank, repeats counted; a feature's bucket is the crc32 of its UTF-8 bytes modulo ``BUCKETS``.

Features are kept in dictionaries: a block of some MB of text numbers its distinct words, its distinct pairs and its
distinct triples, and hashes each distinct string once. The block's counts are summed by bucket over all blocks, which
gives a gain a bucket, and the gains are joined back to every document's own counts (bucket, n), of which a document
has ``BUCKETS`` at most. One dictionary over all blocks would shuffle a row for nearly every feature, since most
triples of words occur once (the README has figures); buckets and results are the same either way.

Edge cases: a null or empty text, or one without words, has no features and weight 0, and isn't drawn; a null id takes
the place of an empty string in the draw's hash and comes first among ties; repeated rows are scored and drawn each for
itself; a text of any length is read in blocks that share two words; an empty table gives no rows, and with an empty
target every bucket's gain follows from t = 0. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.llm.common import read_table, running_start, staged, trimmed

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK_BYTES = 1 << 20
_BATCH_BYTES = 2 << 20  # of text that a task takes at once; its counts are some four times as long
_SLICE = 1 << 15  # strings held as Python objects at once

_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_TO_WORDS = bytes(x + 32 if 0x41 <= x <= 0x5A else 32 if x <= 0x2F or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256))
_COUNTS = "array<struct<bucket: int, n: int>>"


def word_blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[bytes], int]]]:
    """Blocks of (row, words, how many of them an earlier block has counted). A long text goes on in later blocks, each
    of which repeats the two words before it."""
    block, room = [], 0
    for row, data in enumerate(texts):
        at, carried = 0, []
        while True:
            end = len(data)
            if end - at > limit - room:
                cut = _SEPARATOR.search(data, min(end, at + max(limit - room, 1)))
                end = cut.start() if cut else end
            words = data[at:end].translate(_TO_WORDS).split()
            block.append((row, carried + words, len(carried)))
            carried, room, at = (carried + words)[-2:], room + end - at, end
            if room >= limit:
                yield block
                block, room = [], 0
            if at >= len(data):
                break
    if block:
        yield block


def block_buckets(block: list[tuple[int, list[bytes], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a block. Distinct words, pairs and triples are numbered; the string of each
    is built and hashed once."""
    sizes = np.array([len(words) for _, words, _ in block], np.int64)
    row = np.repeat(np.array([r for r, _, _ in block], np.int64), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = place >= np.repeat(np.array([seen for _, _, seen in block], np.int64), sizes)
    coded = pa.array([w for _, words, _ in block for w in words], pa.binary()).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    strings, gram, rows, buckets = words, code, [row[new]], [_hashed(words)[code[new]]]
    for k in (1, 2):
        longer = np.flatnonzero(place >= k)
        pairs = pa.array(gram[longer - 1] * len(words) + code[longer]).dictionary_encode()
        made = pairs.dictionary.to_numpy()
        strings = pc.binary_join_element_wise(strings.take(pa.array(made // max(len(words), 1))), words.take(pa.array(made % max(len(words), 1))), b" ")
        number = pairs.indices.to_numpy().astype(np.int64)
        gram = np.zeros(len(code), np.int64)
        gram[longer] = number
        fresh = new[longer]
        rows.append(row[longer][fresh])
        buckets.append(_hashed(strings)[number[fresh]])
    return np.concatenate(rows), np.concatenate(buckets)


def _hashed(strings: pa.Array) -> np.ndarray:
    slices = (strings.slice(at, _SLICE).to_numpy(zero_copy_only=False).tolist() for at in range(0, len(strings), _SLICE))
    return np.fromiter((zlib.crc32(x) for held in slices for x in held), np.int64, len(strings)) % BUCKETS


def feature_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds. A document: part, nth, doc_id, n_words, n_features, counts (bucket, n). A block: all
    (bucket, n) of it in ``block``, the rest null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
            words, keys, ns, whole = np.zeros(len(texts), np.int64), [], [], []
            for block in word_blocks(texts):
                for row, found, seen in block:
                    words[row] += len(found) - seen
                rows, buckets = block_buckets(block)
                key, n = np.unique(rows * BUCKETS + buckets, return_counts=True)
                keys.append(key)
                ns.append(n)
                sums = np.bincount(buckets, minlength=BUCKETS)
                whole.append((np.flatnonzero(sums), sums[sums > 0]))
            key, n = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(ns or [np.zeros(0, np.int64)])
            if len(keys) > 1:  # a long text has counts in several blocks
                key, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, n).astype(np.int64)
            row = key // BUCKETS
            features = np.bincount(row, n, len(texts)).astype(np.int64)
            yield _batch(len(texts), part, nth, batch.column("doc_id"), words, features, _lists(np.searchsorted(row, np.arange(len(texts) + 1)), key % BUCKETS, n), None)
            nth += len(texts)
            if whole:
                ends = np.concatenate(([0], np.cumsum([len(b) for b, _ in whole])))
                yield _batch(len(whole), part, None, None, None, None, None, _lists(ends, np.concatenate([b for b, _ in whole]), np.concatenate([n for _, n in whole])))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(count), f"part int, nth long, doc_id long, n_words long, n_features long, counts {_COUNTS}, block {_COUNTS}")


def _lists(ends: np.ndarray, buckets: np.ndarray, n: np.ndarray) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array(buckets, pa.int32()), pa.array(n, pa.int32())], ["bucket", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _batch(size: int, part: int, nth: int | None, doc_id, words, features, counts, block) -> pa.RecordBatch:
    lists = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32())]))
    held = [
        pa.array(np.full(size, part, np.int32)),
        pa.nulls(size, pa.int64()) if nth is None else pa.array(np.arange(nth, nth + size)),
        pa.nulls(size, pa.int64()) if doc_id is None else doc_id,
        *(pa.nulls(size, pa.int64()) if x is None else pa.array(x) for x in (words, features)),
        *(pa.nulls(size, lists) if x is None else x for x in (counts, block)),
    ]
    return pa.record_batch(held, ["part", "nth", "doc_id", "n_words", "n_features", "counts", "block"])


def bucket_sums(counts: DataFrame) -> DataFrame:
    """bucket, n over all blocks."""
    return counts.filter("block is not null").select(F.explode("block").alias("b")).groupBy("b.bucket").agg(F.sum("b.n").alias("n"))


def gains(own: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain for every bucket. ``own``, ``target``: bucket, n."""
    every = own.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    s, t = own.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    both = staged(both, "buckets")
    all_s, all_t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(all_s + BUCKETS) / ((F.col("s") + F.lit(1.0)) * F.lit(all_t + BUCKETS))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def scores(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """part, nth, doc_id, n_words, n_features, weight, score of every row of ``df``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    counts = staged(feature_counts(df, id_col, text_col), "feature-counts")
    own, wanted = bucket_sums(counts), bucket_sums(feature_counts(target.withColumn("_none", F.lit(None).cast("long")).select("_none", text_col), "_none", text_col))
    gain = F.broadcast(gains(own, wanted))  # a row a bucket
    documents = counts.filter("nth is not null")
    priced = documents.select("part", "nth", F.explode("counts").alias("c")).select("part", "nth", "c.bucket", "c.n").join(gain, "bucket")
    weights = priced.groupBy("part", "nth").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = documents.select("part", "nth", "doc_id", "n_words", "n_features").join(weights, ["part", "nth"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    return scored.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """part, nth, rank of the drawn rows. Ranks come from counts: of scores, then of ids and tasks within a score,
    then within one id, score and task, so neither a sort nor a group is gathered in one place."""
    fit = scored.filter(F.col("n_words") >= min_words)
    n, top = fit.agg(F.count(F.lit(1)), F.max("score")).first()
    n = percent * n // 100
    fit = fit.withColumn("_down", F.lit(top or 0) - F.col("score"))
    starts = running_start(fit.groupBy("_down").count(), "_down", "count", "_start").filter(F.col("_start") < n).select("_down", "_start")
    fit = fit.join(starts, "_down")
    cells = fit.groupBy("_down", "doc_id", "part").count()
    before = Window.partitionBy("_down").orderBy(F.asc_nulls_first("doc_id"), "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_down", F.col("doc_id").alias("_id"), F.col("part").alias("_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_inside"))
    same = (fit["_down"] == cells["_down"]) & fit["doc_id"].eqNullSafe(cells["_id"]) & (fit["part"] == cells["_part"])
    nth = F.row_number().over(Window.partitionBy(fit["_down"], "doc_id", "part").orderBy("nth"))
    ranked = fit.join(cells, same).withColumn("rank", (F.col("_start") + F.col("_inside") + nth).cast("long"))
    return ranked.filter(F.col("rank") <= n).select("part", "nth", "rank")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and, for the ``percent`` of documents drawn, rank."""
    scored = staged(scores(df, target, id_col, text_col, seed), "scores")
    drawn = draw(scored, percent, min_words)
    return scored.join(drawn, ["part", "nth"], "left").select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: crc32 by bits: each byte of the feature, then seven shifts.
ORACLE_SQL = r"""
with texts as (
  select doc_id, 0 as target, text from documents union all select item_id, 1, text from benchmark
), split as (
  select row_number() over () as r, doc_id, target,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts
), grams as (
  select r, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
  from split
), counted as (select r, target, f, count(*) as n from grams group by all),
hashed as (
  select f, xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(range(octet_length(encode(f))), lambda i: [('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384::ubigint * (xor(a, x) & 1))), 4294967295::ubigint) % 10000 as b
  from (select distinct f from counted)
), sums as (
  select b, coalesce(sum(n) filter (target = 0), 0) as s, coalesce(sum(n) filter (target = 1), 0) as t from counted join hashed using (f) group by b
), totals as (select sum(s) as all_s, sum(t) as all_t from sums),
gain as (
  select b, floor(1000 * ln((t + 1)::double * (all_s + 10000)::double / ((s + 1)::double * (all_t + 10000)::double)))::bigint as g from sums, totals
), weights as (
  select r, sum(n) as n_features, sum(n * g) as weight from counted join hashed using (f) join gain using (b) where target = 0 group by r
), scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::bigint + 0.5) / 4294967296::double))))::bigint as score
  from split left join weights using (r) where target = 0
), ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as nth, count(*) filter (n_words >= 20) over () as fit from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and nth <= 5 * fit // 100 then nth end as rank from ranked
"""
