"""Removal of long repeated passages: every byte under a 400-byte string that also starts anywhere else.

The distributed difference-cover construction keeps a row for two thirds of all suffixes on each level, some
sixteen times the size of the text in its first shuffle alone; the README gives the figures. What is kept of it is
the plan: suffixes are sampled, samples get names, equal names are settled by longer names, the remaining
suffixes are merged under their sample, and neighbours in sorted order are compared.

- Sample: of all ``gram``-byte strings in a window of ``length`` bytes, the one of least hash stands for the
  window. Equal windows choose equal grams, so windows can only be equal under the same gram; there is a
  sample every 170 bytes or so.
- Name: the run of windows that share a sample is named by a cryptographic digest of all bytes under it. Runs of
  equal names are repeated as a whole, which settles the inside of nearly all repeats.
- Merge: where runs share a sample but not their name, as they do at the ends of repeats, one run of each name
  is spread into its windows. Windows of one sample meet in one task, are sorted by a hash of their 400
  bytes, and neighbours are compared byte by byte. Samples with more than ``MANY_BYTES`` of such runs are
  named by digests of single windows and counted by a grouping instead, so no task holds more.

Every table here grows with the corpus, so joins are merge joins by hint and nothing is broadcast.

Hashes choose samples and bring windows together; only digests of 128 bits (BLAKE2b) or the bytes say that two are
equal.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing; a text that repeats inside itself
counts, overlaps too; rows with null ids and repeated rows are documents like others (a repeated row is a
copy). Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.llm.common import read_table, staged, strides, string_hashes, trimmed

LENGTH, GRAM = 400, 64
MANY_BYTES = 64 << 20
_U = np.uint64


def digest(data: np.ndarray | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """seed, name, low, high, again: the runs of window starts low..high that share the gram ``seed``; again: the
    gram occurs twice in such a way that windows of the run may equal each other."""
    g = string_hashes(data, gram)
    width = length - gram + 1
    n = len(g) - width + 1
    padded = np.full(-(-len(g) // width) * width, _U(2**64 - 1))
    padded[: len(g)] = g
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    low = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    high = np.concatenate((low[1:], [n])) - 1
    view = memoryview(data)
    name = [digest(view[a:b]) for a, b in zip(low.tolist(), (high + length).tolist(), strict=True)]
    first = np.fromiter((a + int(g[a : a + width].argmin()) for a in low.tolist()), np.int64, len(low))
    return least[low].view(np.int64), name, low, high, high > first


def _bytes(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for x in batch.column(column):
        yield np.frombuffer(x.as_buffer(), np.uint8)


def sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc, hash, seed, name, low, high, again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                who, found, names = [], [], []
                for i, data in enumerate(_bytes(part, "body")):
                    if len(data) >= length:
                        seed, name, *rest = runs(data, length, gram)
                        found.append((seed, *rest))
                        names += name
                        who.append(np.full(len(seed), i))
                if found:
                    row = pa.array(np.concatenate(who))
                    seed, low, high, again = (np.concatenate(x) for x in zip(*found, strict=True))
                    columns = [part.column("doc").take(row), part.column("hash").take(row), seed, pa.array(names, pa.binary()), low.astype(np.int32), high.astype(np.int32), again]
                    yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["doc", "hash", "seed", "name", "low", "high", "again"])

    return docs.mapInArrow(trimmed(run), "doc long, hash long, seed long, name binary, low int, high int, again boolean")


def contexts(texts: DataFrame, length: int, most: int = 4096) -> DataFrame:
    """``texts``: doc, hash, body, runs. The bytes under each run, in rows of at most ``most`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part = batch.slice(begin, 64)
                out = []
                docs, hashes, lists = (part.column(c).to_pylist() for c in ("doc", "hash", "runs"))
                for doc, key, data, asked in zip(docs, hashes, _bytes(part, "body"), lists, strict=True):
                    for r in asked:
                        for a in range(r["low"], r["high"] + 1, most):
                            b = min(a + most - 1, r["high"])
                            out.append((r["seed"], doc, key, a, data[a : b + length].tobytes()))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["seed", "doc", "hash", "low", "body"])

    return texts.mapInArrow(trimmed(run), "seed long, doc long, hash long, low int, body binary")


def repeated(bodies: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each body, which of its windows another window equals: sorted by hash, neighbours compared as bytes."""
    hashes = [string_hashes(x, length) for x in bodies]
    flat, blob = np.concatenate(hashes), np.concatenate(bodies)
    skip = np.repeat(np.arange(len(bodies)) * (length - 1), [len(x) for x in hashes])
    order = np.argsort(flat, kind="stable")
    at, rows = np.arange(len(flat)) + skip, strides(blob, length, f"V{length}")
    out = np.zeros(len(flat), bool)
    same = np.flatnonzero(flat[order[1:]] == flat[order[:-1]])
    unlike: set[int] = set()
    for begin in range(0, len(same), 4096):
        here = same[begin : begin + 4096]
        i, j = order[here], order[here + 1]
        a, b = rows[at[i]], rows[at[j]]
        if a.tobytes() != b.tobytes():
            fine = (a.view(np.uint8).reshape(-1, length) == b.view(np.uint8).reshape(-1, length)).all(1)
            unlike.update(flat[i[~fine]].tolist())
            i, j = i[fine], j[fine]
        out[i] = out[j] = True
    for h in unlike:  # windows of one hash that aren't all equal
        group: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(flat == _U(h)).tolist():
            group.setdefault(rows[at[i]].tobytes(), []).append(i)
        for found in group.values():
            out[found] = len(found) > 1
    return np.split(out, np.cumsum([len(x) for x in hashes])[:-1])


def _stretches(low: int, twin: np.ndarray, length: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], twin.view(np.int8), [0])))
    return [(low + int(a), low + int(b) - 1 + length) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def twins(rows: DataFrame, length: int) -> DataFrame:
    """doc, hash, start, end of bytes under windows that another window of the same seed equals."""

    def settle(held: list) -> Iterator[tuple[int, int, int, int]]:
        for (doc, key, low, _), twin in zip(held, repeated([data for *_, data in held], length), strict=True):
            for a, b in _stretches(low, twin, length):
                yield doc, key, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out: list[tuple] = []
            seeds, docs, hashes, lows = (batch.column(c).to_pylist() for c in ("seed", "doc", "hash", "low"))
            for seed, doc, key, low, body in zip(seeds, docs, hashes, lows, batch.column("body"), strict=True):
                if seed != now:
                    if held:
                        out += settle(held)
                    now, held = seed, []
                held.append((doc, key, low, np.frombuffer(body.as_py(), np.uint8)))
            if out:
                yield _ranges(out)
        if held and (out := list(settle(held))):
            yield _ranges(out)

    rows = rows.repartition("seed").sortWithinPartitions("seed").select("seed", "doc", "hash", "low", "body")
    return rows.mapInArrow(trimmed(run), "doc long, hash long, start int, end int")


def _ranges(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "hash", "start", "end"])


def counted_twins(rows: DataFrame, length: int) -> DataFrame:
    """The same for seeds with very many windows: a row a window, named by its digest and counted by a grouping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes, lows = (batch.column(c).to_pylist() for c in ("doc", "hash", "low"))
            for doc, key, low, data in zip(docs, hashes, lows, _bytes(batch, "body"), strict=True):
                n, view = len(data) - length + 1, memoryview(data)
                names = [digest(view[i : i + length]) for i in range(n)]
                start = np.arange(low, low + n, dtype=np.int32)
                yield pa.record_batch([pa.array(names, pa.binary()), np.full(n, doc), np.full(n, key), start], ["w", "doc", "hash", "start"])

    spread = staged(rows.mapInArrow(trimmed(run), "w binary, doc long, hash long, start int"), "windows")
    double = spread.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w")
    return spread.join(double.hint("merge"), "w").select("doc", "hash", "start", (F.col("start") + length).alias("end"))


def cut_repeats(texts: DataFrame) -> DataFrame:
    """``texts``: doc_id, body, ranges. Removes the ranges: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                out = []
                for doc_id, data, ranges in zip(part.column("doc_id").to_pylist(), _bytes(part, "body"), part.column("ranges").to_pylist(), strict=True):
                    change = np.zeros(len(data) + 1, np.int32)
                    np.add.at(change, [r["start"] for r in ranges], 1)
                    np.add.at(change, [r["end"] for r in ranges], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = data[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
                    out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY_BYTES) -> tuple[DataFrame, DataFrame]:
    """``docs``: doc_id, doc, hash, body. Returns the documents that may hold repeats and the repeated ranges."""
    key = ["doc", "hash"]
    samples = staged(sampled(docs.select("doc", "hash", "body"), length, gram), "samples")
    one = F.min(F.struct("doc", "hash", "low", "high")).alias("one")
    named = samples.groupBy("seed", "name").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), one)
    seeds = named.groupBy("seed").agg(
        F.count(F.lit(1)).alias("names"), F.sum("n").alias("total"), F.max("again").alias("any_again"), F.sum(F.col("one.high") - F.col("one.low") + length).alias("bytes")
    )
    seeds = seeds.filter("total > 1 or any_again")
    named = staged(named.join(seeds.hint("merge"), "seed").select("seed", "name", "n", "names", "again", "any_again", "bytes", "one.*"), "names")
    whole = samples.join(named.filter("n > 1").select("seed", "name").hint("merge"), ["seed", "name"]).select(*key, F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    whole = staged(whole, "whole-runs")
    spread = named.filter("names > 1 or any_again")
    suspects = whole.select(*key).unionByName(spread.select(*key)).distinct()
    suspects = staged(suspects, "suspects")
    texts = staged(docs.join(suspects.hint("merge"), key, "left_semi"), "suspect-texts")

    asked = spread.groupBy(*key).agg(F.collect_list(F.struct("seed", "low", "high")).alias("runs"))  # as many as the document is long
    bodies = staged(contexts(texts.select(*key, "body").dropDuplicates(key).join(asked.hint("merge"), key), length), "contexts")
    crowded = staged(spread.filter(F.col("bytes") > many).select("seed").distinct(), "crowded")
    few = twins(bodies.join(crowded, "seed", "left_anti"), length)
    ranges = whole.unionByName(few)
    if crowded.take(1):
        ranges = ranges.unionByName(counted_twins(bodies.join(crowded, "seed", "left_semi"), length))
    return texts, staged(ranges.distinct(), "ranges")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that are left)."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("body").alias("hash"), "body")
    texts, ranges = repeated_ranges(docs, length, gram, many)
    listed = ranges.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))  # as many as the document is long
    cut = texts.join(listed.hint("merge"), ["doc", "hash"]).select("doc_id", "body", "ranges")
    touched = staged(ranges.select("doc", "hash").distinct(), "touched")
    rest = docs.join(touched.hint("merge"), ["doc", "hash"], "left_anti")
    digest = [F.octet_length("body").cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")], F.sha2("body", 256).alias("kept_sha256")]
    return rest.select("doc_id", *digest, F.col("body").alias("kept")).unionByName(cut_repeats(cut))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and as ``text`` what is left of each document; bytes of a character that was cut through become
    replacement characters there."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
