"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded random order, form blocks. With weight w, block j of a source is
released at slot floor(j / w) and due by slot ceil((j + 1) / w); in every slot the released block with the
earliest deadline goes out. Weights are exact fractions, so at any slot each source has had its share to
within less than one block, however long the run. A source that runs out leaves its slots unused and the
others keep their proportions; no document is dropped or repeated.

The run is cut into cycles of slots that are scheduled apart. At a cycle's end each source has at most one
block whose window crosses it. Those with the earliest deadlines go before it, as far as slots since their
releases are free, which leaves as little as can be to the next cycle; as the whole run has a schedule, every
cycle then has one too. So a cycle needs the weights and its number, and nothing of the cycles before.

Edge cases: a null source is a source of its own; null ids come first within their block order; repeated rows are
scheduled each; a source without a given weight, or with one of 0, gets the smallest positive given one; an empty
table gives no rows. The driver and each task hold a weight and a count for every source. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.llm.common import read_table, running_start, staged

BLOCK_DOCS = 8
CYCLE = 4096
SEED = 20240229
_BUCKET_ROWS = 20_000


def whole_parts(weights: dict, cycle: int) -> dict:
    """Weights as whole slots of a cycle: one at least, largest remainders first."""
    if len(weights) > cycle:
        raise ValueError(f"{len(weights)} sources need a cycle of as many slots; it has {cycle}")
    total = sum(weights.values())
    exact = {k: Fraction(w) / Fraction(total) * (cycle - len(weights)) for k, w in weights.items()}
    parts = {k: 1 + int(x) for k, x in exact.items()}
    late = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))
    for k in late[: cycle - sum(parts.values())]:
        parts[k] += 1
    return parts


def window_of(block: int, part: int, cycle: int) -> tuple[int, int]:
    """Release slot and deadline of a block."""
    return block * cycle // part, -(-(block + 1) * cycle // part)


def blocks_before(at: int, parts: list[int], total: int) -> list[int]:
    """How many blocks of each source (weight part / total) go before slot ``at``."""
    done = [at * p // total for p in parts]
    crossing = sorted((-(-(n + 1) * total // p), i, n * total // p) for i, (n, p) in enumerate(zip(done, parts, strict=True)) if at * p % total)
    room = at - sum(done)
    if not room:
        return done
    starts = sorted({release for _, _, release in crossing})
    first = [-(-starts[0] * p // total) for p in parts]
    if sum(max(0, n - f) for n, f in zip(done, first, strict=True)) <= len(starts) * len(parts):
        inner = np.sort(np.array([j * total // p for n, f, p in zip(done, first, parts, strict=True) for j in range(f, n)], np.int64))
        held = (len(inner) - np.searchsorted(inner, np.array(starts))).tolist()
    else:
        held = [sum(max(0, n - -(-a * p // total)) for n, p in zip(done, parts, strict=True)) for a in starts]
    free, least = {}, room  # slots since a release that whole windows leave free
    for a, n in zip(starts, held, strict=True):
        free[a] = least = min(least, at - a - n)
    up = list(range(room + 1))
    for _, i, release in crossing:
        u = free[release]
        while up[u] != u:
            up[u] = u = up[up[u]]
        if u:
            up[u] = u - 1
            done[i] += 1
    return done


def cycle_slots(begin: int, end: int, before: list[int], after: list[int], parts: list[int], total: int) -> list[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of each slot, earliest deadline first."""

    def window(i: int, j: int) -> tuple[int, int]:
        return window_of(j, parts[i], total)

    waiting = [(*window(i, n), i, n) for i, n in enumerate(before) if n < after[i]]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(begin, end):
        while waiting and waiting[0][0] <= slot:
            release, due, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (min(due, end), i, j, release, due))
        _, i, j, release, due = heapq.heappop(ready)
        assert slot < due
        out.append((i, j, release, due))
        if j + 1 < after[i]:
            heapq.heappush(waiting, (*window(i, j + 1), i, j + 1))
    return out


def schedule(parts: dict, cycle: int) -> list:
    """The source of each slot of one cycle of whole parts."""
    names, sizes = list(parts), list(parts.values())
    return [names[i] for i, *_ in cycle_slots(0, cycle, [0] * len(sizes), sizes, sizes, cycle)]


def exact_parts(weights: list) -> list[int]:
    """Whole numbers in the proportions of the weights, with no rounding."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole)
    return [w // common for w in whole]


def block_slots(spark: SparkSession, weights: dict, blocks: dict, cycle: int = CYCLE) -> DataFrame:
    """source, block, release, deadline, slot of every block."""
    names = sorted(weights, key=lambda k: (k is None, k or ""))
    parts, counts = exact_parts([weights[k] for k in names]), [blocks[k] for k in names]
    total, size = sum(parts), max(cycle, len(names))
    cycles = max(-(-(-(-n * total // p)) // size) for n, p in zip(counts, parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, list[int]] = (-1, [])
        for batch in batches:
            for c in batch.column("id").to_pylist():
                begin, end = c * size, (c + 1) * size
                if all(begin * p // total >= n for n, p in zip(counts, parts, strict=True)):
                    continue
                before = last[1] if last[0] == begin else blocks_before(begin, parts, total)
                last = end, blocks_before(end, parts, total)
                found = [(names[i], j, release, due, begin + at) for at, (i, j, release, due) in enumerate(cycle_slots(begin, end, before, last[1], parts, total)) if j < counts[i]]
                kinds = [pa.string()] + [pa.int64()] * 4
                columns = zip(*found, strict=True) if found else [[]] * 5
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["source", "block", "release", "deadline", "slot"])

    return spark.range(0, cycles, 1, min(cycles, 256)).mapInArrow(run, "source string, block long, release long, deadline long, slot long")


def mix(
    df: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, cycle: int = CYCLE, seed: int = SEED
) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position (gapless from 0). Weights default to the square
    roots of the sources' sizes, which flattens large sources."""
    spark = df.sparkSession
    source = F.col(source_col).cast("string")
    sizes = dict(df.groupBy(source.alias("k")).count().collect())
    least = min((w for w in (weights or {}).values() if w > 0), default=1)
    given = {k: n**0.5 for k, n in sizes.items()} if weights is None else {k: weights.get(k) or least for k in sizes}
    blocks = {k: -(-n // block_docs) for k, n in sizes.items()}
    if not sizes:
        return spark.createDataFrame([], "doc_id long, source string, block long, release long, deadline long, slot long, position long")
    table = staged(block_slots(spark, given, blocks, cycle), "mix-schedule")

    bits = max(0, (sum(sizes.values()) // _BUCKET_ROWS).bit_length())
    hashed = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), hashed.alias("h"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    rows = staged(rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1), "mix-rows")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    bases = bases.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "base")
    rows = rows.join(bases, rows["source"].eqNullSafe(bases["_s"]) & (rows["bucket"] == bases["_b"]))
    rank = F.col("base") + F.col("nth")
    rows = rows.select("doc_id", "source", F.floor(rank / block_docs).alias("block"), (rank % block_docs).alias("within"))

    c = table.alias("c")
    hit = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.block") == F.col("c.block"))
    rows = rows.alias("r").join(c, hit).select("doc_id", "r.source", "r.block", "within", "release", "deadline", "slot")
    slots = staged(rows.groupBy("slot").count(), "mix-slots")
    starts = running_start(slots, "slot", "count", "start").select("slot", "start")
    return rows.join(starts, "slot").select(
        "doc_id", "source", "block", "release", "deadline", "slot", (F.col("start") + F.col("within")).alias("position")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
