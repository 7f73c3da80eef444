"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenised; every full run of ``capacity`` ids is a sequence of its own, and what remains of a
document is one item. Item lengths are counted in classes of ``width`` ids (a histogram of fixed size). A
linear program over patterns, multisets of classes that fit a sequence, minimises the number of sequences:
the simplex method keeps a basis of patterns, a knapsack dynamic program prices new ones with the duals,
and the solution is rounded down; the few items left over are packed greedily into patterns of their own.
Documents are ranked within their class without gathering the class anywhere, and the rank gives sequence
and pattern slot by arithmetic on a table bounded by the number of classes.

Where an order of the documents is given, ranks follow it, the slots of all patterns of a class are dealt out evenly
along it, and sequences are numbered by the mean place of their tokens. So each run of sequence ids holds
documents from about one stretch of the order.

Edge cases: a null or empty text is its end id alone; null ids and repeated rows are packed like others; a
document longer than a sequence is cut, and nothing else is; an empty table gives no pieces. Only id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.llm.common import read_table, running_start, staged, trimmed
from headloom.llm.tokens import PIECES, WORD_VOCAB, encoder

CAPACITY = 4096
WIDTH = 16
END_ID = 2
_BUCKET_ROWS, _SLOT_ROWS = 20_000, 50_000


def best_pattern(prices: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: class c (from 1) takes c units and earns prices[c - 1]."""
    worth, choice = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        gain = prices[:room] + worth[room - 1 :: -1][:room]
        best = int(np.argmax(gain))
        if gain[best] > worth[room - 1] + 1e-12:
            worth[room], choice[room] = gain[best], best + 1
        else:
            worth[room] = worth[room - 1]
    pattern, room = np.zeros(units, np.int64), units
    while room:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(worth[units]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan by rows. A threaded LAPACK may hang in a driver that has forked its JVM after loading numpy."""
    n = len(matrix)
    both = np.concatenate((matrix.astype(float), np.eye(n)), 1)
    for i in range(n):
        top = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, top]] = both[[top, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def solve_patterns(demand: np.ndarray, steps: int = 3000) -> list[tuple[int, np.ndarray]]:
    """(how often, pattern) such that each class is used as often as demanded; ``demand[c - 1]``: items of c units."""
    units = len(demand)
    left = demand.astype(np.int64).copy()
    out: list[tuple[int, np.ndarray]] = []
    live = np.flatnonzero(demand)
    if len(live):
        basis = [np.bincount([c], minlength=units) * (units // (c + 1)) for c in live]
        inverse = np.diag(1.0 / (units // (live + 1)))
        amount = _times(inverse, demand[live].astype(float))
        for step in range(steps):
            prices = np.zeros(units)
            prices[live] = np.maximum(inverse.sum(0), 0)
            worth, pattern = best_pattern(prices, units)
            if worth <= 1 + 1e-7:
                break
            pattern[demand == 0] = 0
            move = _times(inverse, pattern[live].astype(float))
            ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
            out_row = int(np.argmin(ratio))
            if not np.isfinite(ratio[out_row]):
                break
            amount = np.maximum(amount - ratio[out_row] * move, 0)
            amount[out_row] = ratio[out_row]
            basis[out_row] = pattern
            if step % 100 == 99:
                inverse = _inverse(np.array(basis, float).T[live])
                amount = np.maximum(_times(inverse, demand[live].astype(float)), 0)
            else:
                row = inverse[out_row] / move[out_row]
                inverse = inverse - move[:, None] * row
                inverse[out_row] = row
        for x, pattern in zip(amount, basis, strict=True):
            used = pattern > 0
            times = int(min(np.floor(x + 1e-6), (left[used] // pattern[used]).min()))
            if times > 0:
                out.append((times, pattern))
                left = left - times * pattern
    while left.any():  # what rounding down has left: fewer sequences than there are classes, each filled greedily
        room, pattern = units, np.zeros(units, np.int64)
        for c in range(units, 0, -1):
            pattern[c - 1] = take = min(room // c, int(left[c - 1]))
            room -= take * c
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((times, pattern))
        left = left - times * pattern
    return out


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, width: int, vocab: str, end_id: int, known: int = PIECES) -> DataFrame:
    """One row per piece, with its ids (binary, little-endian unsigned 32-bit), class, part and rank in (class, part)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (capacity // width + 1)
        for batch in batches:
            doc_ids, held, room = batch.column("doc_id").to_pylist(), [], 0
            for i, ids in encoder(vocab, known).documents(batch, "text", end_id):
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    data = piece.astype("<u4").tobytes()
                    kind = 0 if len(piece) == capacity else -(-len(piece) // width)
                    held.append((doc_ids[i], start, len(piece), zlib.crc32(data), len(ids), kind, part, seen[kind], data))
                    seen[kind] += 1
                    room += len(data)
                if room > 4 << 20:
                    yield _table(held)
                    held, room = [], 0
            if held:
                yield _table(held)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, part int, nth long, ids binary")


def _table(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "nth", "ids"]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (kind, bucket, ...) with their rank within the kind, by bucket and then ``by``."""
    nth = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy(*by)) - 1
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("kind", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.withColumn("nth_", nth).join(bases, ["kind", "bucket"]).withColumn("rank", F.col("base") + F.col("nth_")).drop("base", "nth_", "bucket")


def _in_order(pieces: DataFrame, order: DataFrame, place: list[tuple], total: int) -> DataFrame:
    """``pieces`` with sequence_id, turn and rank. ``order``: doc_id, position."""
    spark = pieces.sparkSession
    order = order.select(F.col("doc_id").alias("_id"), "position")
    light = pieces.select("kind", "part", "nth", "doc_id", "start", "length")
    light = light.join(order, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id").withColumn("position", F.coalesce("position", F.lit(0)))
    items = _ranked(light.withColumn("bucket", F.floor(F.col("position") / _BUCKET_ROWS)), ["position", "start", "part", "nth"])
    slots = []
    for kind, low, high, first, times, turn in place:
        n = high - low
        phase = first * 0.6180339887498949 % 1  # rare patterns shouldn't all come at the middle of the run
        slots += [(kind, a, min(a + _SLOT_ROWS, n) - 1, times, n // times, first, phase, turn) for a in range(0, n, _SLOT_ROWS)]
    table = spark.createDataFrame(slots or [(-1, 0, 0, 1, 1, 0, 0.0, 0)], "kind int, a long, b long, times long, each long, first long, phase double, turn int")
    table = table.repartition(min(200, max(1, len(slots)))).withColumn("s", F.explode(F.sequence("a", "b")))
    nth = F.floor(F.col("s") / F.col("each"))
    along = (nth + F.col("phase")) / F.col("times")
    table = table.select("kind", "turn", (F.col("first") + nth).alias("made"), along.alias("along"), F.floor(along * (1 + total // _BUCKET_ROWS)).alias("bucket"))
    dealt = staged(items.join(_ranked(table, ["along", "made"]), ["kind", "rank"]), "dealt")
    means = dealt.groupBy("made").agg((F.sum(F.col("position") * F.col("length")) / F.sum("length")).alias("mean"))
    means = staged(means.withColumn("bucket", F.floor(F.col("mean") / _BUCKET_ROWS)), "sequence-means")
    starts = running_start(means.groupBy("bucket").count(), "bucket", "count", "base").select("bucket", "base")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("mean", "made")) - 1
    ids = means.withColumn("nth_", nth).join(starts, "bucket").select("made", (F.col("base") + F.col("nth_")).alias("sequence_id"))
    return pieces.join(dealt.join(ids, "made").select("kind", "part", "nth", "turn", "rank", "sequence_id"), ["kind", "part", "nth"])


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, width: int = WIDTH, vocab: str = WORD_VOCAB, end_id: int = END_ID, known: int = PIECES,
    order: DataFrame | None = None,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids. ``known``: encoded pieces that a worker
    keeps, which trades memory for time. ``order`` (doc_id, position): the order that sequences follow."""
    spark = df.sparkSession
    pieces = staged(token_pieces(df, id_col, text_col, capacity, width, vocab, end_id, known), "pieces")
    counts = staged(pieces.groupBy("kind", "part").count(), "piece-counts")
    sums = dict(counts.groupBy("kind").agg(F.sum("count")).collect())  # a row a class
    full, units = sums.get(0, 0), capacity // width
    demand = np.array([sums.get(c, 0) for c in range(1, units + 1)], np.int64)
    place, first, slots = [(0, 0, full, 0, max(full, 1), 0)] if full else [], full, {c: 0 for c in range(1, units + 1)}
    for times, pattern in solve_patterns(demand):
        for c in (np.flatnonzero(pattern)[::-1] + 1).tolist():
            n = times * int(pattern[c - 1])
            place.append((c, slots[c], slots[c] + n, first, times, units - c + 1))
            slots[c] += n
        first += times
    if order is not None:
        put = _in_order(pieces, order, place, sum(sums.values()))
    else:
        table = spark.createDataFrame(place or [(0, 0, 0, 0, 1, 0)], "kind int, low long, high long, first long, times long, turn int")
        before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("kind", "part", "base")
        ranked = pieces.join(bases, ["kind", "part"]).withColumn("rank", F.col("base") + F.col("nth")).alias("r")
        t = F.broadcast(table).alias("t")  # bounded: classes times patterns
        hit = (F.col("r.kind") == F.col("t.kind")) & (F.col("r.rank") >= F.col("t.low")) & (F.col("r.rank") < F.col("t.high"))
        put = ranked.join(t, hit).withColumn("sequence_id", F.col("first") + (F.col("rank") - F.col("low")) % F.col("times"))
    inside = Window.partitionBy("sequence_id").orderBy("turn", "rank").rowsBetween(Window.unboundedPreceding, -1)
    put = put.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).drop("ids")
