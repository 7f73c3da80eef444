"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to a cell: projections on Gaussian directions, shifted and cut into steps. A query
visits its own cell and then neighbouring cells in the order of their estimated chance of holding a near
neighbour (the sum of squared distances to the cell borders that are crossed). Cells are dealt into blocks
of bounded size, and a task keeps the best of a block by exact Euclidean distance in double precision,
so candidates never become rows; the best of all blocks and tables are merged per query.

A query that found fewer than k, or for which a neighbour as far as its k-th would have been visited with a
chance below ``SURE`` over the draw of directions, is compared with every row, block by block. So far-out
queries and small tables get exact answers.

The width of a step follows the typical distance in a bounded sample (``SAMPLE`` vectors); every vector is
indexed. Of equal vectors a query can only use as many as it returns, and one more, those of the smallest
ids, so the index holds no more of them; that loses nothing.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do null ids. Rows that repeat an id and its vector count once. Ties go to the
smaller id. Fewer candidates than k give fewer rows. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.llm.common import mix, read_table, staged, trimmed

TABLES, DIRECTIONS, STEP, PROBES = 6, 6, 2.0, 96
SAMPLE = 2000
SURE = 0.9
SEED = 20240229
_BLOCK, _ROWS = 4096, 32768
_MOVES = np.stack(np.meshgrid(*[[-1, 0, 1]] * DIRECTIONS, indexing="ij"), -1).reshape(-1, DIRECTIONS)


class Tables:
    def __init__(self, size: int, scale: float, tables: int = TABLES, directions: int = DIRECTIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.step = STEP * scale
        self.axes = rng.normal(size=(tables, size, directions))
        self.shift = rng.uniform(0, self.step, (tables, directions))

    def places(self, table: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.axes[table] + self.shift[table]) / self.step


def cell_key(table: int, cell: np.ndarray) -> np.ndarray:
    out = np.full(cell.shape[:-1], np.uint64(table + 1))
    for i in range(cell.shape[-1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cell[..., i].astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _likeliest(part: np.ndarray, count: int) -> np.ndarray:
    cost = (part**2) @ (_MOVES == -1).T + ((1 - part) ** 2) @ (_MOVES == 1).T
    return np.argsort(cost, 1, kind="stable")[:, :count]


def probes(table: int, place: np.ndarray, count: int) -> np.ndarray:
    """Keys of the ``count`` likeliest cells for each row of ``place``, the likeliest first."""
    cell = np.floor(place)
    return cell_key(table, cell[:, None, :] + _MOVES[_likeliest(place - cell, count)])


_erf = np.frompyfunc(math.erf, 1, 1)


def chance(place: np.ndarray, reach: np.ndarray, count: int) -> np.ndarray:
    """For each row of ``place``, the chance over the draw of directions that a vector ``reach`` steps away lies
    in one of the ``count`` cells visited."""
    part = place - np.floor(place)
    edges = (np.arange(-1, 3) - part[..., None]) / (np.maximum(reach, 1e-300)[:, None, None] * 2**0.5)
    each = np.diff(_erf(edges).astype(float), axis=2) / 2
    moves = _MOVES[_likeliest(part, count)] + 1
    out = np.ones(moves.shape[:2])
    for i in range(DIRECTIONS):
        out *= np.take_along_axis(each[:, i], moves[..., i], 1)
    return out.sum(1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, count: int = PROBES
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``queries``, whose own ids are no candidates."""
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = df.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = lengths["n"]
    rows = rows.filter(F.size("v") == size)
    asked = usable(queries, id_col, vector_col).filter(F.size("v") == size)
    some = np.array([r["v"] for r in rows.select("v").limit(SAMPLE).collect()])
    with np.errstate(over="ignore"):
        gaps = np.sqrt(((some - some[np.random.default_rng(SEED).permutation(len(some))]) ** 2).sum(1))
    gaps = gaps[(gaps > 0) & np.isfinite(gaps)]
    made = Tables(size, float(np.median(gaps)) / 2**0.5 if len(gaps) else 1.0, tables)

    copies = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "v")
    indexed = staged(indexed, "ann-rows")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            for t in range(tables):
                key = cell_key(t, np.floor(made.places(t, x)))
                yield pa.record_batch([pa.array(key), batch.column("vec_id"), batch.column("v")], ["cell", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            for t in range(tables):
                key = probes(t, made.places(t, x), count)
                who = np.repeat(np.arange(len(batch)), key.shape[1])
                yield pa.record_batch([pa.array(key.ravel()), batch.column("vec_id").take(pa.array(who)), batch.column("v").take(pa.array(who))], ["cell", "id", "v"])

    shape = "cell long, id long, v array<double>"
    entries = staged(indexed.mapInArrow(trimmed(index), shape), "ann-index")
    visits = asked.mapInArrow(trimmed(ask), shape)
    sizes = entries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    visits = visits.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, have = None, [], [], None
        for batch in batches:
            x, own = _vectors(batch), batch.column("id").to_numpy()
            key = np.stack([batch.column("cell").to_numpy(), batch.column("block").to_numpy()], 1)
            side = batch.column("side").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tuple(key[a]) != now:
                    now, ids, held, have = tuple(key[a]), [], [], None
                cut = a + int((side[a:b] == 0).sum())
                if cut > a:
                    ids.append(own[a:cut])
                    held.append(x[a:cut])
                    have = None
                if cut < b and held:
                    if have is None:
                        have = np.concatenate(ids), np.concatenate(held)
                    for i in range(cut, b):
                        d = np.sqrt(((have[1] - x[i]) ** 2).sum(1))
                        d[have[0] == own[i]] = np.nan
                        near = np.lexsort((have[0], d))[:k]
                        near = near[~np.isnan(d[near])]
                        out.append((np.full(len(near), own[i]), have[0][near], d[near]))
            if out:
                yield pa.record_batch([np.concatenate(c) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def best(entries: DataFrame, visits: DataFrame, before: DataFrame | None = None) -> DataFrame:
        blocks = entries.unionByName(visits).repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
        found = blocks.mapInArrow(trimmed(search), "query_id long, vec_id long, score double")
        found = (before.select("query_id", "vec_id", "score").unionByName(found) if before else found).distinct()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    top = staged(best(dealt, visits), "ann-top")

    def doubt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, far = _vectors(batch), batch.column("far").to_numpy(zero_copy_only=False)
            missed = np.ones(len(batch))
            for t in range(tables):
                missed *= 1 - chance(made.places(t, x), far / made.step, count)
            yield batch.select(["id", "v"]).filter(pa.array(~(missed <= 1 - SURE)))

    last = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far"))
    far = F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("far")
    doubted = asked.join(last, asked["vec_id"] == last["query_id"], "left").select(F.col("vec_id").alias("id"), "v", far)
    doubted = staged(doubted.mapInArrow(trimmed(doubt), "id long, v array<double>"), "ann-doubted")
    asking = doubted.count()
    if not asking:
        return top
    across, down = -(-asking // _BLOCK), -(-indexed.count() // _ROWS)  # every row meets every query in one block of this grid
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = indexed.withColumnRenamed("vec_id", "id").select(all_of(across).alias("cell"), part(down).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    visits = doubted.select(part(across).cast("int").alias("cell"), all_of(down).alias("block"), F.lit(1).alias("side"), "id", "v")
    return best(held, visits, top)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return nearest(table, table.filter("vec_id % 100 = 0"))
