"""Exact duplicates by deterministic block naming.

A normalised text is cut into fixed-size blocks. Distinct blocks are sorted and named by integers; then
adjacent pairs of names are named in the same way, again and again, until each document has one name.
Names are given to whole blocks and whole pairs, so two documents share an identity only if their texts
are equal: no hash decides. A (length, 64-bit hash) that occurs once proves its document to be alone, so
only the others are cut into blocks.

Edge cases: a null text counts as empty; all empty texts form one group. Rows with a null id take part and
lose to any row with an id. A repeated row is a copy like any other, and of rows that tie on the largest
id one stays. Only the id and text columns are read, so other columns may have any name. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headloom.llm.common import read_table, staged

BLOCK_BYTES = 16384
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER)


def _named(items: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct keys, sorted, each with an integer name. Written, so that a name never changes."""
    distinct = items.select(*keys).distinct().sortWithinPartitions(*keys)
    return staged(distinct.withColumn("name", F.monotonically_increasing_id()), label)


def block_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows``: row, doc_id, sha, body (binary). Returns row, doc_id, sha, n_blocks, name: equal bodies have
    equal (n_blocks, name) and others don't."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    blocks = rows.withColumn("n_blocks", count).select(
        "row", "doc_id", "sha", "n_blocks", F.posexplode(cut).alias("at", "block")
    )
    first = F.when(F.col("at") == 0, F.col("sha")).alias("sha")
    names = _named(blocks, ["block"], "blocks")
    level = staged(
        blocks.join(names, "block").select("row", "doc_id", first, "n_blocks", "at", "name"), "level-0"
    )
    done = level.filter("n_blocks = 1")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    level = level.filter("n_blocks > 1")
    for step in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        pairs = level.groupBy("row", F.expr("at div 2").cast("int").alias("at")).agg(
            F.first("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
            F.first("n_blocks").alias("n_blocks"),
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = _named(pairs, ["left", "right"], f"pairs-{step}")
        level = staged(pairs.join(names, ["left", "right"]).drop("left", "right"), f"level-{step}")
    return done.unionByName(level).drop("at")


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(text_col).alias("norm"),
    )
    keyed = base.withColumns(
        {"size": F.octet_length("norm"), "hash": F.xxhash64("norm"), "sha": F.sha2(F.col("norm").cast("binary"), 256)}
    )
    light = staged(keyed.select("doc_id", "size", "hash", "sha"), "light")
    shared = staged(light.groupBy("size", "hash").count().filter("count > 1").select("size", "hash"), "shared")
    alone = light.join(shared, ["size", "hash"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    rows = keyed.join(shared, ["size", "hash"], "left_semi").select("row", "doc_id", "sha", F.col("norm").cast("binary").alias("body"))
    named = block_names(rows, block_bytes)
    groups = staged(
        named.groupBy("n_blocks", "name").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best")
        ),
        "groups",
    )
    found = named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(found)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Ids name documents; rows that repeat an id, or the
    null id, and its normalised text count as one."""
    ids, distinct = df.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if ids != distinct:  # (id, normalised text) names one row from here on, so no row that stays has a lost one's key
        name = "_key"
        while name in df.columns:
            name += "_"
        df = df.withColumn(name, F.sha2(normalised(text_col).cast("binary"), 256)).dropDuplicates([id_col, name]).drop(name)
    lost = staged(exact_duplicates(df, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_lost"), F.col("text_sha256").alias("_sha")), "lost")
    if ids == distinct:
        return df.join(lost, df[id_col].eqNullSafe(lost["_lost"]), "left_anti")
    same = df[id_col].eqNullSafe(lost["_lost"]) & (F.sha2(normalised(df[text_col]).cast("binary"), 256) == lost["_sha"])
    return df.join(lost, same, "left_anti")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
