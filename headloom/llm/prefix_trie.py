"""A trie over rebuilt conversations, with sums over its subtrees by heavy paths.

Turns get their places in a conversation from counts over ranges of the sorted table, so a conversation of any length
is dealt over tasks. A prefix is named by its depth and the sums of 60-bit hashes of its (place, turn) pairs: sums can
be built in blocks, and the name of the prefix before is a subtraction away. Grouping by name gives the nodes.

Subtree sums come by heavy paths. Each node's largest child (by members, ties to the smaller conv_id) goes on with its
path, every other child begins one; a path with ``l`` light links above it has at most 1/2^l of all members, so there
are logarithmically many levels. From the deepest level up, a node's own values and what its light children handed up
are summed from the bottom of each path (in blocks of places), and the sum at a path's top goes to the parent of the top.

Edge cases: null role or text is an empty string; turns with an equal number follow by role, then by the digest of
their text, repeated rows one after the other; a null turn comes first; rows without a conv_id are in no conversation;
a rebuilt conversation without turns is a member of the root alone; an empty table gives no nodes. Only the four named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.llm.common import read_table, shared_path, staged

GROUP = 20
HEAD = 4
_BITS = 12  # windows along a conversation or a path take blocks of 2^12 places
_IDS = 13  # a chunk of member ids spans 2^13 numbers


def _before(*by: str, order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def places(turns: DataFrame) -> DataFrame:
    """conv, at (from 0), turn_name, words. ``turns``: conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))).alias("turn_name"),
        F.sha2(text, 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = rows.groupBy("conv", "turn", "role", "digest", "turn_name", "words").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    dealt = rows.repartitionByRange("conv", *order)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()), "turns-dealt")
    inside = dealt.withColumn("_in", F.coalesce(F.sum("copies").over(Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = dealt.groupBy("conv", "part").agg(F.sum("copies").alias("n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("n").over(_before("conv", order="part")), F.lit(0))).drop("n")
    first = F.col("_start") + F.col("_in")
    put = inside.join(starts, ["conv", "part"]).withColumn("at", F.explode(F.sequence(first, first + F.col("copies") - 1)))
    return put.select("conv", "at", "turn_name", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """conv, depth, turn_name, words, last; a row for depth 0 of each conversation, without a turn. The first h turns
    come from the first conversation of a group of ids, the rest are the conversation's own; h is below ``head``."""
    put = staged(places(turns), "turns")
    heads = put.filter(F.col("at") < head - 1).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "turn_name", "words"))).alias("heads"))
    sizes = put.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % head).cast("int")
    sizes = sizes.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % group})
    sizes = sizes.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn("taken", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), 1, F.col("h")))
    sizes = sizes.withColumn("k", F.size("taken").cast("long")).withColumn("last", F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    sizes = staged(sizes.select("conv", "h", "k", "last", "taken"), "conversations")
    shared = sizes.select("conv", "last", F.posexplode("taken").alias("i", "t")).select("conv", (F.col("i") + 1).cast("long").alias("depth"), "t.turn_name", "t.words", "last")
    own = put.join(sizes.select("conv", "h", "k", "last"), "conv").filter(F.col("at") >= F.col("h"))
    own = own.select("conv", (F.col("k") + F.col("at") - F.col("h") + 1).alias("depth"), "turn_name", "words", "last")
    root = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_name"), F.lit(0).cast("long").alias("words"), "last")
    return root.unionByName(shared).unionByName(own)


def _part(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")


def _name(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.left(F.sha2(F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string")), 256), F.lit(32)))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, name, parent, words, last: a row for every prefix of every conversation."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("turn_name")), 256)
    zero = F.lit(0).cast("decimal(20,0)")
    rows = rows.withColumn("_d", digest).withColumns({"block": F.shiftright("depth", _BITS), "a": F.when(F.col("depth") > 0, _part(F.col("_d"), 1)).otherwise(zero), "b": F.when(F.col("depth") > 0, _part(F.col("_d"), 16)).otherwise(zero)}).drop("_d", "turn_name")
    rows = staged(rows, "rebuilt")
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"_a": F.sum("a").over(upto), "_b": F.sum("b").over(upto)})
    long = rows.filter(F.col("last") >= 1 << _BITS).groupBy("conv", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bases = long.select("conv", "block", *(F.sum(c).over(_before("conv", order="block")).alias(f"{c}0") for c in "ab"))
    put = inside.join(bases, ["conv", "block"], "left")
    a, b = (F.col(f"_{c}") + F.coalesce(F.col(f"{c}0"), F.lit(0)) for c in "ab")
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    above = _name(F.col("depth") - 1, (a - F.col("a")).cast("decimal(38,0)"), (b - F.col("b")).cast("decimal(38,0)"))
    return put.select("conv", "depth", "block", _name(F.col("depth"), a, b).alias("name"), F.when(F.col("depth") > 0, above).alias("parent"), "words", "last")


def member_hashes(members: DataFrame) -> DataFrame:
    """name, ends_sha256 of the ids ``conv`` of each name, ascending, joined by commas. Ids are joined by chunks of
    their range; a name with several chunks has them fed to one hash in order, a chunk a row."""
    chunk = members.groupBy("name", F.shiftright("conv", _IDS).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    chunk = staged(chunk, "member-chunks")
    many = chunk.groupBy("name").count().filter("count > 1").select("name")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != at:
                    if state:
                        out.append((at, state.hexdigest()))
                    at, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(out)
        if state:
            yield _digests([(at, state.hexdigest())])

    alone = chunk.join(many, "name", "left_anti").select("name", F.sha2("ids", 256).alias("ends_sha256"))
    rest = chunk.join(many, "name", "left_semi").repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids")
    return alone.unionByName(rest.mapInArrow(digest, "name binary, ends_sha256 string"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n for n, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["name", "ends_sha256"])


def heavy_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id, top (name of the first node of the path) and light (light links above). Flags are
    carried down along the conversations: a node's row is that of its smallest member."""
    along = paths.join(nodes, "name").withColumn("_light", F.col("heavy").isNull())
    along = along.select("conv", "depth", "block", "last", "name", "conv_id", F.when(F.col("_light"), F.struct("depth", "name")).alias("_top"), F.col("_light").cast("long").alias("_n"), F.struct("depth", "conv_id").alias("_above"))
    along = staged(along, "along")
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    upto, above = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(-1, -1)
    placed = along.withColumns({"top": F.max("_top").over(upto), "light": F.sum("_n").over(upto), "_above": F.max("_above").over(above)})
    long = along.filter(F.col("last") >= 1 << _BITS).groupBy("conv", "block").agg(F.max("_top").alias("_top"), F.sum("_n").alias("_n"), F.max("_above").alias("_above"))
    over = _before("conv", order="block")
    bases = long.select("conv", "block", F.max("_top").over(over).alias("top0"), F.sum("_n").over(over).alias("light0"), F.max("_above").over(over).alias("above0"))
    placed = placed.filter(F.col("conv") == F.col("conv_id")).join(bases, ["conv", "block"], "left")
    return placed.select(
        "name",
        F.coalesce("_above", "above0")["conv_id"].alias("parent_conv_id"),
        F.coalesce("top", "top0")["name"].alias("top"),
        (F.col("light") + F.coalesce("light0", F.lit(0)) - 1).cast("int").alias("light"),
    )


def suffix_sums(level: DataFrame, values: list[str]) -> DataFrame:
    """``values`` of each node summed with those below it on its path (top), by blocks of depths."""
    level = level.withColumn("block", F.shiftright("depth", _BITS))
    below = Window.partitionBy("top", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = level.groupBy("top", "block").agg(*(F.sum(v).alias(v) for v in values))
    under = Window.partitionBy("top").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("top", "block", *(F.coalesce(F.sum(v).over(under), F.lit(0)).alias(f"{v}0") for v in values))
    summed = level.withColumns({v: F.sum(v).over(below) for v in values}).join(blocks, ["top", "block"])
    return summed.withColumns({v: F.col(v) + F.col(f"{v}0") for v in values}).drop("block", *(f"{v}0" for v in values))


def trie(turns: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = turns.sparkSession
    paths = staged(prefixes(rebuilt(turns, group, head)), "prefixes")
    nodes = paths.groupBy("name").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"))
    nodes = staged(nodes, "nodes")
    size = F.struct((-F.col("n_convs")).alias("size"), "conv_id", "name")
    families = staged(nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.min(size)["name"].alias("heavy")), "families")
    flagged = nodes.join(families.select(F.col("parent").alias("name"), "n_children"), "name", "left").join(families.select("heavy", F.col("heavy").alias("name")), "name", "left")
    flagged = staged(flagged.withColumns({"n_leaves": F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(0).cast("long"), "n_children": F.coalesce("n_children", F.lit(0)), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "flagged")
    laid = heavy_paths(flagged.select("name", "conv_id", "heavy"), paths.select("conv", "depth", "block", "last", "name"))
    table, where = flagged.drop("words", "heavy").join(laid, "name"), shared_path(spark, "paths")
    table.write.option("compression", "zstd").partitionBy("light").parquet(where)  # a level reads its own folder
    laid = spark.read.schema(table.schema).parquet(where)
    levels = laid.agg(F.max("light")).first()[0]
    values, handed, done = ["n_leaves", "saved_tokens"], None, []
    for light in range(levels if levels is not None else -1, -1, -1):  # logarithmic in the number of conversations
        level = laid.filter(F.col("light") == light).drop("light")
        if handed is not None:
            level = level.join(handed, "name", "left").withColumns({v: F.col(v) + F.coalesce(f"{v}_up", F.lit(0)) for v in values}).drop(*(f"{v}_up" for v in values))
        level = staged(suffix_sums(level, values), "level")
        handed = level.filter("name = top").groupBy(F.col("parent").alias("name")).agg(*(F.sum(v).alias(f"{v}_up") for v in values))
        done.append(level)
    summed = done[0] if done else laid.drop("light")
    for level in done[1:]:
        summed = summed.unionByName(level)
    ends = member_hashes(paths.filter("depth = last").select("name", "conv"))
    summed = summed.join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


#: Prefixes are lists of turns; crc32 is taken by bits.
ORACLE_SQL = r"""
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as i,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), convs as (
  select c, xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(range(length(c::varchar)), lambda i: [ascii(substr(c::varchar, i::int + 1, 1))::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384::ubigint * (xor(a, x) & 1))), 4294967295::ubigint) % 4 as h
  from (select distinct c from turns)
), taken as (
  select v.c, t.i, t.role, t.text from convs v join turns t on t.c = v.c - v.c % 20 and t.i < v.h
  union all select t.c, t.i + 1000000000, t.role, t.text from convs v join turns t on t.c = v.c and t.i >= v.h
), whole as (
  select v.c, coalesce(list({'role': role, 'text': text} order by i) filter (role is not null), []) as w from convs v left join taken using (c) group by v.c
), prefix as (
  select c, d, len(w) as n, case when d = 0 then sha256('root') else sha256(w[1:d]::json::varchar) end as name,
    case when d = 0 then 0 else len(regexp_extract_all(w[d].text, '[^\x20\x09-\x0D]+')) end as words
  from (select c, w, unnest(range(0, len(w) + 1)) as d from whole)
), linked as (select *, lag(name) over (partition by c order by d) as parent from prefix),
nodes as (
  select name, min(c) as conv_id, min(d) as depth, min(parent) as parent, count(*) as n_convs, min(words) as words,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (d = n), '')) as ends_sha256
  from linked group by name
), children as (select parent as name, count(*) as n_children from nodes where parent is not null group by 1),
own as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (name)),
sums as (
  select l.name, count(*) filter (o.n_children = 0) as n_leaves, sum((o.n_convs - 1) * o.words)::bigint as saved_tokens
  from own o join linked l on l.c = o.conv_id and l.d <= o.depth group by l.name
)
select o.conv_id, o.depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
from own o join sums s using (name) left join own p on p.name = o.parent
"""
