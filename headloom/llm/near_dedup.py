"""Near duplicates by min-max hashing.

A document's words are hashed one by one by a strong hash, its shingles by those of their words. Every set of shingles is hashed by a number of permutations, of which both the smallest and
the largest value are kept: half the evaluations for the same length of signature. Bands of values make
buckets; documents with the same set are one class, and a class goes on as one numbered node.

Buckets are never expanded into pairs. First each member is compared with two leaders of its bucket, the
member that shares most buckets with others and one that differs by band, which joins nearly all that belongs
together. Where a bucket then still holds several components, the documents outside its largest component are
compared with all of the bucket, in blocks of bounded size and over full sets, inside tasks; so no pair of a
bucket that could join components goes untested, and only links come out. Every link is decided by the exact sizes of
intersection and union of the two sets. Last, components of the links are found by star steps.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer words
than a shingle make one shingle. A row with a null id can't be named: it stays, and shows the component of
documents with the same set, if there are any. Rows that repeat an id are judged each by its own text; a
component is named by the smallest of all its ids. Only id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.llm.common import mix, read_table, shingle_hashes, staged, trimmed, word_hashes
from headloom.llm.components import components

PERMUTATIONS = 48
ROWS = 4
SHINGLE = 4
PERCENT = 80
_SEEDS = np.random.default_rng(8128).integers(0, 2**63, (PERMUTATIONS, 2), dtype=np.uint64)
_BLOCK_TARGETS, _BLOCK_QUERIES = 1 << 18, 1 << 17
_U = np.uint64


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for text in pc.cast(pc.fill_null(batch.column("text"), ""), pa.binary()):
        yield shingle_hashes(word_hashes(text.as_py()), shingle)


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of minima and maxima for each set; none of the sets is empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(x) for x in sets[:-1]])
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for i in range(permutations):
        y = (flat ^ _SEEDS[i, 0]) * (_SEEDS[i, 1] | _U(1))
        out[:, i] = np.minimum.reduceat(y, at)
        out[:, permutations + i] = np.maximum.reduceat(y, at)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = signature.shape[1] // rows
    out = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :n])
    return out.view(np.int64)


def describe(df: DataFrame, shingle: int = SHINGLE, rows: int = ROWS) -> DataFrame:
    """``df``: doc_id, text_key, text. doc_id, text_key, n, set_key, set_check, bands; no bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, checks = (np.zeros(len(batch), np.int64) for _ in range(3))
            found: list[np.ndarray | None] = [None] * len(batch)
            held: list[np.ndarray] = []
            who: list[int] = []
            room = 0
            for i, x in enumerate(_sets(batch, shingle)):
                n[i] = len(x)
                if len(x):
                    keys[i] = mix(x).sum(dtype=np.uint64).view(np.int64)
                    checks[i] = mix(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)
                    held.append(x)
                    who.append(i)
                    room += len(x)
                if held and (room > 1 << 16 or i == len(batch) - 1):
                    for k, row in zip(who, bands(signatures(held), rows), strict=True):
                        found[k] = row
                    held, who, room = [], [], 0
            if held:
                for k, row in zip(who, bands(signatures(held), rows), strict=True):
                    found[k] = row
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(keys), pa.array(checks), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "set_key", "set_check", "bands"],
            )

    return df.mapInArrow(trimmed(run), "doc_id long, text_key long, n long, set_key long, set_check long, bands array<long>")


def shingle_sets(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``df``: id, text. id, words (binary: the sorted 64-bit hashes of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [x.tobytes() for x in _sets(part, shingle)]
                yield pa.record_batch([part.column("id"), pa.array(found, pa.binary())], ["id", "words"])

    return df.mapInArrow(trimmed(run), "id long, words binary")


_Member = tuple[int, int, np.ndarray]  # id, label, set


def _compare(targets: list[_Member], queries: list[_Member], percent: int) -> list[tuple[int, int]]:
    """From each query one link, if there is any, to each label of targets but its own."""
    sizes = np.array([len(x) for _, _, x in targets])
    flat = np.concatenate([x for _, _, x in targets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(targets)), sizes)[order]
    labels = np.array([x for _, x, _ in targets])
    out = []
    for q, label, x in queries:
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        hits = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(hits, minlength=len(targets))
        linked = np.flatnonzero((100 * shared >= percent * (len(x) + sizes - shared)) & (labels != label))
        if len(linked):
            first = linked[np.unique(labels[linked], return_index=True)[1]]
            out += [(q, targets[t][0]) for t in first.tolist()]
    return out


def verified(targets: DataFrame, queries: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links a, b between queries and targets of the same key and different labels. Both: key, id, label, n. A
    key's documents are dealt into blocks by the sizes of their sets, so that no task holds more than a few MB."""
    t_size = targets.groupBy("key").agg(F.ceil(F.sum("n") / _BLOCK_TARGETS).cast("int").alias("ti"))
    q_size = queries.groupBy("key").agg(F.ceil(F.sum("n") / _BLOCK_QUERIES).cast("int").alias("qj"))
    sizes = staged(t_size.join(q_size, "key"), "block-sizes")

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own, other = ("ti", "qj") if side == 0 else ("qj", "ti")
        df = df.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(side)), F.col(own)).cast("int"))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("own", "other") if side == 0 else ("other", "own")
        return df.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, ([], [])
        links: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True)
            sides, ids, labels = (batch.column(c).to_pylist() for c in ("side", "id", "label"))
            words = batch.column("words")
            for at, key in enumerate(keys):
                if key != now:
                    if block[0] and block[1]:
                        links += _compare(*block, percent)
                    now, block = key, ([], [])
                block[sides[at]].append((ids[at], labels[at], np.frombuffer(words[at].as_py(), np.uint64)))
            if links:
                yield _pairs(links)
                links = []
        if block[0] and block[1]:
            links += _compare(*block, percent)
        if links:
            yield _pairs(links)

    rows = dealt(targets, 0).unionByName(dealt(queries, 1)).join(sets, "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return rows.select("key", "i", "j", "side", "id", "label", "words").mapInArrow(trimmed(run), "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _judged(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, component: one row per row of ``df``."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    known = staged(describe(docs, shingle), "signatures")
    same = ["set_key", "set_check", "n"]
    # a number of its own for each class, fixed as it is written; its text is looked up by one row's id and text
    classes = known.filter("n > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands"))
    classes = staged(classes.select(*same, "rep.*", "bands", F.monotonically_increasing_id().alias("id")), "classes")
    entries = classes.select(F.explode("bands").alias("b"), "id", "n")
    crowded = entries.groupBy("b").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    entries = staged(entries.join(crowded, "b"), "entries")

    central = entries.groupBy("id").agg(F.sum("size").alias("shared"))
    ranked = entries.join(central, "id")
    leaders = ranked.groupBy("b").agg(
        F.max(F.struct("shared", "id", "n")).alias("most"), F.max(F.struct(F.xxhash64("b", "id").alias("h"), "id", "n")).alias("any")
    )
    leaders = staged(leaders.select("b", F.explode(F.array_distinct(F.array(F.struct("most.id", "most.n"), F.struct("any.id", "any.n")))).alias("lead")).select("b", "lead.*").toDF("b", "key", "lead_n"), "leaders")
    fits = (F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent) & (F.col("id") != F.col("key"))
    stars = staged(entries.join(leaders, "b").filter(fits).select("key", "lead_n", "id", "n").distinct(), "stars")
    wanted = staged(classes.join(entries.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_key"), "wanted")
    # grows with the corpus, so a merge join at every size
    sets = staged(shingle_sets(docs.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("id", "text", "doc_id", "text_key").dropDuplicates(["id"]).select("id", "text"), shingle), "sets")
    heads = stars.select("key", F.col("key").alias("id"), F.col("key").alias("label"), F.col("lead_n").alias("n")).distinct()
    links = staged(verified(heads, stars.select("key", "id", F.col("id").alias("label"), "n"), sets, percent), "star-links")

    found = staged(components(links), "star-components")
    placed = entries.join(found, "id", "left").withColumn("label", F.coalesce("component", "id"))
    held = placed.groupBy("b", "label").count().groupBy("b").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("count", "label")).alias("top"))
    mixed = staged(held.filter("labels > 1").select("b", F.col("top.label").alias("main")), "mixed")
    members = staged(placed.join(mixed, "b").select(F.col("b").alias("key"), "id", "label", "n", "main"), "members")
    rest = members.filter("label <> main")
    more = staged(verified(members, rest, sets, percent), "block-links")

    final = components(links.unionByName(more)) if more.take(1) else found
    placed = classes.select(*same, "id", F.col("doc_id").alias("least")).join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(placed.join(named, "component").select(*same, "component_id"), "named")
    return known.join(named.hint("merge"), same, "left").select("doc_id", "text_key", "n", F.coalesce("component_id", "doc_id").alias("component"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``df``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return _judged(df, id_col, text_col, shingle, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    lost = _judged(df, id_col, text_col, shingle, percent).filter("doc_id <> component").select(F.col("doc_id").alias("_lost"), F.col("text_key").alias("_lost_text"))
    lost = staged(lost.distinct(), "lost").alias("_gone")
    gone = (df[id_col].cast("long") == F.col("_gone._lost")) & (F.xxhash64(df[text_col].cast("string")) == F.col("_gone._lost_text"))
    return df.join(lost, gone, "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
