import numpy as np
import pytest
from pyspark.sql import functions as F

from headloom.llm.ann import nearest
from headloom.llm.mixing import block_slots, mix, schedule, whole_parts, window_of
from headloom.llm.sharding import permuted, write_shards


def test_schedule_is_within_one_block():
    parts = whole_parts({"a": 5, "b": 3, None: 1, "c": 0.2}, 100)
    assert sum(parts.values()) == 100
    order = schedule(parts, 100)
    for k, p in parts.items():
        done = 0
        for slot in range(100):
            done += order[slot] == k
            assert abs(done - (slot + 1) * p / 100) < 1
    for k, p in parts.items():
        for j, slot in enumerate(i for i, x in enumerate(order) if x == k):
            low, high = window_of(j, p, 100)
            assert low <= slot < high
    with pytest.raises(ValueError):
        whole_parts(dict.fromkeys(range(5), 1), 4)


def test_mix(spark, awkward, nothing):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long").repartition(5)
    found = sorted(mix(df, {"hot": 2, "s0": 1}, block_docs=4, cycle=64).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(600)) and sorted(r.doc_id for r in found) == list(range(600))
    assert all(r.release <= r.slot < r.deadline for r in found)
    assert mix(df, seed=1).orderBy("position").collect() == mix(df, seed=1).orderBy("position").collect()
    assert mix(awkward).count() == awkward.count() and mix(nothing).count() == 0


def test_mix_keeps_the_given_weights(spark):
    weights = {"a": 5000, "b": 3000, "c": 1999, None: 1}
    blocks = {k: 6 * w for k, w in weights.items()}
    found = sorted(block_slots(spark, weights, blocks, 512).collect(), key=lambda r: r.slot)
    assert sorted((str(r.source), r.block) for r in found) == sorted((str(k), j) for k, n in blocks.items() for j in range(n))
    for k, w in weights.items():
        slots = np.array([r.slot for r in found if r.source == k])
        assert [r.block for r in found if r.source == k] == list(range(blocks[k]))
        done = np.arange(blocks[k])
        assert (np.abs(10_000 * done - slots * w) < 10_000).all() and (np.abs(10_000 * (done + 1) - (slots + 1) * w) < 10_000).all()


def test_mix_of_many_sources(spark):
    weights = {f"s{i}": 1 + i % 7 * 0.37 for i in range(5000)} | {"big": 2000}
    df = spark.range(24_000).selectExpr("id as doc_id", "if(id < 16000, 'big', concat('s', id % 5000)) as source")
    found = mix(df, weights, block_docs=2).collect()
    assert sorted(r.doc_id for r in found) == list(range(24_000)) and sorted(r.position for r in found) == list(range(24_000))
    assert all(r.release <= r.slot < r.deadline for r in found)
    total = sum(weights.values())
    assert all(abs(r.block - r.slot * weights[r.source] / total) < 1 for r in found)


def test_permutation_is_fisher_yates(spark):
    def draw(n, bucket):
        return permuted(F.lit(n), 5, F.lit(bucket).cast("long"))

    seen = [spark.range(1).select(draw(n, 3)).first()[0] for n in (1, 2, 7, 1000)]
    assert [sorted(x) for x in seen] == [list(range(len(x))) for x in seen] and seen[3] != sorted(seen[3])
    swaps = spark.range(7).select(F.pmod(F.xxhash64(F.lit(5), F.lit(3).cast("long"), F.col("id").cast("int")), F.col("id") + 1).alias("j")).collect()
    want = list(range(7))
    for i in range(6, 0, -1):
        j = swaps[i].j
        want[i], want[j] = want[j], want[i]
    assert seen[2] == want
    rows = spark.range(600).select(permuted(F.lit(3), 5, F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(rows) == 6 and all(60 < r["count"] < 140 for r in rows)


@pytest.mark.parametrize("bucket_bytes", [50_000, 8 << 20])
def test_shards(spark, awkward, nothing, tmp_path, bucket_bytes):
    many = awkward.unionByName(spark.range(1900).select(F.col("id").alias("doc_id"), *[F.lit(None).cast(awkward.schema[c].dataType).alias(c) for c in awkward.columns[1:]]))
    many = many.unionByName(awkward.filter("doc_id = 12").withColumn("k_", F.explode(F.sequence(F.lit(1), F.lit(700)))).drop("k_"))
    before = sorted(map(repr, many.collect()))
    made = []
    for n, parts in enumerate((2, 7)):
        df = many.repartition(parts) if n else many.orderBy(F.desc("doc_id"))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found = write_shards(df, f"file://{tmp_path}/{n}", 5, bucket_bytes=bucket_bytes).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(repr(r.rec) for r in found) == before
        slots = [sorted(r.slot for r in found if r.shard == s) for s in range(5)]
        assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
        own = spark.read.parquet(f"file://{tmp_path}/{n}/shard=3").collect()
        assert sorted((r.slot, repr(r.rec)) for r in own) == sorted((r.slot, repr(r.rec)) for r in found if r.shard == 3)
        made.append(sorted((r.shard, r.slot, repr(r.rec)) for r in found))
    assert made[0] == made[1]  # whatever the layout and the partitions
    other = write_shards(many, f"file://{tmp_path}/seed", 5, seed=1, bucket_bytes=bucket_bytes).collect()
    assert sum(a == b for a, b in zip(made[0], sorted((r.shard, r.slot, repr(r.rec)) for r in other))) < len(before) / 2
    assert write_shards(nothing, f"file://{tmp_path}/none", 5).count() == 0


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) + rng.integers(0, 4, 1500)[:, None]
    x[200:260] = x[200]  # many copies
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None] * 8, 0), (None, x[0].tolist(), 0), (9005, [1.0], 0), (3, x[3].tolist(), 0), (9006, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell long")
    found: dict = {}
    for r in nearest(df, df.filter("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert sorted(found) == list(range(0, 1500, 100))
    hits = []
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        assert all(abs(d[v] - s) < 1e-9 for _, s, v in got)
        hits.append(len({v for *_, v in got} & set(want.tolist())) / 10)
    assert np.mean(hits) >= 0.9
    assert [v for *_, v in found[200]] == list(range(201, 211))
    assert nearest(df.filter("1 = 0"), df.filter("1 = 0")).count() == 0


def test_nearest_small_tables_and_outliers(spark):
    rng = np.random.default_rng(4)
    shape = "vec_id long, embedding array<double>"
    for n in (1, 8, 3000):
        x = rng.normal(size=(n, 64))
        x[: n // 100] *= np.array([3, 5, 1e160])[np.arange(n // 100) % 3, None]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], shape)
        asked = list(range(min(n, 30)))
        found = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df, df.filter("vec_id < 30")).collect())
        assert [f[:2] for f in found] == [(q, i) for q in asked for i in range(1, min(10, n - 1) + 1)]
        for q in asked:
            with np.errstate(over="ignore"):
                d = np.sqrt(((x - x[q]) ** 2).sum(1))
            want = [i for i in np.lexsort((np.arange(n), d)).tolist() if i != q][:10]
            assert [f[2] for f in found if f[0] == q] == want
