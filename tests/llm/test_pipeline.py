from collections import Counter

import corpus_pipeline
from headloom.llm import exact_dedup, mixing, near_dedup, quality
from tests.conftest import SF
from tests.llm.test_dedup import brute_near, lowered


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            kept = {r.doc_id for r in quality.with_quality(before, "q").filter(f"q >= {quality.THRESHOLD}").collect()}
        if i == 1:
            kept = {r.doc_id for r in exact_dedup.exact_duplicates(before).filter("kept").collect()}
        if i == 2:
            kept = {r.doc_id for r in near_dedup.near_duplicates(before, shingle=5).filter("kept").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    assert sizes[0] < 200 and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]


def test_awkward_rows_pass_the_middle_stages(spark, awkward, nothing, tmp_path):
    names = {"row": "_id", "n": "_position", "name": "position"}
    docs = awkward.withColumnsRenamed(names)
    best: dict = {}
    for r in docs.collect():
        key = lowered(r.text)
        best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    exact.write.parquet(f"file://{tmp_path}/exact")
    exact = spark.read.parquet(f"file://{tmp_path}/exact")
    rows = exact.collect()
    assert {lowered(r.text): -1 if r.doc_id is None else r.doc_id for r in rows} == best and len(rows) == len(best)
    near = corpus_pipeline.near_stage(spark, exact, SF)
    near.write.parquet(f"file://{tmp_path}/near")
    near = spark.read.parquet(f"file://{tmp_path}/near")
    want = brute_near([(r.doc_id, r.text) for r in rows], 5)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    mixed = corpus_pipeline.mixing_stage(spark, near, SF)
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, near.collect()))
    assert corpus_pipeline.mixing_stage(spark, nothing.withColumnsRenamed(names), SF).count() == 0


def test_sequences_follow_the_mix(spark, tmp_path):
    rows = []
    for i in range(1500):
        source = "a" if i < 300 else "b" if i < 700 else "c"
        words = 4500 if source == "a" and i % 3 == 0 else 100 + i % 9 * 100 if source == "b" else 50 + i % 8 * 50
        rows.append((i, "word " * words, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    corpus_pipeline.mixing_stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/mixed")
    mixed = spark.read.parquet(f"file://{tmp_path}/mixed")
    found = corpus_pipeline.packing_stage(spark, mixed, SF).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0) and {r.doc_id for r in found} == set(range(1500))
    ends: dict = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 4096
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    for part in (0.1, 0.25, 0.5, 0.75):
        got, want, have = Counter(), Counter(), 0
        for r in found:
            if r.sequence_id < part * len(ends):
                got[rows[r.doc_id][2]] += r.length
        for r in sorted(found, key=lambda r: (place[r.doc_id], r.start)):
            if have < sum(got.values()):
                want[rows[r.doc_id][2]] += r.length
                have += r.length
        assert all(abs(got[s] - want[s]) < 0.06 * have for s in "abc"), (part, got, want)
