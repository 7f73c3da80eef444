import hashlib
from collections import Counter

import numpy as np
import pytest

from headloom.llm import suffix_dedup
from headloom.llm.common import shingle_hashes, word_hashes
from headloom.llm.components import components
from headloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from headloom.llm.near_dedup import bands, drop_near_duplicates, near_duplicates, signatures
from headloom.llm.suffix_dedup import remove_repeats
from tests.llm.conftest import prose


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("block", [7, 16384])
def test_exact_against_brute_force(awkward, block):
    rows = [(r.doc_id, lowered(r.text)) for r in awkward.collect()]
    size = Counter(t for _, t in rows)
    best = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in size}
    want = sorted(((i or -1), best[t] or -1, size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    small = awkward if block > 100 else awkward.filter("length(coalesce(text, '')) < 3000")
    found = exact_duplicates(small, block_bytes=block).collect()
    if block > 100:
        assert sorted(((r.doc_id or -1), r.keep_id or -1, r.group_size, r.text_sha256) for r in found) == want
    keys = Counter(r.text_sha256 for r in found if r.kept)
    assert set(keys.values()) == {1} and set(keys) == {r.text_sha256 for r in found}


def test_exact_drop_keeps_columns(awkward, nothing):
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [2, 4, 6, 7, 8, 9, 10, 11, 12, 13]
    assert drop_exact_duplicates(nothing).count() == 0 and exact_duplicates(nothing).count() == 0


def test_exact_drop_leaves_one_of_each_group(spark):
    rows = [(None, "Hello"), (None, "hello"), (1, "World"), (1, "world"), (2, "One"), (2, "ONE"), (3, "one"), (None, "oNe"), (4, None), (4, "")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, _key int").repartition(3)
    found = [(r.doc_id, lowered(r.text)) for r in drop_exact_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(None, "hello"), (1, "world"), (3, "one"), (4, "")], key=str)


def brute_near(rows, k):
    sets = {}
    for i, t in rows:
        words = [w for w in lowered(t).encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
        sets[i] = {tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_against_brute_force(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None]
    base = prose(3, 120).split(" ")
    for n in range(40):  # a chain of copies that drift away from the first
        base = [*base[:n], f"new{n}", *base[n + 1 :]]
        rows.append((100 + n, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_near(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == want
    assert near_duplicates(nothing).count() == 0
    assert near_duplicates(awkward).count() == awkward.count()
    assert drop_near_duplicates(awkward).columns == awkward.columns


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    one, two, three = prose(21, 80), prose(22, 80), prose(23, 80)
    rows = [(1, one), (5, one + " end"), (5, two), (5, two), (7, three), (None, one)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, component int")
    found = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert found == sorted([("1", 1, True), ("5", 1, False), ("5", 5, True), ("5", 5, True), ("7", 7, True), ("None", 1, True)])
    assert sorted(r.component for r in drop_near_duplicates(df).collect()) == [0, 2, 3, 4, 5]


def test_star_leaders_are_not_needed_for_links(spark):
    """Two ends of a chain that share a bucket with no direct link still come together through the middle."""
    words = prose(9, 300).split(" ")
    rows = [(n, " ".join(f"z{i}" if i < 9 * n else w for i, w in enumerate(words))) for n in range(6)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: c for i, (_, c) in brute_near(rows, 4).items()}


def test_min_max_is_unbiased():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 600).astype(np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 2**63, 200).astype(np.uint64)]) for _ in range(2))
    s = signatures([a, b], 48)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2
    assert (bands(s)[0] == bands(s)[0]).all() and bands(s).shape == (2, 24)


def test_shingles():
    words = word_hashes(b"A b\tc  d e")
    assert len(words) == 5 and len(shingle_hashes(words, 4)) == 2 and len(shingle_hashes(words[:2], 4)) == 1 and not len(shingle_hashes(words[:0], 4))
    assert (word_hashes(b"a B") == words[:2]).all() and not len(word_hashes(b" \n"))
    text = ("abc \x85 \x1c d" * 9 + "\n").encode()
    long = text * 40_000  # over more than one part
    assert word_hashes(long).tolist() == word_hashes(text).tolist() * 40_000


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def brute_repeats(texts, n):
    count = Counter(b[p : p + n] for b in texts for p in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_patterned_texts_are_not_taken_for_each_other(spark):
    """Words and windows whose linear hashes modulo a power of two are equal whatever the base."""
    rows = [(n, thue_morse(2048, *ab)) for n, ab in enumerate([("a", "b"), ("b", "a")])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {0: 0, 1: 1}
    words = [(n, " ".join(thue_morse(1024, *ab) if w == "x" else w for w in "one two x four five six".split())) for n, ab in enumerate([("a", "b"), ("b", "a")])]
    assert {r.component_id for r in near_duplicates(spark.createDataFrame(words, "doc_id long, text string")).collect()} == {0, 1}
    want = brute_repeats([t.encode() for _, t in rows], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()) == want


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    data = [np.frombuffer(x, np.uint8) for x in (b"0123456789abcdef", b"abcdefgh", b"hgfedcba", b"23456789")]
    want = [[i == 2 for i in range(9)], [False], [False], [True]]
    assert [x.tolist() for x in suffix_dedup.repeated(data, 8)] == want
    monkeypatch.setattr(suffix_dedup, "string_hashes", lambda x, n: np.zeros(len(x) - n + 1, np.uint64))
    assert [x.tolist() for x in suffix_dedup.repeated(data, 8)] == want


@pytest.mark.parametrize("many", [64 << 20, 600])
def test_repeats_against_brute_force(spark, nothing, many):
    passage, other = prose(40, 90), prose(41, 70)
    texts = [None, "", "short", passage, passage, "x" + passage + "y", other + passage[100:], prose(42, 60) + other, "ab" * 500, "z" * 400, "z" * 401, prose(43, 300), passage[:399], "é" * 300]
    df = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, hash long").repartition(3)
    found = remove_repeats(df, many=many).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_repeats([(t or "").encode() for t in texts], 400)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert remove_repeats(nothing).count() == 0
