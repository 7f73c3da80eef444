"""Prefix trie, importance resampling and best-fit packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from headloom.llm import best_fit, importance, prefix_trie
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, name string, depth int, part int, block int"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -1, len(members[k]), len(kids[k]), leaves[k], saved[k], digest(ends[k])) for k in members)


def trie_rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.trie(df).collect())


def talk(seed, convs, turns=6):
    """Conversations that share beginnings, with null turns, ties, repeated rows and texts alike."""
    rng, rows = random.Random(seed), []
    for c in convs:
        for t in range(rng.randint(0, turns)):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["hello", "hello there", "", None, "a b  c\td"])))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS).repartition(3)


def test_trie_of_awkward_turns(spark):
    rows = talk(1, list(range(-30, 130)) + [10**12 + i for i in range(15)]) + [(None, 1, "user", "lost"), (7, None, None, None), (2, 1, "user", "word " * 40000)]
    assert trie_rows(frame(spark, rows)) == plain_trie(rows)


def test_trie_across_blocks(spark, monkeypatch):
    """With blocks of two places and chunks of two ids, every sum and every hash crosses blocks."""
    monkeypatch.setattr(prefix_trie, "_BITS", 1)
    monkeypatch.setattr(prefix_trie, "_IDS", 1)
    rows = talk(2, range(90), 9) + [(200 + i, t, "user", "same") for i in range(25) for t in range(5 + i % 2)] + [(300, t, "user", str(t // 3)) for t in range(40)]
    assert trie_rows(frame(spark, rows)) == plain_trie(rows)


def test_no_turns_make_no_nodes(spark):
    assert trie_rows(frame(spark, talk(1, range(3))).filter("1 = 0")) == []
    assert trie_rows(frame(spark, [(None, 1, "user", "lost")])) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_features(words):
    return Counter(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))


def plain_draw(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    for texts, sums in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for f, n in plain_features(plain_words(x)).items():
                sums[bucket(f)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out = []
    for i, x in rows:
        words = plain_words(x)
        f = plain_features(words)
        weight = sum(n * gain[bucket(k)] for k, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < percent * len(fit) // 100 else None)
    return sorted((tuple(x if x is not None else -1 for x in (r[0], r[1], r[2], r[3], r[5] if len(r) > 5 else None)) for r in out))


def drawn_rows(df):
    return sorted(tuple(x if x is not None else -1 for x in r) for r in df.collect())


def test_draw_from_awkward_rows(spark, awkward):
    target = awkward.filter("doc_id in (8, 5)")
    got = importance.resample(awkward, target, percent=60)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert drawn_rows(got) == plain_draw(rows, [x for i, x in rows if i in (8, 5)], 60)


def test_long_texts_in_small_blocks():
    """Blocks of a few bytes: every pair and triple of words that spans two blocks is counted once."""
    texts = [b"One two THREE, four-five six \xc3\xa9t\xc3\xa9 eight", b"", b"...", b"one", b"a b c d e f g h i j k l"]
    for limit in (1, 3, 7, 1000):
        found = Counter()
        for block in importance.word_blocks(texts, limit):
            rows, buckets = importance.block_buckets(block)
            found.update(zip(rows.tolist(), buckets.tolist(), strict=True))
        want = Counter()
        for i, x in enumerate(texts):
            for f, n in plain_features(plain_words(x.decode())).items():
                want[i, zlib.crc32(f.encode()) % 10000] += n
        assert found == want


def test_draw_with_ties_and_repeats(spark):
    rows = [(1, "alpha beta " * 12)] * 9 + [(None, "alpha beta " * 12)] * 5 + [(2, "gamma delta eps " * 9), (3, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = importance.resample(df, df.limit(0), percent=70)
    assert drawn_rows(got) == plain_draw(rows, [], 70)
    assert importance.resample(df.limit(0), df).count() == 0


def test_draw_of_test_table(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert drawn_rows(importance.op12_importance(spark, SF)) == plain_draw(rows, [r.text for r in target.collect()])


def plain_rooms(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    histogram, used, seen = Counter(lengths), defaultdict(list), Counter()
    for length, low, high, first, each, base in best_fit.plan(histogram, capacity):
        assert low == seen[length]
        seen[length] = high
        for k in range(low, high):
            used[first + (k - low) // each].append((base + (k - low) % each * length, length))
    assert seen == histogram and sorted(used) == list(range(len(used)))
    for found in used.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == plain_rooms(lengths, capacity)


def plain_pieces(rows, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, x in rows:
        ids = tokenizer.encode(x or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), capacity):
            piece = ids[start : start + capacity]
            out.append((-1 if i is None else i, start // capacity, start, len(piece), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in piece))))
    return sorted(out)


def check_packed(rows, packed, capacity):
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == plain_pieces(rows, capacity)
    used = defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for found in used.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == plain_rooms([r.length for r in packed], capacity)


def test_best_fit_of_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    check_packed(rows, best_fit.pack_best_fit(awkward, capacity=256).collect(), 256)
    assert best_fit.pack_best_fit(nothing).count() == 0


def test_best_fit_of_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(rows, best_fit.op13_best_fit(spark, SF).collect(), 4096)
