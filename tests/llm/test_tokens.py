import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from headloom.llm.packing import best_pattern, pack, solve_patterns
from headloom.llm.token_store import FrameReader, FrameWriter, qualified, read_tokens, uri, write_tokens
from headloom.llm.tokens import BYTE_VOCAB, WORD_VOCAB, Encoder

TEXTS = ["a  b", "a \n b", "x\n  y", " lead", "trail ", "two  ", "\n\n a  b  c", "", "a   b\t \tc", "don't  stop 'll", "É ǅ Σας ΣΑΣ", "a  b  c", "<|endoftext|> hi", "so<|endoftext|>on  <|ENDOFTEXT|>\n<|startoftext|>", "n\r\nm", "\x1f q", "l" * 50 + " m"]


def plain(vocab):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(vocab))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocab", [BYTE_VOCAB, WORD_VOCAB])
def test_pieces_give_the_same_ids(vocab):
    encode = plain(vocab)
    batch = pa.record_batch({"text": pa.array([*TEXTS, None])})
    encoder = Encoder(vocab)
    for _ in range(2):  # once cold, once from what it knows
        found = dict(encoder.documents(batch, "text", 7))
        assert [found[i].tolist() for i in range(len(batch))] == [[*encode(x), 7] for x in [*TEXTS, None]]


ODD_TEXTS = ["H\u0331 h\u0331 E\u0301t\u00c9 \u0130I\u0307", "a\u0301, b", "don't,'s 'S 'Sx x'LL ''s", "a..b,\u00e9.\u00e9 c,\u0301d", "A\tB\r\nC\x0bD\x0cE\x1fF\x85G\u2028H", "x1y22z \u0661\u00b2 \u216b", "\u00aa \u02b0a \u1c80 \ua7cb\U0001df00 \u4e2d\u6587,\u6587 \U0001f600a", "_a_b-c|d", " \u00a0a \u3000", "a \ud55c\u1100\u1161", ".", " ", "\n", "Q"]


@pytest.mark.parametrize("vocab", [BYTE_VOCAB, WORD_VOCAB])
def test_cuts_leave_ids_as_they_are(vocab):
    encode = plain(vocab)
    marks = [a + x + b for x in ("H\u0331", ",", "\u00e9", "1", "\t", "\u0301", "'s", "\n") for a in ("", "A", "b ", "\u00c9", "-", "2") for b in ("", "C", " d", "\u0301", ".", "3")]
    texts = pa.array(["", *ODD_TEXTS, None, *marks, " ".join([*ODD_TEXTS, *marks]), ""])
    encoder = Encoder(vocab)
    for part in (texts, texts, texts.slice(3, 40), texts.slice(2, 0)):  # a slice has offsets of its own
        ids, at = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encode(x) for x in part.to_pylist()]


def test_new_words_are_encoded_once_and_many_at_a_time(monkeypatch):
    given = []

    def spy(self, texts, *rest, run=Encoder._encode):
        given.extend(texts)
        return run(self, texts, *rest)

    monkeypatch.setattr(Encoder, "_encode", spy)
    words = [f"{a}{b}{c}" for a in "bdfglmnprs" for b in "aeiouy\u00e9\u00f6" for c in ("nth", "tion", "rel", "k\u00e8")]
    text = " ".join(y for x in words for y in (x, f"{x},", f"{x}.", x.title(), f"{x.upper()}\n{x}"))
    ids, _ = Encoder(WORD_VOCAB).encode(pa.array([text]))
    assert ids.tolist() == plain(WORD_VOCAB)(text)
    assert len(given) < len(words)


class Source(io.BytesIO):
    reads = 0

    def read_at(self, n, offset):
        self.reads += 1
        return self.getvalue()[offset : offset + n]

    def size(self):
        return len(self.getvalue())


def test_file_format_reads_single_documents_and_notices_damage():
    out = io.BytesIO()
    writer = FrameWriter(out, frame_bytes=400)
    docs = {i: np.arange(i, 2 * i + 1, dtype=np.uint32) for i in range(60)}
    for i, x in docs.items():
        writer.add(i, x)
    writer.close()
    data = out.getvalue()
    assert all((x == docs[i]).all() for i, _, x in FrameReader(Source(data)).read())
    source = Source(data)
    (one,) = FrameReader(source).read({41})
    assert one[0] == 41 and (one[2] == docs[41]).all() and one[1] == sum(len(docs[i]) for i in range(41)) and source.reads == 5
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(1 << 20) for _ in range(1))
    assert whole == b"".join(x.tobytes() for x in docs.values())
    broken = bytearray(data)
    broken[30] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(FrameReader(Source(bytes(broken))).read())


def test_store_round_trip(spark, awkward, nothing, tmp_path):
    path = f"file://{tmp_path}/tokens"
    encode = plain(BYTE_VOCAB)
    found = read_tokens(write_tokens(awkward, path, part_bytes=60_000), path).collect()
    texts = sorted([(-1 if r.doc_id is None else r.doc_id, np.array([*encode(r.text), 0], "<u4").tobytes()) for r in awkward.collect()])
    got = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in found)
    assert got == texts
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    listed = spark.read.parquet(f"{path}-list")
    assert {r.doc_id for r in read_tokens(listed, path, wanted=[8, 10]).collect()} == {8, 10}
    same = awkward.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(300))))
    parts = write_tokens(same, path + "1", part_bytes=60_000)
    assert parts.count() > 1 and read_tokens(parts, path + "1").count() == 300
    assert read_tokens(write_tokens(nothing, path + "0"), path + "0").count() == 0


def test_knapsack_and_patterns():
    worth, pattern = best_pattern(np.array([0.1, 0.35, 0.5, 0.0]), 4)
    assert worth == pytest.approx(0.7) and pattern.tolist() == [0, 2, 0, 0]
    rng = np.random.default_rng(3)
    for demand in (rng.integers(0, 40, 32), np.zeros(8, int), np.array([0, 0, 0, 5])):
        made = solve_patterns(demand)
        total = sum((t * p for t, p in made), np.zeros(len(demand), int))
        assert (total == demand).all() and all((p * np.arange(1, len(p) + 1)).sum() <= len(p) for _, p in made)
    demand = np.array([0, 0, 300, 0, 300, 0, 0, 0])  # threes and fives pair up without loss
    assert sum(t for t, _ in solve_patterns(demand)) == 300


def test_packing_covers_every_id_once(awkward, nothing):
    encode = plain(WORD_VOCAB)
    found = pack(awkward, capacity=256, width=16).collect()
    docs = {}
    for r in awkward.collect():
        docs.setdefault(r.doc_id, []).append(np.array([*encode(r.text), 2], "<u4"))
    for key in docs:
        own = sorted((r for r in found if r.doc_id == key), key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(len(x) for x in docs[key])
        if len(docs[key]) == 1:
            assert b"".join(bytes(r.ids) for r in own) == docs[key][0].tobytes()
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in found)
    rows = {}
    for r in found:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(rows) == list(range(len(rows)))
    for x in rows.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 256
    assert pack(nothing).count() == 0


def test_paths_are_those_of_spark(spark, tmp_path):
    """A path without a scheme goes to the default file system, not to the disk of whichever machine runs a task."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./data", f"file://{tmp_path}")
        assert qualified(spark, "/data/tokens") == "viewfs://cluster/data/tokens"
    finally:
        conf.set("fs.defaultFS", before)
        conf.unset("fs.viewfs.mounttable.cluster.link./data")
    assert [uri(x) for x in ("file:/a/b", "file:///a", "s3a://b/k", "s3n://b/k", "hdfs://n:1/x")] == ["file:///a/b", "file:///a", "s3://b/k", "s3://b/k", "hdfs://n:1/x"]
    docs = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    for at in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        assert read_tokens(write_tokens(docs, at), at).count() == 2
