"""Archives and bodies: framing, decoding, what unsound bytes show, and memory."""

import gzip
import io
import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from headloom.operators import findings
from headloom.plans.enrich import enrich
from headloom.sources import warc
from headloom.sources.bodies import Bytes, Unsound, dechunked, inflated, inspect, unbrotlied


def record(kind, block, more="", url="http://a.example/"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2026-06-29T10:18:14Z\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def response(headers, body):
    return b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("latin-1") + b"\r\n" + body


ARCHIVE = [
    record("warcinfo", b"software: none\r\n"),
    record("request", b"GET / HTTP/1.1\r\n\r\n"),
    record("response", response([("Server", "nginx"), ("X-Long", "a\r\n  b"), ("X-\xe9", "\xe9")], b"hello"), url="<http://b.example/>"),
    record("metadata", b'{"Envelope":{"Payload-Metadata":{"HTTP-Response-Metadata":{"Headers":{"A":"1"}}}}}'),
    record("response", b"ns1 A 10.0.0.1\n", "Content-Type: text/dns\r\n", "dns:a.example"),
    record("response", b"HTTP/1.1 204\r\n\r\n"),
    record("response", b"", "Content-Type: application/http\r\n"),
]


def read(data, **kw):
    options = {"types": frozenset(), "keep": 0, "longest": 1 << 20} | kw
    return list(warc.records(io.BytesIO(data).read, "p", **options))


@pytest.mark.parametrize("packed", [True, False])
def test_record_for_record(packed):
    parts = [gzip.compress(x) if packed else x for x in ARCHIVE]
    got = read(b"".join(parts), keep=3)
    assert [r["rec_type"] for r in got] == ["warcinfo", "request", "response", "metadata", "response", "response", "response"]
    assert [r["nth"] for r in got] == list(range(7)) and not any(r.get("error") for r in got)
    if packed:
        assert [r["offset"] for r in got] == [sum(map(len, parts[:i])) for i in range(7)]
    r = got[2]
    assert (r["url"], r["version"], r["status"], r["reason"], r["body"], r["body_bytes"], r["decoded_bytes"]) == ("http://b.example/", "HTTP/1.1", "200", "OK", b"hel", 5, 5)
    assert [tuple(h.values()) for h in r["headers"]] == [("Server", "nginx"), ("X-Long", "a b"), ("X-\xe9", "\xe9")]
    assert got[3]["block"].startswith(b'{"Envelope"') and got[5]["status"] == "204" and "status" not in got[4] and "status" not in got[6]
    assert [r["rec_type"] for r in read(b"".join(parts), types=frozenset(["metadata"]))] == ["metadata"]


def test_files_that_break_off():
    parts = [gzip.compress(x) for x in ARCHIVE[1:4]]
    whole = b"".join(parts)
    for cut in range(1, len(whole), 7):
        got = read(whole[:cut])
        ends = [sum(map(len, parts[: i + 1])) for i in range(3)]
        sound = [r for r in got if not r.get("error")]
        assert len(sound) >= sum(e <= cut for e in ends) and sound == read(whole)[: len(sound)]
        assert cut in ends or got[-1]["error"], cut
    assert read(b"".join(ARCHIVE)[:-30])[-1]["error"] == "record: no length" and read(ARCHIVE[3][:-20])[-1]["error"] == "record: truncated"
    assert read(ARCHIVE[0] + b"junk\r\n")[-1]["error"] == "record: no record where one should start"
    assert read(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")[-1]["error"] == "record: no length"
    damaged = bytearray(whole)
    damaged[len(parts[0]) + 14] ^= 255
    assert [bool(r.get("error")) for r in read(bytes(damaged))][0] is False and read(bytes(damaged))[-1]["error"].startswith(("gzip", "record"))
    assert read(b"") == []
    assert read(gzip.compress(ARCHIVE[3]), longest=10)[0]["error"] == "metadata of more than 10 bytes"


HTML = b"<p>some text</p>" * 300
SOUND = {
    "plain": ([("Content-Length", str(len(HTML)))], HTML),
    "gzip": ([("Content-Encoding", "GZIP")], gzip.compress(HTML)),
    "members": ([("Content-Encoding", "gzip")], gzip.compress(HTML[:9]) + gzip.compress(HTML[9:]) + b"\0\0\0"),
    "deflate": ([("Content-Encoding", "deflate")], zlib.compress(HTML)),
    "brotli": ([("Content-Encoding", "br")], pa.compress(HTML, "brotli", asbytes=True)),
    "both": ([("Content-Encoding", "gzip, identity"), ("Content-Encoding", "br")], pa.compress(gzip.compress(HTML), "brotli", asbytes=True)),
    "chunked": ([("Transfer-Encoding", "chunked"), ("Content-Length", "7")], b"5;a=b\r\n" + HTML[:5] + b"\r\n%X\r\n" % (len(HTML) - 5) + HTML[5:] + b"\r\n0\r\nT: x\r\n\r\n"),
}
UNSOUND = {
    "BAD_GZIP": [([("Content-Encoding", "gzip")], x) for x in (b"plain", gzip.compress(HTML)[:-9], gzip.compress(HTML) + b"x", gzip.compress(HTML)[:-8] + b"\1" * 8)],
    "BAD_ZLIB": [([("Content-Encoding", "deflate")], x) for x in (b"plain", zlib.compress(HTML)[:-1], zlib.compress(HTML) + b"x", zlib.compress(HTML)[2:])],
    "BAD_BROTLI": [([("Content-Encoding", "br")], x) for x in (b"\xff" * 40, pa.compress(HTML, "brotli", asbytes=True)[:-4])],
    "CL_INCORRECT": [([("Content-Length", str(len(HTML) + d))], HTML) for d in (-1, 1, 10**9)],
}


@pytest.mark.parametrize("name", SOUND)
def test_sound_bodies(name):
    headers, data = SOUND[name]
    for step in (1, 7, 1000, len(data)):
        body = inspect((data[i : i + step] for i in range(0, len(data), step)), headers, keep=10**6)
        assert (body.kept, body.decoded, body.wire, body.notes, body.error) == (HTML, len(HTML), len(data), [], None)
    assert inspect(iter(()), headers[:1] if name != "plain" else []).notes == []


@pytest.mark.parametrize("note", UNSOUND)
def test_unsound_bodies(note):
    for headers, data in UNSOUND[note]:
        for step in (1, 50, len(data)):
            body = inspect((data[i : i + step] for i in range(0, len(data), step)), headers)
            assert [n for n, _ in body.notes] == [note] and body.wire == len(data)
            assert all(body.notes[0][1].values())
        assert inspect(iter([data]), headers, cut=True).notes == []


def test_other_faults():
    for data in (b"", b"zz\r\n", b"5\r\nab", b"2\r\nabXX0\r\n\r\n", b"0\r\n", b"2\r\nab\r\n"):
        body = inspect(iter([data]), [("Transfer-Encoding", "chunked")])
        assert body.error.startswith("chunked") and not body.notes
    assert inspect(iter([b"x"]), [("Content-Encoding", "zstd")]).error == "unknown coding zstd"
    assert inspect(iter([]), [("Content-Length", "9")], "304").notes == [] and inspect(iter([b"x"]), [("Content-Length", "soon")]).notes == []
    broken = inspect(iter([b"5\r\n" + pa.compress(HTML, "brotli", asbytes=True)[:5] + b"\r\nzz"]), [("Content-Encoding", "br"), ("Transfer-Encoding", "chunked")])
    assert broken.error == "chunked: truncated" and not broken.notes


def test_decoders_against_whole_decoding():
    """Generated data, cut anywhere: decoded by pieces as by the libraries in one go."""
    rng = random.Random(5)
    for _ in range(60):
        data = rng.randbytes(rng.randint(0, 3000)) * rng.randint(1, 80)
        for made, run in (
            (gzip.compress(data), lambda c: inflated(c, "gzip")), (zlib.compress(data), lambda c: inflated(c, "deflate")), (pa.compress(data, "brotli", asbytes=True), unbrotlied),
            (b"".join(b"%x\r\n%b\r\n" % (len(data[i : i + 999]), data[i : i + 999]) for i in range(0, len(data), 999)) + b"0\r\n\r\n", dechunked),
        ):
            cuts = sorted(rng.randint(0, len(made)) for _ in range(5))
            parts = [made[a:b] for a, b in zip([0, *cuts], [*cuts, len(made)], strict=True)]
            assert b"".join(run(iter(parts))) == data
    with pytest.raises(Unsound):
        list(inflated(iter([gzip.compress(b"x" * 99)[:20]]), "gzip"))
    assert Bytes(iter([b"ab\nc", b"d\n", b"e"])).line() == b"ab\n"


@pytest.mark.parametrize("coding", ["", "gzip", "br"])
def test_large_bodies_take_little_memory(coding):
    """A body of 160 MB, and one that unpacks to as much."""
    size, piece = 160 << 20, b"0123456789abcdef" * 4096
    if coding == "gzip":
        packer = zlib.compressobj(9, wbits=31)
        body = b"".join(packer.compress(piece) for _ in range(size // len(piece))) + packer.flush()
    elif coding == "br":
        body = pa.compress(piece * (size // len(piece)), "brotli", asbytes=True)
    else:
        body = None
    head = f"HTTP/1.1 200 OK\r\nContent-Encoding: {coding}\r\n\r\n".encode()
    length = len(head) + (size if body is None else len(body))
    start = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\n".encode() + head
    chunks = iter([start, *([body] if body is not None else []), *([] if body is not None else [piece] * (size // len(piece))), b"\r\n\r\n", b""])
    tracemalloc.start()
    (row,) = warc.records(lambda n: next(chunks), "p", frozenset(), 100, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (row["decoded_bytes"], len(row["body"]), row["body_error"], row["body_notes"]) == (size, 100, None, []) and peak < 8 << 20


@pytest.mark.parametrize("opens", [warc._OPENS, ()])
def test_source(spark, tmp_path, monkeypatch, opens):
    """Both ways to a file's bytes give the same rows; a damaged file is counted and costs no other."""
    monkeypatch.setattr(warc, "_OPENS", opens)
    parts = [gzip.compress(x) for x in ARCHIVE]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.warc.gz").write_bytes(b"".join(parts[1:4])[:-20])
    (tmp_path / "d.warc").write_bytes(b"".join(ARCHIVE[:3]))
    bad = [([("Content-Encoding", "gzip"), ("Content-Length", "2")], b"plain")]
    (tmp_path / "e.warc.gz").write_bytes(b"".join(gzip.compress(record("response", response(h, b))) for h, b in bad))
    found = warc.read_warc(spark, str(tmp_path))
    assert {(r.rec_type, r.error): r.records for r in warc.outcomes(found).collect()} == {
        ("warcinfo", None): 2, ("request", None): 3, ("response", None): 6, ("metadata", None): 1, (None, "gzip: truncated"): 1, ("response", "gzip: incorrect header check"): 1,
    }
    rows = warc.responses(found)
    assert rows.count() == 6 and rows.select("resp_id").distinct().count() == 6
    notes = {r.note_id: r.occ for r in findings.note_counts(enrich(rows)).collect()}
    assert notes["BAD_GZIP"] == 1 and notes["CL_INCORRECT"] == 1
    assert {tuple(h) for r in rows.collect() for h in r.headers} >= {("server", "nginx"), ("a", "1"), ("x-\xe9", "\xe9")}


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("response", "http://a.example/", None, "2026-06-29T10:18:14Z", "application/http", bytearray(response([], b"x" * i))) for i in range(9)], warc.WRITTEN).repartition(3)
    folder = (tmp_path / "out").as_uri()
    warc.write_warc(rows, folder)
    warc.write_warc(rows.limit(2), folder)
    warc.write_warc(rows.limit(0), folder)
    assert not list((tmp_path / "out").glob(".*"))
    got = warc.read_warc(spark, folder, ("response",), keep_body=100)
    assert got.count() == 11 and {bytes(r.body) for r in got.collect()} == {b"x" * i for i in range(9)}
    assert got.filter("error is not null or body_error is not null").count() == 0


def test_writer_takes_few_rows_at_a_time(tmp_path):
    """A batch of any number of rows costs a writer little more memory than some of its rows."""
    import tracemalloc

    import pyarrow as pa

    from headloom.sources import warc

    names = ("rec_type", "url", "ip", "date", "content_type", "block")
    rows = pa.RecordBatch.from_pydict({n: pa.array([b"x" * 2000] * 5000) if n == "block" else pa.array(["response" if n == "rec_type" else "http://a/"] * 5000) for n in names})
    tracemalloc.start()
    try:
        warc._Writer({"path": f"file://{tmp_path}/out"}).write(iter([rows]))
        assert tracemalloc.get_traced_memory()[1] < 2_000_000
    finally:
        tracemalloc.stop()
