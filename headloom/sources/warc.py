"""Archives of crawls (WARC, plain or gzip) as a data source: one partition a file, read and written by streaming.

A row is a record. Of a response, the body is decoded piece by piece and only what was asked for is kept, so a task's
memory doesn't grow with records. A file that breaks off or holds no record where one should start gives a row with
``error`` and ends there: what could not be read is counted, and never lost unseen.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from headloom.functions.text import latin1, site
from headloom.sources import wat
from headloom.sources.bodies import PIECE, Bytes, Unsound, inspect
from headloom.sources.scratch import each_row, give_back, small_batches

_NOTE = "array<struct<note_id: string, level: string, ancestors: array<string>, vars: map<string, string>>>"
RECORD = (
    "path string, offset long, nth long, rec_type string, record_id string, url string, ip string, date string, content_type string, length long, "
    "version string, status string, reason string, headers array<struct<name: string, value: string>>, "
    f"body_bytes long, decoded_bytes long, decoded_sha256 string, body binary, body_error string, body_notes {_NOTE}, block binary, error string"
)
WRITTEN = "rec_type string, url string, ip string, date string, content_type string, block binary"
_COLUMNS = "rec_type", "url", "ip", "date", "content_type", "block"
_OPENS = "file", "hdfs", "s3", "gs"  # what executors open by themselves; the rest comes through Spark
_FLUSH = 4 << 20


class Members:
    """Chunks of an archive, unpacked. ``start``: the offset of the gzip member that the last chunk came from."""

    def __init__(self, read, size: int = PIECE):
        self.read, self.size, self.start, self.at = read, size, 0, 0

    def __iter__(self) -> Iterator[bytes]:
        data = self.read(self.size)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = self.read(self.size)
            return
        state = None
        while data:
            if state is None or state.eof:
                state, self.start = zlib.decompressobj(31), self.at
            try:
                out = state.decompress(data, self.size)
            except zlib.error as e:
                raise Unsound("gzip", str(e).split(": ", 1)[-1]) from None
            left = state.unused_data if state.eof else state.unconsumed_tail
            self.at += len(data) - len(left)
            if out:
                yield out
            data = left or self.read(self.size)
        while state and not state.eof and (out := state.decompress(b"", self.size)):
            yield out
        if state and not state.eof:
            raise Unsound("gzip", "truncated")


def _header_lines(stream: Bytes) -> list[tuple[str, str]]:
    """To the blank line; folded lines go on, lines without a colon are passed over."""
    out: list[tuple[str, str]] = []
    while (line := stream.line(1 << 20)).strip(b"\r\n"):
        text = line.rstrip(b"\r\n").decode("latin-1")
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}".strip())
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def records(read, path: str, types: frozenset[str], keep: int, longest: int) -> Iterator[dict]:
    """One dictionary a record of ``types`` (all where empty). ``read(n)`` gives the next bytes of the file."""
    members = Members(read)
    stream, nth = Bytes(iter(members)), 0
    try:
        while True:
            line = b"\n"
            while line and not line.strip():
                line = stream.line()
            if not line:
                return
            row = {"path": path, "offset": members.start, "nth": nth}
            if not line.startswith(b"WARC/"):
                raise Unsound("record", "no record where one should start")
            head = {n.lower(): v for n, v in _header_lines(stream)}
            if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
                raise Unsound("record", "no length")
            left = length = int(head["content-length"])
            row |= {"rec_type": head.get("warc-type", "").lower(), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri", "").strip("<>") or None}
            row |= {"ip": head.get("warc-ip-address"), "date": head.get("warc-date"), "content_type": head.get("content-type"), "length": length}

            def block() -> Iterator[bytes]:
                nonlocal left
                for piece in stream.take(left):
                    left -= len(piece)
                    yield piece

            wanted, content = not types or row["rec_type"] in types, block()
            if wanted and row["rec_type"] == "response":
                row |= _response(content, head, keep)
            elif wanted and row["rec_type"] == "metadata":
                if length > longest:
                    row["error"] = f"metadata of more than {longest} bytes"
                else:
                    row["block"] = b"".join(content)
            for _ in content:
                pass
            if left:
                raise Unsound("record", "truncated")
            if wanted:
                yield row
            nth += 1
    except Unsound as e:
        yield {"path": path, "offset": members.start, "nth": nth, "error": f"{e.coding}: {e.problem}"}


def _response(content: Iterator[bytes], head: dict[str, str], keep: int) -> dict:
    http = Bytes(content)
    top = re.fullmatch(r"(HTTP/[0-9.]+)[ \t]+([0-9]{3})(?:[ \t]+(.*))?", http.line().decode("latin-1").rstrip("\r\n")) if "http" in head.get("content-type", "http") else None
    if not top:
        return {}  # a response of another protocol, or none at all
    headers = _header_lines(http)
    body = inspect(http.rest(), headers, top[2], keep, "warc-truncated" in head)
    notes = [{"note_id": n, "level": "bad", "ancestors": [], "vars": list(v.items())} for n, v in body.notes]
    return {
        "version": top[1], "status": top[2], "reason": top[3] or "", "headers": [{"name": n, "value": v} for n, v in headers], "body_bytes": body.wire, "decoded_bytes": body.decoded,
        "decoded_sha256": body.sha256, "body": body.kept if keep else None, "body_error": body.error, "body_notes": notes,
    }


def _arrow_schema() -> pa.Schema:
    pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    note = pa.list_(pa.struct([("note_id", pa.string()), ("level", pa.string()), ("ancestors", pa.list_(pa.string())), ("vars", pa.map_(pa.string(), pa.string()))]))
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    out = []
    for part in re.findall(r"(\w+) (long|string|binary|array<.*?>>+)(?:, |$)", RECORD):
        out.append((part[0], {"headers": pairs, "body_notes": note}.get(part[0]) or kinds[part[1]]))
    return pa.schema(out)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    schema, held, room = _arrow_schema(), [], 0
    for row in rows:
        held.append(row)
        room += 1000 + len(row.get("block") or b"") + len(row.get("body") or b"")
        if room > _FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, room = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri)))


@dataclass
class _File(InputPartition):
    uri: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.types = frozenset(x for x in options.get("types", "").split(",") if x)
        self.keep, self.longest = int(options.get("keepbody", 0)), int(options.get("longest", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        return [_File(x) for x in self.files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        files, path = _open(partition.uri)
        with files.open_input_stream(path, compression=None) as stream:
            yield from _batches(records(stream.read, partition.uri, self.types, self.keep, self.longest))
        give_back()


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """A file a task, under a name that starts with a dot until the job is committed."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        files, folder = _open(self.folder)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for kind, url, ip, date, content, block in each_row(batches, _COLUMNS):
            if out is None:
                files.create_dir(folder, recursive=True)
                out = files.open_output_stream(f"{folder}/.{name}", compression=None)
            block = block or b""
            head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Target-URI": url, "WARC-IP-Address": ip, "WARC-Date": date, "Content-Type": content, "Content-Length": len(block)}
            lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
            out.write(gzip.compress(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0))
        if out is None:
            return _Part(None)
        out.close()
        return _Part(name)

    def commit(self, messages) -> None:
        files, folder = _open(self.folder)
        for m in messages:
            if m and m.name:
                files.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def abort(self, messages) -> None:
        files, folder = _open(self.folder)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{folder}/.{m.name}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are appended to a folder")
        return _Writer(self.options)


def read_warc(spark: SparkSession, paths: str | list[str], types: tuple[str, ...] = (), keep_body: int = 0, longest: int = 64 << 20) -> DataFrame:
    """Records (see ``RECORD``) of files, folders or patterns. ``types``: only those; ``keep_body``: so many decoded
    bytes of each body; ``longest``: bytes of metadata beyond which a record has an error instead of its block.
    Spark lists the files; executors open them, or, of a file system that only Spark reads, get a file's bytes from it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    files = sorted(r.path for r in found.collect())  # a name a file, which any plan over files holds
    if all(x.split(":", 1)[0] in _OPENS or re.match("s3[an]:", x) for x in files):
        spark.dataSource.register(Warc)
        reader = spark.read.format("warc").option("files", json.dumps(files)).option("keepBody", keep_body).option("longest", longest)
        return reader.option("types", ",".join(types)).load()
    import io

    kinds = frozenset(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from _batches(records(io.BytesIO(content.as_buffer()).read, path, kinds, keep_body, longest))

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    return whole.mapInArrow(run, RECORD)


def write_warc(rows: DataFrame, folder: str) -> None:
    """Appends ``rows`` (see ``WRITTEN``) to ``folder``, a URI: a gzip member a record, a file a task."""
    rows.sparkSession.dataSource.register(Warc)
    small_batches(rows.sparkSession)
    rows.selectExpr(*_COLUMNS).write.format("warc").mode("append").save(folder)


def responses(found: DataFrame) -> DataFrame:
    """Responses of all records: of a response record its own, with what its body shows in ``body_notes``; of a
    metadata record what it says of one. Records of other types, and those without a response, go."""
    own = found.filter("rec_type = 'response' and status is not null").select(
        F.monotonically_increasing_id().alias("resp_id"),
        "url",
        site("url").alias("site"),
        "ip",
        F.unix_timestamp(F.try_to_timestamp("date")).cast("double").alias("crawl_ts"),
        "status",
        "reason",
        "version",
        F.transform("headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), latin1(h["value"]).alias("value"))).alias("headers"),
        "body_notes",
    )
    told = wat.parse_responses(found.filter("rec_type = 'metadata' and block is not null").select("path", F.col("block").cast("string").alias("line")))
    return own.unionByName(told.withColumn("resp_id", F.col("resp_id") + F.lit(1 << 62)).withColumn("body_notes", F.array().cast(_NOTE)))


def outcomes(found: DataFrame) -> DataFrame:
    """rec_type, error, records: how many were read, and what stopped a file or a body."""
    return found.groupBy("rec_type", F.coalesce("error", "body_error").alias("error")).agg(F.count(F.lit(1)).alias("records"))
