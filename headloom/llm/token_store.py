"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with the ids of whole documents as little-endian
unsigned 32-bit integers, then a skippable frame with the index of documents (id, frame, tokens) and last
the seek table of the zstandard seekable format: sizes and a checksum of every frame, and a footer of nine
bytes. A reader takes the footer, the table and the index, and then only the frames that hold the documents
it wants; each is checked before use. Plain zstandard tools read the same file.

Edge cases: a null or empty text is its end id alone; rows with a null id come first; repeated rows and ids
are written as often as they come; an empty table gives no files. A document longer than a frame has a
frame of its own. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.llm.common import read_table, running_start, shared_path, size_of, trimmed
from headloom.llm.tokens import BYTE_VOCAB, encoder

END_ID = 0
FRAME_BYTES = 256 << 10
PART_BYTES = 12 << 20
_INDEX_MAGIC, _TABLE_MAGIC, _FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("tokens", "<u8")])
_ROW = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host by which Spark finds it: one without a scheme lies in the default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def uri(path: str) -> str:
    """A qualified path as ``pyarrow.fs`` spells it."""
    return re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri(path))


class FrameWriter:
    """Writes one file; ``close`` adds index, seek table and footer."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.limit = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u4").tobytes()
        if self.size and self.size + len(data) > self.limit:
            self._frame()
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), len(ids)))
        self.waiting.append(data)
        self.size += len(data)

    def _frame(self) -> None:
        import xxhash

        plain = b"".join(self.waiting)
        packed = self.pack(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.out.write(packed)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.waiting:
            self._frame()
        index = self.pack(np.array(self.docs, _DOC).tobytes())
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        rows = np.array(self.frames, _ROW).tobytes()
        self.out.write(struct.pack("<II", _TABLE_MAGIC, len(rows) + 9) + rows)
        self.out.write(struct.pack("<IBI", len(self.frames), 0x80, _FOOT_MAGIC))
        # where the index begins is what the frames add up to


class FrameReader:
    """Random access to one file: ``source`` has read_at(n, offset) and size()."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, source.size() - 9))
        if magic != _FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.frames = np.frombuffer(source.read_at(n * _ROW.itemsize, source.size() - 9 - n * _ROW.itemsize), _ROW)
        self.at = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        magic, size = struct.unpack("<II", source.read_at(8, int(self.at[-1])))
        if magic != _INDEX_MAGIC:
            raise ValueError("no index of documents")
        self.docs = np.frombuffer(self.unpack(source.read_at(size, int(self.at[-1]) + 8)), _DOC)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        plain = self.unpack(self.source.read_at(int(self.frames["packed"][k]), int(self.at[k])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, "<u4")

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids); with ``wanted``, only frames that hold those documents are decompressed."""
        before, now, data, used = 0, -1, None, 0
        for doc_id, null, frame, tokens in self.docs.tolist():
            if frame != now:
                now, data, used = frame, None, 0
            if wanted is None or (not null and doc_id in wanted):
                data = self.frame(frame) if data is None else data
                yield None if null else doc_id, before, data[used : used + tokens]
            used += tokens
            before += tokens


def write_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = BYTE_VOCAB, end_id: int = END_ID, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Encode ``df`` in ascending order of id into files below ``path``; returns part, file, tokens."""
    spark = df.sparkSession
    path = qualified(spark, path)
    total = df.agg(F.sum(size_of(text_col) + 16).alias("n")).first()["n"] or 0
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(1, -(-total // part_bytes))
    # rows without an id, or with one that repeats, may be very many: text and place part them
    order = [F.col("doc_id").asc_nulls_first(), "key", "place"]
    rows = rows.withColumns({"key": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        writer, tokens = None, 0
        files, base = _filesystem(path)
        for batch in batches:
            if writer is None:
                files.create_dir(base, recursive=True)
                draft = f"{base}/.draft-{part:06d}-{attempt}"
                writer = FrameWriter(out := files.open_output_stream(draft))
            ids = batch.column("doc_id").to_pylist()
            for i, found in encoder(vocab).documents(batch, "text", end_id):
                writer.add(ids[i], found)
                tokens += len(found)
        if writer is not None:
            writer.close()
            out.close()
            files.move(draft, f"{base}/part-{part:06d}.ztok")  # one name for every attempt, with the same bytes
            yield pa.record_batch({"part": [part], "file": [f"part-{part:06d}.ztok"], "tokens": [tokens]})

    listed = rows.mapInArrow(trimmed(write), "part long, file string, tokens long")
    listed.write.parquet(f"{path}-list")
    return spark.read.parquet(f"{path}-list")


def read_tokens(listed: DataFrame, path: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit); ``wanted``: a bounded list of ids."""
    path = qualified(listed.sparkSession, path)
    starts = running_start(listed, "part", "tokens", "start").select("file", "start")
    pick = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(path)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{file}") as source:
                    held: list[tuple] = []
                    room = 0
                    for doc_id, before, ids in FrameReader(source).read(pick):
                        held.append((doc_id, start + before, len(ids), ids.tobytes()))
                        room += ids.nbytes
                        if room > 4 << 20:
                            yield _rows(held)
                            held, room = [], 0
                    if held:
                        yield _rows(held)

    spread = starts.repartition(max(1, min(listed.count(), 100_000)))
    return spread.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*held, strict=True)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files that were written."""
    path = shared_path(spark, "tokens")
    listed = write_tokens(read_table(spark, sf_dir, "documents"), path)
    return read_tokens(listed, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
