"""Bodies of responses, decoded a piece at a time: memory doesn't grow with the body or with what it unpacks to.

A body is an iterator of byte strings; each decoding takes one and gives one, and raises ``Unsound`` where the bytes
break its format. ``inspect`` runs a body through the codings that its headers name and says what it found.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa

PIECE = 1 << 16
_LINE = 1 << 13


class Unsound(Exception):
    """``coding`` and what is wrong with the bytes."""

    def __init__(self, coding: str, problem: str):
        super().__init__(coding, problem)
        self.coding, self.problem = coding, problem


class Bytes:
    """Lines and runs of bytes from an iterator of byte strings."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def line(self, limit: int = _LINE) -> bytes:
        """Up to and with the next line feed; what is left at the end; ``limit`` bytes at most."""
        seen = 0
        while (at := self.held.find(b"\n", seen)) < 0 and len(self.held) < limit:
            seen = len(self.held)
            if not self._more():
                break
        cut = min(at + 1 if at >= 0 else len(self.held), limit)
        out, self.held = self.held[:cut], self.held[cut:]
        return out

    def some(self, n: int) -> bytes:
        """At least one and at most ``n`` bytes, or none at the end."""
        while not self.held:
            if not self._more():
                return b""
        out, self.held = self.held[:n], self.held[n:]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n and (out := self.some(min(n, PIECE))):
            n -= len(out)
            yield out

    def rest(self) -> Iterator[bytes]:
        while out := self.some(PIECE):
            yield out


def dechunked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """RFC 9112 section 7.1: extensions and trailers are passed over."""
    stream = Bytes(chunks)
    while True:
        line = stream.line()
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,16})[ \t]*(;[^\n]*)?\r?\n", line)
        if not size:
            raise Unsound("chunked", "truncated" if not line.endswith(b"\n") else "bad chunk size")
        left = int(size[1], 16)
        if not left:
            break
        for piece in stream.take(left):
            left -= len(piece)
            yield piece
        if left:
            raise Unsound("chunked", "truncated")
        if stream.line() not in (b"\r\n", b"\n"):
            raise Unsound("chunked", "no line end after a chunk")
    while (line := stream.line()) not in (b"\r\n", b"\n"):
        if not line.endswith(b"\n"):
            raise Unsound("chunked", "truncated")


def inflated(chunks: Iterator[bytes], coding: str) -> Iterator[bytes]:
    """gzip (any number of members, zeros may follow) or deflate, which is zlib's format with its header."""
    bits = 31 if coding == "gzip" else 15
    state, begun = zlib.decompressobj(bits), False
    for chunk in chunks:
        while chunk:
            if state.eof:
                if not chunk.strip(b"\0"):
                    break
                if coding != "gzip":
                    raise Unsound(coding, "bytes after the end")
                state = zlib.decompressobj(bits)
            try:
                out = state.decompress(chunk, PIECE)
            except zlib.error as e:
                raise Unsound(coding, str(e).split(": ", 1)[-1]) from None
            begun = True
            if out:
                yield out
            chunk = state.unused_data if state.eof else state.unconsumed_tail
    while begun and not state.eof and (out := state.decompress(b"", PIECE)):
        yield out
    if begun and not state.eof:
        raise Unsound(coding, "truncated")


class _File:
    """What the Brotli stream reads from."""

    def __init__(self, chunks: Iterator[bytes]):
        self.bytes, self.closed, self.problem = Bytes(chunks), False, None

    def read(self, n: int = PIECE) -> bytes:
        try:
            return self.bytes.some(n)
        except Unsound as e:  # of a coding outside this one; the stream has no way to hand it on
            self.problem = e
            return b""

    def close(self) -> None:
        self.closed = True


def unbrotlied(chunks: Iterator[bytes]) -> Iterator[bytes]:
    first = next(chunks, None)
    if first is None:
        return

    def again() -> Iterator[bytes]:
        yield first
        yield from chunks

    source = _File(again())
    stream = pa.CompressedInputStream(pa.PythonFile(source, mode="r"), "brotli")
    while True:
        try:
            out = stream.read(PIECE)
        except OSError as e:
            raise source.problem or Unsound("br", "truncated" if "runcated" in str(e) else "bad data") from None
        if source.problem:
            raise source.problem
        if not out:
            return
        yield out


_CODINGS = {"gzip": "gzip", "x-gzip": "gzip", "deflate": "deflate", "br": "br", "identity": ""}
_NOTES = {"gzip": ("BAD_GZIP", "gzip_error"), "deflate": ("BAD_ZLIB", "zlib_error"), "br": ("BAD_BROTLI", "brotli_error")}


@dataclass
class Body:
    """``wire``: bytes after the headers; ``decoded``: of the content, as far as it could be decoded."""

    wire: int = 0
    decoded: int = 0
    sha256: str = ""
    kept: bytes = b""
    error: str | None = None
    notes: list[tuple[str, dict[str, str]]] = field(default_factory=list)


def _members(headers: list[tuple[str, str]], name: str) -> list[str]:
    return [x.strip().lower() for n, v in headers if n.lower() == name for x in v.split(",") if x.strip()]


def inspect(chunks: Iterator[bytes], headers: list[tuple[str, str]], status: str = "200", keep: int = 0, cut: bool = False) -> Body:
    """Reads ``chunks`` to the end. ``keep``: so many decoded bytes are kept. ``cut``: the archive says that it stored
    only a part, so nothing can be said against the body."""
    body, digest, kept = Body(), hashlib.sha256(), bytearray()

    def counted() -> Iterator[bytes]:
        for chunk in chunks:
            body.wire += len(chunk)
            yield chunk

    source = stream = counted()
    transfer = _members(headers, "transfer-encoding")
    for coding in reversed(_members(headers, "content-encoding") + transfer):  # the last applied comes off first
        kind = coding.split(";")[0].strip()
        if kind == "chunked":
            stream = dechunked(stream)
        elif kind in _CODINGS:
            if _CODINGS[kind] == "br":
                stream = unbrotlied(stream)
            elif _CODINGS[kind]:
                stream = inflated(stream, _CODINGS[kind])
        else:
            body.error = f"unknown coding {kind}"
            break
    try:
        for out in stream:
            digest.update(out)
            body.decoded += len(out)
            if len(kept) < keep:
                kept += out[: keep - len(kept)]
    except Unsound as e:
        body.error = f"{e.coding}: {e.problem}"
        if e.coding in _NOTES and not cut:
            note, name = _NOTES[e.coding]
            body.notes.append((note, {name: e.problem}))
    for _ in source:  # what a failed decoding has left
        pass
    body.sha256, body.kept = digest.hexdigest(), bytes(kept)
    lengths = [v.strip() for n, v in headers if n.lower() == "content-length"]
    bodyless = status in ("204", "304") or status.startswith("1")
    if lengths and lengths[-1].isascii() and lengths[-1].isdigit() and not transfer and not cut and not bodyless and int(lengths[-1]) != body.wire:
        body.notes.append(("CL_INCORRECT", {"content_length": lengths[-1], "actual_length": str(body.wire)}))
    return body
