"""Fast token ids from the tokenizers library, inside Arrow batches.

Neither vocabulary lets a token cross from a non-blank into following white space, nor from a letter into
what is no letter, so a text is cut before its spaces and line ends and after its ASCII words, the distinct pieces of a
batch are encoded once each, and ids are gathered back by piece. The word vocabulary ignores case and the kind of a
blank, so pieces are folded before, and as its tokens say where a word ends, new words are encoded many at a time.
Texts with longer runs of white space, which may be one token of the byte-level
vocabulary, are encoded whole, as are texts that hold one of the vocabulary's added tokens and, for the word
vocabulary, a capital with a combining mark, which are composed before case is folded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_VOCAB, WORD_VOCAB = "byte_bpe_50k.json", "word_bpe_49k.json"
_BLANK = r"[\s\x0b\x{85}\p{Z}]"
_SLICE_BYTES = 4 << 20
PIECES = 700_000  # known pieces a worker keeps; about 200 bytes each
_BATCH, _JOINED = 4096, 256
_LETTER, _PLAIN, _CUT = (np.zeros(256, bool) for _ in range(3))  # ASCII letters, other ASCII, what starts a piece
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN[:128] = ~_LETTER[:128]
_CUT[[32, 10]] = True
_FOLD = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\r", b"   "))  # bytes.lower is ASCII only


class Encoder:
    def __init__(self, vocab: str, pieces: int = PIECES):
        self.limit = pieces
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocab if os.path.isabs(vocab) else public_tokenizers.path(vocab)
        self.tokenizer = Tokenizer.from_file(path)
        self.folds = "word_bpe" in os.path.basename(path)
        self.odd = r"[A-Z]\p{M}" if self.folds else f"{_BLANK}{{3}}|{_BLANK}{{2}}$"
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.odd += f"|(?i:{re.escape(token.content)})"
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = self.folds
        self.known: dict[bytes, int] = {}  # piece -> where in starts and sizes; the first ``pieces`` seen
        self.flat, self.starts, self.sizes = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64))

    def _encode(self, texts: list[str], at_once: int = _BATCH) -> list[list[int]]:
        run = self.tokenizer.encode_batch_fast  # an encoding holds far more than its ids: few at a time
        return [x.ids for at in range(0, len(texts), at_once) for x in run(texts[at : at + at_once], add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end and their number for each of ``words``, a blank and letters each, encoded as lines of words. A
        word has one id at least that ends a word, so where a line has as many as words, each has exactly one."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        lines = [words[at : at + _JOINED] for at in range(0, len(words), _JOINED)]
        for line, ids in zip(lines, self._encode(["".join(x) for x in lines], _BATCH // _JOINED), strict=True):
            found = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(line):
                flat.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                single = self._encode(line)
                flat.append(np.fromiter(chain.from_iterable(single), np.uint32))
                sizes.append(np.fromiter(map(len, single), np.int64, len(single)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and where each given piece starts in them and how many it has."""
        at = np.array(list(map(self.known.get, pieces, repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0)
        fresh = [pieces[i] for i in new.tolist()]
        texts = [x.decode() for x in fresh]
        easy = np.fromiter((self.folds and x[0] == " " and x[1:].isalpha() for x in texts), bool, len(texts))
        order = np.argsort(~easy, kind="stable")
        split = np.count_nonzero(easy)
        texts = [texts[i] for i in order.tolist()]
        ids, sizes = self._words(texts[:split])
        rest = self._encode(texts[split:])
        sizes = np.concatenate((sizes, np.fromiter(map(len, rest), np.int64, len(rest))))
        flat = np.concatenate((self.flat, ids, np.fromiter(chain.from_iterable(rest), np.uint32)))
        starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        sizes = np.concatenate((self.sizes, sizes))
        at[new[order]] = len(self.starts) + np.arange(len(new))
        if len(self.known) < self.limit:
            self.known.update(zip((fresh[i] for i in order.tolist()), range(len(self.starts), len(starts)), strict=True))
            self.flat, self.starts, self.sizes = flat, starts, sizes
        return flat, starts[at], sizes[at]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts on end, and where each text's pieces begin (one more entry than texts)."""
        _, places, body = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if places else np.zeros(1, np.int64)
        data = memoryview(body)[places[0] : places[-1]] if body else b""
        places = places - places[0]
        if self.folds:
            data = bytes(data).translate(_FOLD)
        codes = np.frombuffer(data, np.uint8)
        cut = _CUT[codes]
        cut[1:] |= _LETTER[codes[:-1]] & _PLAIN[codes[1:]]
        cut[places[:-1][places[:-1] < len(codes)]] = True
        at = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(at, len(codes)))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(data)]), np.searchsorted(at, places)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        pieces, ends = self._cut(texts.filter(pa.array(~whole)) if whole.any() else texts)
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        _, places, body = coded.dictionary.buffers()
        body = bytes(body or b"")
        flat, starts, sizes = self._pieces([body[a:b] for a, b in pairwise(np.frombuffer(places, np.int64)[: len(coded.dictionary) + 1].tolist())] if len(code) else [])
        n = sizes[code]
        at = np.concatenate(([0], np.cumsum(n)))
        gathered = flat[np.repeat(starts[code] - at[:-1], n) + np.arange(at[-1])] if len(n) else flat
        if not whole.any():
            return gathered, at[ends]
        parts: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for k, i in enumerate(np.flatnonzero(~whole)):
            parts[i] = gathered[at[ends[k]] : at[ends[k + 1]]]
        odd = np.flatnonzero(whole)
        for i, x in zip(odd, self._encode(texts.take(pa.array(odd)).to_pylist()), strict=True):
            parts[i] = np.array(x, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def documents(self, batch: pa.RecordBatch, text: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
        """Row number and ids, end id included, of each row of the batch; a few MB of text at a time."""
        column = batch.column(text)
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(column):
            base = size[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(size, base + _SLICE_BYTES, "right")))
            ids, at = self.encode(column.slice(begin, stop - begin))
            for i in range(stop - begin):
                yield begin + i, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
            begin = stop


@lru_cache(maxsize=1)
def encoder(vocab: str, pieces: int = PIECES) -> Encoder:
    """One for each worker process, so that what it has learnt serves the tasks to come."""
    return Encoder(vocab, pieces)
