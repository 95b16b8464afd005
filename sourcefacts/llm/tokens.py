"""Whole texts to token ids with a public tokenizer, each distinct chunk encoded once.

The tokenizers used here never join text across a lone space or newline, so
texts are cut before each of these. The distinct chunks of many texts are
found by Arrow, looked up in a memory of the Python worker, and their ids are
put together by numpy. A chunk of Latin letters and ASCII is split by the
vocabulary file's own pattern and its pieces go to the library's model; any
other chunk, and any text with other white space, goes through the whole
library.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa

from .common import keep

#: Chunks, and pieces of them, that a worker remembers; a full memory is emptied.
CACHE_CHUNKS, CACHE_PIECES = 500_000, 150_000
#: Longer chunks are encoded each time they occur, so the memory stays small.
CACHE_CHARS = 48
#: Bytes of text that are put together at once; a longer text goes alone.
GROUP_BYTES = 1 << 22
#: The last character of the Latin blocks, where normalisation changes nothing.
LAST_LATIN = "ɏ"

_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　Σ]")
#: Words that any pattern of the known kinds leaves in one piece.
_PLAIN = (" word", "word", " Word", " WORD", " wOrd", " wörd")


class _Memory(dict):
    """Text to the bytes of its ids; what is missing is encoded and kept."""

    def __init__(self, encode, entries: int):
        super().__init__()
        self._encode, self._entries = encode, entries

    def __missing__(self, chunk: str) -> bytes:
        ids = self._encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self._entries:
                self.clear()
            self[chunk] = ids
        return ids


def _byte_letters() -> str:
    """The letter that stands for each byte: those without a printable Latin-1 form have one of their own."""
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return "".join(chr(256 + hidden.index(b) if b in hidden else b) for b in range(256))


class ChunkEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._model = self._library.model
        split, lower = json.loads(self._library.pre_tokenizer.__getstate__()), self._library.normalizer is not None
        if split["type"] == "ByteLevel":
            from public_tokenizers import PATTERN
        else:
            PATTERN = split["pretokenizers"][0]["pattern"]["Regex"]
        self._lower, self._pieces = lower, regex.compile(PATTERN).findall
        self._one_piece = all(self._pieces(w) == [w] for w in (p.strip().lower() if lower else p for p in _PLAIN))
        self._letters = _byte_letters()
        self._bytes = [pack("<I", i) for i in range(self._library.get_vocab_size())]
        self._piece = _Memory(self._encode_piece, CACHE_PIECES)
        self._chunk = _Memory(self._encode_chunk, CACHE_CHUNKS)
        self._newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        """The plain way, for any text."""
        ids = self._library.encode(text, add_special_tokens=False).ids
        return b"".join(map(self._bytes.__getitem__, ids))

    def _encode_piece(self, piece: str) -> bytes:
        letters = codecs.charmap_decode(piece.encode(), "strict", self._letters)[0]
        made = self._bytes
        return b"".join([made[t.id] for t in self._model.tokenize(letters)])

    def _encode_chunk(self, chunk: str) -> bytes:
        """``chunk`` brings along the space or newline before it, if there is one."""
        if chunk[0] == "\n":
            return self._newline + (self._encode_chunk(chunk[1:]) if len(chunk) > 1 else b"")
        if self._lower and chunk[0] == " ":  # byte-level vocabularies put the space into the word's first id, others drop it
            chunk = chunk[1:]
        if not chunk:
            return b""
        if not chunk.isascii() and (max(chunk) > LAST_LATIN or "İ" in chunk):
            return self.whole(chunk)
        if self._lower:
            chunk = chunk.lower()
        if self._one_piece and (chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha()):
            return self._encode_piece(chunk)
        piece = self._piece
        return b"".join([piece[p] for p in self._pieces(chunk)])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text; those of a null text are none."""
        for group in _groups(texts):
            yield from self._encode_group(group)

    def _encode_group(self, texts: pa.LargeStringArray) -> Iterator[bytes]:
        plain = [t or "" for t in texts.to_pylist()]
        odd = {
            i for i, t in enumerate(plain)
            if t and ("  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n" or _OTHER_SPACE.search(t))
        }
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        if self._lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        if not self._newline:
            data = np.where(data == 10, np.uint8(32), data)
        ends = ends - ends[0]
        # a chunk begins with every text that is not empty, and at every space and newline
        begins = (data == 32) | (data == 10)
        begins[ends[:-1][ends[1:] > ends[:-1]]] = True
        at = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        memory = self._chunk
        made = [memory[c] for c in chunks.dictionary.to_pylist()]
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        first = np.concatenate([[0], np.cumsum(size)])
        which = chunks.indices.to_numpy()
        taken = size[which]
        before = np.concatenate([[0], np.cumsum(taken)])
        ids = np.frombuffer(b"".join(made), dtype="<u4")[np.repeat(first[which] - before[:-1], taken) + np.arange(before[-1])].tobytes()
        bounds = 4 * before[np.searchsorted(at, ends)]
        for i, text in enumerate(plain):
            yield self.whole(text) if i in odd else ids[bounds[i] : bounds[i + 1]]


def _groups(texts: pa.Array) -> Iterator[pa.LargeStringArray]:
    """Slices of so many texts that their bytes stay in bounds."""
    large = texts.cast(pa.large_string())
    ends = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    low = 0
    while low < len(large):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + GROUP_BYTES, side="right")) - 1)
        yield large.slice(low, high - low)
        low = high


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this vocabulary file."""
    return keep(f"tokens of {path}", lambda: ChunkEncoder(path))


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
