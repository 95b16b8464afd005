"""Removal of passages that an earlier document has, too.

Every window of a fixed number of words has a Rabin-Karp hash. Tasks sort the
windows of many documents at a time and send each different one once, packed,
to the task of its range of hashes, which finds the smallest document of each.
What comes back to a document is the set of its windows that a smaller one
has; their words merge to maximal intervals, which are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import keep, materialize

WINDOW = 13
#: Windows that a task sorts at a time, and windows in a range of hashes.
CHUNK = RANGE = 1 << 21
#: Bytes of text that are hashed at a time; a word is never cut.
TEXT_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: The odd bases of the hashes of words and of windows.
_WORD_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: A number for each byte.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_WORD_BASE))


class _Powers:
    """Powers of a base modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(0, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            many = 1 << max(10, (n - 1).bit_length())
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(many - 1, b, dtype=np.uint64)])) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def _powers(base: int) -> _Powers:
    return keep("powers", dict).setdefault(base, _Powers(base))


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes of ``values[begin:end]``: values times powers of the base, the first with power 0."""
    up, down = _powers(base).first(max(1, len(values)))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[begins]) * down[begins]


def _hash_bytes(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begins, ends = edges[0::2], edges[1::2]
    return _mix(_sums(_BYTE[data], begins, ends, _WORD_BASE) + (ends - begins).astype(np.uint64)) if len(begins) else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text's bytes, in order."""
    if len(data) <= TEXT_BYTES:
        return _hash_bytes(data)
    out, low = [], 0
    while low < len(data):
        high = min(len(data), low + TEXT_BYTES)
        while high < len(data) and not _SPACE[data[high]]:
            more = np.flatnonzero(_SPACE[data[high : high + TEXT_BYTES]])
            high = high + int(more[0]) if len(more) else min(len(data), high + TEXT_BYTES)
        out.append(_hash_bytes(data[low:high]))
        low = high
    return np.concatenate(out)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of the window that begins at each word and ends inside."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    begins = np.arange(n)
    return _mix(_sums(words, begins, begins + window, _WINDOW_BASE))


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers, each byte's place apart, so that what all have alike takes no room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


#: ``hashes`` ascend and are packed as differences; the document of each is ``least`` and
#: what ``docs`` adds. With a ``group`` these are answers already: windows that a smaller
#: document has, of documents of that group.
WINDOWS = "part int, group int, least long, hashes binary, docs binary"
ANSWERS = "group int, least long, hashes binary, docs binary"
KNOWN = "_doc long, _hashes binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _packed(hashes: np.ndarray, docs: np.ndarray) -> tuple[int, bytes, bytes]:
    """``least, hashes, docs`` of windows with ascending hashes."""
    least = int(docs.min())
    return least, _pack(_steps(hashes)), _pack(docs.view(np.uint64) - np.int64(least).view(np.uint64))


def _unpacked(least: int, hashes: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(hashes), dtype=np.uint64), (_unpack(docs) + np.int64(least).view(np.uint64)).view(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if not len(values):
        return iter(())
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return zip(begins, np.append(begins[1:], len(values)), strict=True)


def _answers(hashes: np.ndarray, docs: np.ndarray, groups: int) -> Iterator[tuple]:
    """The windows of each group of documents."""
    group = (_mix(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((hashes, group))
    hashes, docs, group = hashes[order], docs[order], group[order]
    return ((int(group[b]), *_packed(hashes[b:e], docs[b:e])) for b, e in _runs(group))


def _windows(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Different windows of every task with their smallest document there, and answers that need no other task."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        amount = 0

        def told() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(held)
            owner = np.repeat(np.array([d for d, _ in owners], dtype=np.int64), [n for _, n in owners])
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            least = owner[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            late = owner > least
            late[1:] &= ~((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))  # each once
            out = [(row[0], *row) for row in _answers(hashes[late], owner[late], parts)]
            hashes, least = hashes[fresh], owner[fresh]
            # ranges of equal width; the product of the upper half never overflows
            part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            for b, e in _runs(part):
                out.append((int(part[b]), None, *_packed(hashes[b:e], least[b:e])))
                if len(out) >= 256:
                    yield _batch(out, WINDOWS)
                    out = []
            yield _batch(out, WINDOWS)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = window_hashes(word_hashes(np.frombuffer(text.as_buffer(), dtype=np.uint8)), window)
                if len(found):
                    held.append(found)
                    owners.append((doc, len(found)))
                    amount += len(found)
                if amount >= CHUNK:
                    yield from told()
                    held, owners, amount = [], [], 0
        if held:
            yield from told()

    return docs.mapInArrow(send, WINDOWS)


def _repeated(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Answers to the windows of each range of hashes, of rows sorted by range."""
    part, held = None, []

    def told() -> Iterator[pa.RecordBatch]:
        h, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        late = d > d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        late[1:] &= fresh[1:] | (d[1:] != d[:-1])
        yield _batch(list(_answers(h[late], d[late], groups)), ANSWERS)

    for batch in batches:
        for name, group, *packed in zip(*(batch.column(c).to_pylist() for c in ("part", "group", "least", "hashes", "docs")), strict=True):
            if group is not None:
                yield _batch([(group, *packed)], ANSWERS)
                continue
            if held and name != part:
                yield from told()
                held = []
            part = name
            held.append(_unpacked(*packed))
    if held:
        yield from told()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each document, of answers sorted by group."""
    group, held = None, []

    def told() -> pa.RecordBatch:
        h, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        return _batch([(int(d[b]), _pack(_steps(np.unique(h[b:e])))) for b, e in _runs(d)], KNOWN)

    for batch in batches:
        for name, *packed in zip(*(batch.column(c).to_pylist() for c in ("group", "least", "hashes", "docs")), strict=True):
            if held and name != group:
                yield told()
                held = []
            group = name
            held.append(_unpacked(*packed))
    if held:
        yield told()


def maximal_intervals(marked: np.ndarray, window: int) -> np.ndarray:
    """Begin and end of the longest runs of words that marked windows cover, from where these begin."""
    if not len(marked):
        return np.zeros((0, 2), np.int64)
    apart = np.flatnonzero(np.diff(marked) > window)
    return np.stack([marked[np.concatenate([[0], apart + 1])], marked[np.append(apart, len(marked) - 1)] + window], axis=1)


def _spans(window: int, packed: bytes, text: np.ndarray) -> np.ndarray:
    known = np.cumsum(_unpack(packed), dtype=np.uint64)
    found = window_hashes(word_hashes(text), window)
    return maximal_intervals(np.flatnonzero(np.isin(found, known)), window)


SPANS = "had_text boolean, n_words long, removed array<array<long>>, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` but the text in ``row``, and ``doc_id, had_text, n_words, removed, kept``.

    A word goes when it is in a window whose words also stand in a document of
    a smaller ``doc_id``, as the documents came. ``removed`` are the maximal
    intervals [begin, end) of such words; ``kept`` are the others with one
    space between. Rows without an id are neither smaller nor greater than
    others and keep all; rows with the same id don't count for each other. A
    null text has no words. Windows are told apart by 64-bit hashes: one of
    T windows of other words agrees with a given one with odds of T * 2**-64.
    Words are bytes and are not changed. An empty table gives no rows.
    """
    text = F.col("text").cast("string").cast("binary")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    named = rows.select("doc_id", "text").where("doc_id is not null and text is not null")
    # a word and its space are mostly six bytes or more; this only sets how many ranges and groups there are
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (6 * RANGE)))
    sent = _windows(named, window, parts)
    answers = sent.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _repeated(it, parts), ANSWERS)
    known = materialize(answers.repartition("group").sortWithinPartitions("group").mapInArrow(_by_document, KNOWN), "repeats")
    joined = rows.join(known.hint("merge"), F.col("doc_id") == F.col("_doc"), "left").select("row", "doc_id", "text", "_hashes")
    shape = joined.select("row", "doc_id").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, kept = [], [], []
            for text, packed in zip(batch.column("text"), batch.column("_hashes").to_pylist(), strict=True):
                words = text.as_py().split() if text.is_valid else []
                gone = _spans(window, packed, np.frombuffer(text.as_buffer(), dtype=np.uint8)).tolist() if packed and len(words) >= window else []
                counts.append(len(words))
                spans.append(gone)
                if gone:
                    begins, ends = [0, *[e for _, e in gone]], [*[b for b, _ in gone], len(words)]
                    words = [w for b, e in zip(begins, ends, strict=True) for w in words[b:e]]
                kept.append(b" ".join(words))
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("text").is_valid(), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *[f.split()[0] for f in SPANS.split(", ")]])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.fields)
    return joined.mapInArrow(cut, f"{ddl}, {SPANS}")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with what is left of their texts, columns as they are; a null text stays null."""
    out = remove_repeats(docs, window)
    left = lambda c: F.when(F.col("had_text"), F.col("kept")).alias(c) if c == "text" else F.col("row")[c].alias(c)
    return out.select(*[left(c) for c in docs.columns])


def repeat_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` as the query wants them."""
    out = remove_repeats(docs.select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
