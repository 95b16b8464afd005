"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each holding the ids of some
whole documents as little-endian unsigned 32-bit integers; then a skippable
frame with the document index; then the published seek table, again a
skippable frame: compressed size, size and checksum of every frame, and a
footer. Any zstandard reader can unpack the whole file to the bare ids; ours
unpacks only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from .common import materialize, shared_dir, text_column
from .tokens import encoder, vocabulary

#: Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: Bytes of ids that close a frame, and bytes of compressed frames that close a file.
FRAME_BYTES = 1 << 18
FILE_BYTES = 1 << 27

_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])


class Corrupt(ValueError):
    """A frame whose bytes don't give its checksum, or a file without a seek table."""


class FrameWriter:
    """Collects documents into frames; ``finish`` gives the bytes after them."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self._out, self._limit = out, frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
        self._open: list[bytes] = []
        self._open_bytes = 0
        self._entries: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, int, int, int, int]] = []
        self.written = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id or 0, doc_id is not None, len(self._entries), self._open_bytes // 4, len(ids) // 4))
        self._open.append(ids)
        self._open_bytes += len(ids)
        self.tokens += len(ids) // 4
        if self._open_bytes >= self._limit:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            raw = b"".join(self._open)
            packed = self._zstd.compress(raw)
            self._out.write(packed)
            self.written += len(packed)
            self._entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._open, self._open_bytes = [], 0

    def finish(self) -> None:
        self._close_frame()
        index = self._zstd.compress(np.array(self._docs, dtype=_DOC).tobytes())
        self._out.write(_HEAD.pack(INDEX_MAGIC, len(index)) + index)
        table = np.array(self._entries, dtype=_ENTRY).tobytes()
        footer = _FOOTER.pack(len(self._entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._out.write(_HEAD.pack(SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)

    @property
    def docs(self) -> int:
        return len(self._docs)


class FrameReader:
    """Reads single documents or frames of one file."""

    def __init__(self, source):
        self._source = source
        end = source.size()
        footer_at = end - _FOOTER.size
        source.seek(max(0, footer_at))
        frames, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise Corrupt("no seek table at the end of the file")
        source.seek(footer_at - frames * _ENTRY.itemsize)
        self.entries = np.frombuffer(source.read(frames * _ENTRY.itemsize), dtype=_ENTRY)
        index_at = int(self.entries["packed"].sum(dtype=np.int64))
        source.seek(index_at)
        index_bytes = _HEAD.unpack(source.read(_HEAD.size))[1]
        self._zstd = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self._zstd.decompress(source.read(index_bytes)), dtype=_DOC)
        self._starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])

    def frame(self, number: int) -> np.ndarray:
        """The ids of one frame, after its checksum held."""
        self._source.seek(int(self._starts[number]))
        entry = self.entries[number]
        raw = self._zstd.decompress(self._source.read(int(entry["packed"])), max_output_size=int(entry["size"]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(entry["checksum"]):
            raise Corrupt(f"frame {number} fails its checksum")
        return np.frombuffer(raw, dtype="<u4")

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the wanted documents in file order; None: of all.

        Frames without a wanted document are not read.
        """
        docs = self.docs if wanted is None else self.docs[np.isin(self.docs["doc_id"], np.fromiter(wanted, dtype=np.int64)) & (self.docs["has_id"] == 1)]
        held, ids = -1, np.zeros(0, "<u4")
        for d in docs:
            if d["frame"] != held:
                held = int(d["frame"])
                ids = self.frame(held)
            yield (int(d["doc_id"]) if d["has_id"] else None), ids[int(d["at"]) : int(d["at"] + d["n"])]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _files_of(batches: Iterator[pa.RecordBatch], folder: str, vocab: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Write one sorted partition; a row for each file.

    A file is written under a name of its own and then moved, so a task that
    runs twice leaves the same files.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    store, root = _open(folder)
    encode_all, end = encoder(vocab).encode_all, struct.pack("<I", end_id)
    made: list[tuple[str, int, int, int]] = []
    writer = out = name = None

    def close() -> None:
        writer.finish()
        out.close()
        final = f"part-{part:06d}-{len(made):04d}.ids.zst"
        store.move(f"{root}/{name}", f"{root}/{final}")
        made.append((final, part, writer.docs, writer.tokens))

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_all(batch.column("text")), strict=True):
            if writer is None:
                name = f"_writing-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{root}/{name}")
                writer = FrameWriter(out)
            writer.add(doc_id, ids + end)
            if writer.written >= FILE_BYTES:
                close()
                writer = None
    if writer is not None:
        close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int64())],
        names=["file", "part", "number", "n_docs", "n_tokens"],
    )


def write_token_files(docs: DataFrame, folder: str, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write files in ascending id order.

    The table is range-partitioned by id (equal ids by text hash, so that one
    id may hold many rows), sorted, and every partition writes its own files
    to ``folder`` on the shared store. Returns the written files: ``file,
    part, number, n_docs, n_tokens, start``; ``start`` is the number of ids in
    all files before. A null text is empty and still has its end id; a null id
    sorts first. An empty table writes no file.
    """
    spark = docs.sparkSession
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows = text_column(docs, id_col, text_col)
    keys = ["doc_id", "_tie"]
    placed = rows.withColumn("_tie", F.xxhash64("text"))
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    made = ranged.sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text").mapInArrow(
        lambda it: _files_of(it, folder, vocab, end_id), "file string, part int, number int, n_docs long, n_tokens long"
    )
    files = materialize(made, "token-files")
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _one_each(files: DataFrame) -> DataFrame:
    """``file, start`` dealt to about as many tasks as there are files; a stated
    number keeps Spark from merging these few small rows into one task."""
    return files.select("file", "start").repartition(max(1, files.count()), "file")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document out of the files: ``doc_id, start, ids``.

    Files are read frame by frame through their seek tables, each by one task.
    """

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                yield from _batches(folder, file, start, None)

    return _one_each(files).mapInArrow(docs_of, "doc_id long, start long, ids binary")


def fetch_documents(folder: str, file: str, wanted: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file; other frames stay packed."""
    store, root = _open(folder)
    with store.open_input_file(f"{root}/{file}") as f:
        return dict(FrameReader(f).read(wanted))


def _batches(folder: str, file: str, start: int, wanted: list[int] | None, batch_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    rows: list[tuple[int | None, int, bytes]] = []
    held = 0

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "start", "ids"])

    with store.open_input_file(f"{root}/{file}") as f:
        for doc_id, ids in FrameReader(f).read(wanted):
            rows.append((doc_id, start, ids.tobytes()))
            start += len(ids)
            held += ids.nbytes
            if held >= batch_bytes:
                yield pack()
                rows, held = [], 0
    if rows:
        yield pack()


def token_digest(spark: SparkSession, docs: DataFrame, vocab_name: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Write all documents, read the files back, and digest what they hold."""
    folder = shared_dir(spark, "token-files")
    files = write_token_files(docs, folder, vocabulary(vocab_name), end_id)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for got in _batches(folder, file, start, None):
                    ids = got.column("ids").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [got.column("doc_id"), got.column("start"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return _one_each(files).mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
