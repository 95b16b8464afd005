"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a row is one segment of consecutive
documents, with a sorted posting list of word positions for every term in
it. A phrase is found in a segment by taking the posting list of its
rarest term there, moving it by the term's offset, and intersecting it with
the moved lists of the other terms, rarest first. No posting leaves its
segment, so a frequent term costs no shuffle and no task holds more than one
segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import drop_tables, written_tables
from .common import done_with, keep, materialize

#: Words of one segment; a longer document is a segment of its own.
SEGMENT_WORDS = 400_000
#: Bytes of benchmark text that are searched for at once; more go in blocks.
BLOCK_BYTES = 2_000_000
WINDOW = 10
#: The index is stored and read a segment at a time, and texts and segments come to
#: Python a few megabytes at a time, so that a task's memory doesn't hang on its files.
#: A segment's numbers and terms all differ: a dictionary for each would be made in vain.
_STORED = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}
_IN_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: Every byte that is no word byte becomes a space; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

INDEX_SCHEMA = (
    "segment string, doc_ids array<long>, starts array<int>, lengths array<int>, terms array<binary>, offsets array<int>, positions array<int>"
)
MATCH_SCHEMA = "segment string, ordinal int, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class _Segment:
    """Collects documents until a segment is full."""

    docs: list[int | None] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    codes: list[np.ndarray] = field(default_factory=list)
    size: int = 0
    terms: dict[bytes, int] = field(default_factory=dict)

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        terms = self.terms
        codes = [terms.setdefault(w, len(terms)) for w in words]
        self.docs.append(doc_id)
        self.starts.append(self.size)
        self.lengths.append(len(words))
        self.codes.append(np.array([*codes, -1], dtype=np.int32))
        self.size += len(words) + 1  # the gap keeps phrases inside one document

    def row(self) -> tuple:
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        at = np.flatnonzero(codes >= 0).astype(np.int32)
        order = np.argsort(codes[at], kind="stable")
        dealt = codes[at][order]
        first = np.flatnonzero(np.diff(dealt, prepend=-1))
        known, names = dealt[first], list(self.terms)
        return (
            uuid.uuid4().hex, self.docs, self.starts, self.lengths, [names[k] for k in known],
            np.append(first, len(at)).astype(np.int32), at[order],
        )


def _index_batch(row: tuple) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.list_(k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())]]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in INDEX_SCHEMA.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional index of whole texts, one row for each segment.

    Every word of every document has a posting. A null text has no words.
    Rows are kept apart even where ids repeat or are null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing", dict)  # lets go what other operators remembered
        held = _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                if held.docs and held.size + len(words) > segment_words:
                    yield _index_batch(held.row())
                    held = _Segment()
                held.add(doc_id, words)
        if held.docs:
            yield _index_batch(held.row())

    return rows.mapInArrow(segments, INDEX_SCHEMA)


@dataclass
class Phrases:
    """Distinct phrases of a block of items, ready to search for."""

    terms: dict[bytes, int]
    phrases: list[np.ndarray]
    owners: list[list[str]]

    @classmethod
    def windows(cls, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW) -> Phrases:
        """Every run of ``window`` words of an item; a shorter item whole."""
        terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = [terms.setdefault(w, len(terms)) for w in words_of(text)]
            for i in range(max(1, len(codes) - window + 1)) if codes else ():
                found.setdefault(tuple(codes[i : i + window]), set()).add(item)
        return cls(terms, [np.array(p, dtype=np.int32) for p in found], [sorted(v) for v in found.values()])

    def matrix(self) -> np.ndarray:
        """Phrases as rows, padded with the number of terms."""
        wide = np.full((len(self.phrases), max(map(len, self.phrases), default=1)), len(self.terms), dtype=np.int32)
        for i, p in enumerate(self.phrases):
            wide[i, : len(p)] = p
        return wide


class _Postings:
    """The lists of one stored segment, by the terms of a search."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        self.starts = np.array(row["starts"], dtype=np.int64)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.size = int(self.starts[-1] + self.lengths[-1] + 1) if len(self.starts) else 0
        offsets, positions = row["offsets"], row["positions"]
        self._lists = {terms[t]: positions[offsets[i] : offsets[i + 1]] for i, t in enumerate(row["terms"]) if t in terms}
        self.counts = np.zeros(len(terms) + 1, dtype=np.int64)
        for k, v in self._lists.items():
            self.counts[k] = len(v)
        self.counts[-1] = np.iinfo(np.int64).max  # padding is never the rarest

    def of(self, term: int) -> np.ndarray:
        return self._lists[term]

    def phrase(self, phrase: np.ndarray) -> np.ndarray:
        """Positions where the phrase begins."""
        counts = self.counts[phrase]
        order = np.argsort(counts, kind="stable")
        at = self.of(phrase[order[0]]).astype(np.int64) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            other = self.of(phrase[k])
            i = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
            at = at[other[i] == at + k]
        return at

    def near(self, wanted: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the rarest term with all others at most ``slop`` words away in the document; first and last word of each."""
        order = np.argsort(self.counts[wanted], kind="stable")
        at = self.of(wanted[order[0]]).astype(np.int64)
        low, high = at.copy(), at.copy()
        doc = self.doc_of(at)
        alive = np.ones(len(at), dtype=bool)
        for k in order[1:]:
            other = self.of(wanted[k])
            right = np.searchsorted(other, at)
            best = np.full(len(at), -1, dtype=np.int64)
            for i in (right - 1, right):
                ok = (i >= 0) & (i < len(other))
                p = other[np.clip(i, 0, len(other) - 1)].astype(np.int64)
                ok &= (np.abs(p - at) <= slop) & (self.doc_of(p) == doc)
                best = np.where(ok & ((best < 0) | (np.abs(p - at) < np.abs(best - at))), p, best)
            alive &= best >= 0
            low, high = np.where(best >= 0, np.minimum(low, best), low), np.where(best >= 0, np.maximum(high, best), high)
        return low[alive], high[alive] + 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        # an empty document starts where no word can be, so the last start counts
        return np.searchsorted(self.starts, positions, side="right") - 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield {
                "segment": row["segment"].as_py(), "doc_ids": row["doc_ids"].as_py(), "terms": row["terms"].as_py(),
                **{k: row[k].values.to_numpy(zero_copy_only=False) for k in ("starts", "lengths", "offsets", "positions")},
            }


def _matches(row: dict, postings: _Postings, hits: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> pa.RecordBatch:
    """One row for each document of the segment; overlapping spans are merged."""
    edge = np.zeros(postings.size + 1, dtype=np.int32)
    items: dict[int, set[str]] = {}
    for low, high, owners in hits:
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        for d in np.unique(postings.doc_of(low)):
            items.setdefault(int(d), set()).update(owners)
    hit = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans: dict[int, list[dict]] = {}
    for low, high in zip(turn[::2], turn[1::2], strict=True):
        d = int(postings.doc_of(np.array([low]))[0])
        spans.setdefault(d, []).append({"start": int(low - postings.starts[d]), "end": int(high - postings.starts[d])})
    n = len(row["doc_ids"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["segment"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(postings.lengths, pa.int64()),
            pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
        ],
        names=["segment", "ordinal", "doc_id", "n_words", "spans", "items"],
    )


def phrase_matches(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Every document with the merged word spans and owners of the phrases in it."""

    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        wide = phrases.matrix()
        for row in _rows(batches):
            postings = _Postings(row, phrases.terms)
            hits = []
            for i in np.flatnonzero(postings.counts[wide].min(axis=1) > 0) if len(wide) else ():
                at = postings.phrase(phrases.phrases[i])
                if len(at):
                    hits.append((at, at + len(phrases.phrases[i]), phrases.owners[i]))
            yield _matches(row, postings, hits)

    return index.mapInArrow(search, MATCH_SCHEMA)


def proximity_matches(index: DataFrame, term_sets: dict[str, list[bytes]], slop: int) -> DataFrame:
    """As ``phrase_matches``, for sets of terms that stand near each other.

    A set matches at an occurrence of its rarest term (of the segment) that
    has every other term at most ``slop`` words away in the same document.
    """
    terms = {w: i for i, w in enumerate(sorted({w for ws in term_sets.values() for w in ws}))}
    wanted = {name: np.array(sorted({terms[w] for w in ws}), dtype=np.int32) for name, ws in term_sets.items() if ws}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            postings = _Postings(row, terms)
            hits = []
            for name, codes in wanted.items():
                if postings.counts[codes].min() > 0:
                    low, high = postings.near(codes, slop)
                    hits.append((low, high, [name]))
            yield _matches(row, postings, hits)

    return index.mapInArrow(search, MATCH_SCHEMA)


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark in blocks of bounded size; one block where it is small."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).where("item is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.toLocalIterator()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Word spans of every document that repeat ``window`` words of an item.

    Returns ``doc_id, n_words, spans, items`` for every row of ``docs``:
    spans of word positions, merged, and the ids of the items found. The
    index is written once, searched for one block of the benchmark after
    another and deleted; where there are several, their spans are merged by document. Null texts and empty ones have no words and no spans;
    an item without words or without an id is never found; equal items are
    all reported.
    """
    index = materialize(build_index(docs, id_col, text_col), "postings", _STORED, _IN_BATCHES)
    searches = [phrase_matches(index, Phrases.windows(block, window)) for block in benchmark_blocks(benchmark, block_bytes=block_bytes)]
    found = materialize(reduce(DataFrame.unionByName, searches), "matches", settings=_IN_BATCHES)
    done_with(index)
    return _merge_blocks(found) if len(searches) > 1 else found.select("doc_id", "n_words", "spans", "items")


def _merge_blocks(found: DataFrame) -> DataFrame:
    """Spans of several searches of one table, by text order within its ids."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    return found.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).withColumn("spans", _joined(F.col("_spans"))).select("doc_id", "n_words", "spans", "items")


def _joined(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    return F.aggregate(
        spans, F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest columns of ``find_contamination``; other columns of ``docs`` are not looked at."""
    found = find_contamination(docs, benchmark, window)
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text repeats a window of an item.

    The verdict hangs on the text alone, so rows are matched by a 64-bit hash
    of it; ids may be null or repeat. All columns stay as they are.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    with written_tables() as on_the_way:
        found = find_contamination(docs.select(key.alias("doc_id"), "text"), benchmark, window)
    bad = materialize(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_hash")).distinct(), "contaminated")
    drop_tables(docs.sparkSession, on_the_way)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_hash"))
    return packed.join(bad, "_hash", "left_anti").select("_row.*")
