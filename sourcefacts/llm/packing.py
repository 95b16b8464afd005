"""Packing documents into sequences as a cutting-stock problem.

Only the histogram of piece lengths reaches the driver. A linear program over
packing patterns is solved by column generation: a knapsack dynamic program
prices new patterns with the current duals until none helps. Patterns are
rounded down, the few pieces left over are placed first-fit decreasing, and
ranked pieces take their places by arithmetic on their rank.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import bucket_count, gapless_ranks, materialize, text_column
from .tokens import encoder, vocabulary

CAPACITY = 1024
#: Lengths are rounded up to this for the program, which bounds its rows.
UNIT = 8
#: The program ends when it is proved to be within this of the optimum.
GAP = 2e-3
MAX_COLUMNS = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill ``capacity`` with copies of ``sizes``."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    fitting = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fitting[c]
        if n:
            gain = best[c - s[:n]] + v[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], pick[c] = gain[k], k
    pattern = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractions allowed.

    Revised simplex over an implicit set of columns. The start, each size on
    its own, is feasible and every step keeps it so; ``value`` of the best
    pattern bounds the optimum from below, and so does the volume of all
    pieces, which gives the stop.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = inverse @ demand.astype(float)
    volume = float(sizes @ demand) / capacity
    for _ in range(MAX_COLUMNS):
        duals = inverse.sum(axis=0)
        value, column = best_pattern(duals, sizes, capacity)
        if value <= 1 + gap or used.sum() <= volume * (1 + gap):
            break
        move = inverse @ column
        limits = np.full(m, np.inf)
        up = move > 1e-9
        limits[up] = used[up] / move[up]
        leaves = int(limits.argmin())
        step = limits[leaves]
        used = np.maximum(used - step * move, 0)
        used[leaves] = step
        pivot = inverse[leaves] / move[leaves]
        move[leaves] = 0
        inverse -= np.outer(move, pivot)
        inverse[leaves] = pivot
        patterns[leaves] = column
    return patterns, used


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``size, first rank, ranks, pieces a sequence, first sequence``.

    ``histogram`` counts pieces by size. The plan places every piece once and
    no sequence above ``capacity``; it has at most a few rows for each size.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    if not len(sizes):
        return []
    whole: list[tuple[np.ndarray, int]] = []
    patterns, used = solve_patterns(sizes, left, capacity)
    for pattern, times in zip(patterns, np.floor(used + 1e-6).astype(np.int64), strict=True):
        fits = left[pattern > 0] // pattern[pattern > 0]
        times = min(int(times), int(fits.min())) if len(fits) else 0
        if times:
            whole.append((pattern, times))
            left = left - times * pattern
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        times = max(1, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        whole.append((pattern, times))
        left = left - times * pattern
    rows, taken, sequence = [], np.zeros(len(sizes), dtype=np.int64), 0
    for pattern, times in whole:
        for k in np.flatnonzero(pattern):
            n = int(pattern[k]) * times
            rows.append((int(sizes[k]), int(taken[k]), n, int(pattern[k]), sequence))
            taken[k] += n
        sequence += times
    return rows


def cut_pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them to pieces of at most ``capacity``.

    All pieces of a document but its last are full. A null text is empty and
    still has its end id. With ``keep_ids`` a piece brings its ids along.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end, step = encoder(vocab).encode_all, struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_all(batch.column("text")), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for col, v in zip(cols, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if keep_ids else None), strict=True):
                        col.append(v)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return text_column(docs, id_col, text_col).mapInArrow(pieces, PIECES + ", ids binary" * keep_ids)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of a written piece table.

    Pieces of one size class are ranked by document and place; the ranks of a
    class are dealt over tasks, so a class may hold any share of the rows.
    """
    spark = pieces.sparkSession
    rounded = F.least(F.ceil(F.col("length") / unit) * unit, F.lit(capacity)).cast("long")
    classed = pieces.withColumn("_size", rounded)
    counts = {r["_size"]: r["n"] for r in classed.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    # full pieces need no program; what a class leaves out of the unit is idle room
    full = counts.pop(capacity, 0)
    usable = capacity // unit
    rows = [(s * unit, f, n, k, q + full) for s, f, n, k, q in plan_sequences({s // unit: n for s, n in counts.items()}, usable)]
    rows.append((capacity, 0, full, 1, 0))
    plan = spark.createDataFrame(rows, "_size long, _first long, _n long, _each long, _sequence long")
    order = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in pieces.columns]
    ranked = gapless_ranks(classed.withColumn("_one", F.lit(1).cast("long")), ["_size"], order, "_one", bucket_count(sum(counts.values()) + full), "_rank")
    # the plan has a few rows for each size class, however many pieces there are
    placed = ranked.join(F.broadcast(plan), "_size").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_each")).cast("long"))
    before = W.partitionBy("sequence_id").orderBy("_size", "_rank").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocab: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one place of one sequence.

    One row for each piece: its document, where it starts there, its length
    and checksum, the document's ids, and its sequence and offset there.
    Repeated rows and repeated or null ids are packed like any others; an
    empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, vocab or vocabulary("byte_bpe_50k.json"), end_id, capacity, keep_ids=keep_ids), "pieces")
    return place_pieces(pieces, capacity)


def build_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (little-endian unsigned 32-bit) of packed pieces that kept their ids; at most one capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))


