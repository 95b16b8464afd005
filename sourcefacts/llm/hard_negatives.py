"""Hard negatives by blocked matrix products.

Anchors are cut into blocks of a bounded size. A block is broadcast and meets
the rows of every task, one Arrow batch after another, as products of float64
matrices of whole numbers: exact below 2**53. A first pass keeps the best rows
of an anchor's own label, a second one the best rows of other labels in the
window below each of these. A task sends only its best rows, which merge with
those of the others; no pair of rows is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import bucket_count, done_with, gapless_ranks, materialize

#: A component becomes floor(SCALE * x).
SCALE = 256
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative's score is at least this percentage of the positive's, and at most the positive's.
LEAST_PERCENT = 80
#: Bytes of the vectors of one broadcast block of anchors.
BLOCK_BYTES = 16 << 20
#: Scores that a task holds at a time.
SCORES = 1 << 20
EXACT = 1 << 53
_LONG = (-(1 << 63), (1 << 63) - 1)


def taking_part(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, components as whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("_x"))
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    kept = rows.where(F.col("label").isNotNull() & F.col("_x").isNotNull()).where(F.forall("_x", finite))
    return kept.select("vec_id", moved.alias("label"), F.transform("_x", lambda x: F.floor(x * float(SCALE))).alias("vector"))


def _matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros, longer ones are cut at ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = vectors.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    inside = column < width
    out[row[inside], column[inside]] = flat[inside]
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers as int64, exact; beyond 64 bits the nearest long.

    In float64 while every partial sum stays below 2**53, in Python's integers otherwise.
    """
    if a.shape[1] * _largest(a) * _largest(b) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, *_LONG).astype(np.int64)


class Best:
    """The first ``size`` rows of each of ``groups`` groups: higher scores first, then smaller ids, no id last."""

    def __init__(self, groups: int, size: int):
        self.size, self.groups = size, groups
        self.group = np.zeros(0, np.int64)
        self.score, self.id, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: The score that a row must reach to count in its group.
        self.floor = np.full(groups, _LONG[0], dtype=np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        near = score >= self.floor[group]
        if not near.any():
            return
        cols = [np.concatenate([old, new[near]]) for old, new in ((self.group, group), (self.score, score), (self.id, ids), (self.no_id, no_id))]
        # descending by score without turning its sign, as the least long has no opposite
        order = np.lexsort((cols[2], cols[3], ~cols[1], cols[0]))
        cols = [c[order] for c in cols]
        begins = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        self.group, self.score, self.id, self.no_id = (c[place < self.size] for c in cols)
        last = place == self.size - 1
        self.floor[cols[0][last]] = cols[1][last]

    def batch(self, names: tuple[str, str, str]) -> pa.RecordBatch:
        ids = pa.array(self.id, pa.int64(), mask=self.no_id)
        return pa.RecordBatch.from_arrays([pa.array(self.group, pa.int64()), ids, pa.array(self.score, pa.int64())], names=list(names))


def _scored(batch: pa.RecordBatch, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of anchors against the rows of a batch: first anchor, scores by anchor and row, labels, ids, rows without one."""
    ids = batch.column("vec_id")
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    number, label = ids.fill_null(0).to_numpy(), batch.column("label").to_numpy()
    rows = _matrix(batch.column("vector"), anchors.shape[1])
    step = max(1, min(len(rows), SCORES // 256))
    for low in range(0, len(rows), step):
        part = slice(low, low + step)
        many = max(1, SCORES // step)
        for first in range(0, len(anchors), many):
            yield first, inner_products(anchors[first : first + many], rows[part]), label[part], number[part], no_id[part]


def _positives(rows: DataFrame, block: DataFrame) -> DataFrame:
    """The best rows of an anchor's label that each task sees, one more than are wanted, as the anchor is among them."""
    held = block.select("anchor", "label", "vector").orderBy("anchor").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((_matrix(held.column("vector")), held.column("label").to_numpy(), held.column("anchor").to_numpy()))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, label, name = shared.value
        found = Best(len(anchors), POSITIVES + 1)
        for batch in batches:
            for first, scores, labels, ids, no_id in _scored(batch, anchors):
                own = label[first : first + len(scores), None] == labels[None, :]
                a, r = np.nonzero(own & (scores >= found.floor[first : first + len(scores), None]))
                found.add(a + first, scores[a, r], ids[r], no_id[r])
        found.group = name[found.group]
        yield found.batch(("anchor", "positive_id", "positive_score"))

    return rows.mapInArrow(best, "anchor long, positive_id long, positive_score long")


def _negatives(rows: DataFrame, block: DataFrame, positives: DataFrame) -> DataFrame:
    """The best rows of other labels in the window of each positive that each task sees."""
    held = block.select("anchor", "label", "vector").join(positives, "anchor").orderBy("anchor", "place").toArrow()
    names = held.column("anchor").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    # anchors once, and each one's positives as columns; a place that is not taken wants nothing
    wanted = np.full((len(begins), POSITIVES), _LONG[0], dtype=np.int64)
    owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(names))))
    place = held.column("place").to_numpy().astype(np.int64)
    wanted[owner, place - 1] = held.column("positive_score").to_numpy()
    vectors = _matrix(held.column("vector"))[begins]
    shared = rows.sparkSession.sparkContext.broadcast((vectors, held.column("label").to_numpy()[begins], names[begins], wanted))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, label, name, most = shared.value
        # a positive below 0 has no window; of one at 0 or above, the least score in it without overflow
        least = np.where(most < 0, _LONG[1], most - (100 - LEAST_PERCENT) * (most // 100) - (100 - LEAST_PERCENT) * (most % 100) // 100)
        found = Best(len(anchors) * POSITIVES, NEGATIVES)
        for batch in batches:
            for first, scores, labels, ids, no_id in _scored(batch, anchors):
                part = slice(first, first + len(scores))
                a, r = np.nonzero((label[part, None] != labels[None, :]) & (scores >= least[part].min(axis=1, initial=_LONG[1])[:, None]) & (scores <= most[part].max(axis=1, initial=-1)[:, None]))
                s = scores[a, r]
                for k in range(POSITIVES):
                    inside = (s >= least[part][a, k]) & (s <= most[part][a, k])
                    found.add((a[inside] + first) * POSITIVES + k, s[inside], ids[r[inside]], no_id[r[inside]])
        group = found.group
        found.group = name[group // POSITIVES]
        out = found.batch(("anchor", "negative_id", "negative_score"))
        yield out.append_column("place", pa.array(group % POSITIVES + 1, pa.int32()))

    return rows.mapInArrow(best, "anchor long, negative_id long, negative_score long, place int")


def _first(rows: DataFrame, groups: list[str], score: str, name: str, most: int) -> DataFrame:
    order = [F.desc(score), F.asc_nulls_last(name)]
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("_rank") <= most)


def _without_self(found: DataFrame, block: DataFrame) -> DataFrame:
    """Of the best rows of an anchor's label the anchor itself goes; ``place`` numbers those that stay.

    A row that has the anchor's id and its score with itself can't be told
    from it in the result, so whichever of them goes, the rest is the same.
    """
    own = block.select("anchor", "vec_id", "own_score")
    told = found.join(own, "anchor")
    is_self = F.col("positive_id").eqNullSafe(F.col("vec_id")) & (F.col("positive_score") == F.col("own_score"))
    at = W.partitionBy("anchor").orderBy("_rank")
    self_at = F.min(F.when(is_self, F.col("_rank"))).over(W.partitionBy("anchor"))
    others = told.withColumn("_self", self_at).where(F.col("_self").isNull() | (F.col("_rank") != F.col("_self")))
    return others.withColumn("place", F.row_number().over(at)).where(F.col("place") <= POSITIVES).select("anchor", "place", "positive_id", "positive_score")


def _own_score(vector: Column) -> Column:
    square = lambda x: x.cast("decimal(19,0)") * x.cast("decimal(19,0)")
    exact = F.aggregate(vector, F.lit(0).cast("decimal(38,0)"), lambda acc, x: F.try_add(acc, square(x)).cast("decimal(38,0)"))
    most = F.lit(_LONG[1]).cast("decimal(38,0)")
    return F.least(F.coalesce(exact, most), most).cast("long")


def hard_negatives(embeddings: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose ``vec_id`` is divisible by 100. Equal anchor rows
    are searched for once and answer once each. Rows without an id take part
    as positives and negatives, after all others of their score. Rows of a
    null label, a null vector or a component that is null or not finite take
    no part; an empty vector does, with score 0. Where vectors differ in
    length, missing components count as 0. Repeated ids are separate rows.
    Scores beyond 64 bits become the nearest long. Further columns are not
    looked at. An empty table, or one without anchors, gives no rows.

    One block of anchors, ``block_bytes`` of vectors, is in the driver and in
    a task at a time, and every block reads the rows twice: the work is that
    of all anchors against all rows, and memory does not grow with either.
    """
    rows = materialize(taking_part(embeddings), "vectors")
    same = ["vec_id", "label", "vector"]
    units = materialize(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).groupBy(*same).agg(F.count("*").alias("_copies")), "anchors")
    counts = units.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not counts[0]:
        return rows.limit(0).select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("vec_id").alias("positive_score"), F.col("vec_id").alias("negative_score"))
    per_block = max(1, block_bytes // (8 * max(1, counts[1])))
    numbered = gapless_ranks(units.withColumn("_one", F.lit(1)), [], same, "_one", bucket_count(counts[0]), "anchor")
    anchors = materialize(numbered.withColumn("block", F.floor(F.col("anchor") / per_block)).withColumn("own_score", _own_score(F.col("vector"))).drop("_one"), "numbered")
    done_with(units)
    out = []
    for k in range(-(-counts[0] // per_block)):
        block = anchors.where(F.col("block") == k)
        best = _first(_positives(rows, block), ["anchor"], "positive_score", "positive_id", POSITIVES + 1)
        positives = materialize(_without_self(best, block), "positives")
        found = _first(_negatives(rows, block, positives), ["anchor", "place"], "negative_score", "negative_id", NEGATIVES)
        told = found.join(positives, ["anchor", "place"]).join(block.select("anchor", "vec_id", "_copies"), "anchor")
        out.append(materialize(told.select(
            F.col("vec_id").alias("anchor_id"), "positive_id", F.col("_rank").alias("rank"), "negative_id", "positive_score", "negative_score", "_copies",
        ), "negatives"))
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies")
