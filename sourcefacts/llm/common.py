"""Small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from ..functions.tables import done_with, materialize, shared_dir  # noqa: F401  (the operators take them from here)

#: The word separators of the quality and similarity contracts.
NON_SPACE_CLASS = r"[^\x20\x09-\x0D]+"


_KEPT: dict[str, object] = {}


def keep(name: str, make):
    """What a Python worker remembers from task to task under this name.

    A worker serves one operator after another; what it remembered for others
    is let go, so memories don't add up.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def _give_back() -> None:
    """Freed memory of this process to the system, as far as the allocators can tell it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # only where the C library has it


def bucket_count(n_rows: int, rows_per_bucket: int = 100_000) -> int:
    """How many buckets keep the rows of one bucket near ``rows_per_bucket``."""
    return max(1, -(-n_rows // rows_per_bucket))


def gapless_ranks(units: DataFrame, groups: list[str], order: list[str], weight: str, buckets: int, name: str) -> DataFrame:
    """Number the rows of every group from 0 without gaps, however large a group is.

    A row stands for ``weight`` equal records and gets the first of as many
    consecutive numbers. A group is dealt to hash buckets of ``order``; the
    buckets are numbered on their own and moved by the totals before them, so
    a hot group is spread over ``buckets`` tasks. ``units`` is read twice and
    should be a written table.
    """
    keys = [*groups, "_bucket"]
    b = units.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        b.groupBy(*keys).agg(F.sum(weight).alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = b.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return ranked.join(bases, keys).withColumn(name, F.col("_base") + F.col("_inside")).drop("_bucket", "_base", "_inside")


def running_totals(numbers: Column, block: int = 512) -> Column:
    """The sums of an array's first elements, one for each element.

    Taken in blocks, whose totals are added up in turn, so that the cost of an
    array of a million numbers stays near its length.
    """
    none = F.array().cast("array<int>")
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(numbers), F.lit(1)) - 1) / block).cast("int")),
        lambda k: F.aggregate(F.slice(numbers, k * block + 1, F.lit(block)), none, add),
    )
    # what stands before each block: the totals of the blocks up to it, less its own
    return F.flatten(F.aggregate(
        blocks, F.struct(F.lit(0).alias("before"), F.array().cast("array<array<int>>").alias("out")),
        lambda acc, b: F.struct(
            (acc["before"] + F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))).alias("before"),
            F.concat(acc["out"], F.array(F.transform(b, lambda x: x + acc["before"]))).alias("out"),
        ),
    )["out"])


def text_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and text columns, as long and string."""
    return df.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.col(text_col).cast(T.StringType()).alias("text"))
