"""Changed source files as a stream that re-plans an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import reindex as I
from ..sources.java_files import describe_files, filter_source_paths

FILES = "repository_id string, relative_path string, content string"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet rows of whole changed files, as they arrive in ``folder``."""
    return spark.readStream.schema(FILES).parquet(folder)


def plan_changes(batch: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Files of one batch that differ from the index, with the files that depend on them.

    A batch only says what files are now; a file that is not in it is unchanged.
    """
    now = describe_files(filter_source_paths(batch))
    before = index["source_files"]
    told = before.join(now.select(*I.FILE), I.FILE, "left_semi")
    changed = I.diff_snapshots(told, now).where("change <> 'UNCHANGED'")
    rest = before.select(*I.FILE).join(changed.select(*I.FILE), I.FILE, "left_anti").selectExpr(*I.FILE, "'UNCHANGED' as change")
    diff = rest.unionByName(changed)
    return I.plan_reindex(diff, I.dependant_files(index["relationships"], index["symbols"], changed))


def watch(spark: SparkSession, folder: str, checkpoint: str, read_index: Callable[[], dict[str, DataFrame]], on_plan: Callable[[DataFrame, DataFrame], None]) -> StreamingQuery:
    """Calls ``on_plan(batch, plan)`` for every batch with a change; the source's
    progress is kept in ``checkpoint``, so each file is planned for once."""

    def each(batch: DataFrame, _: int) -> None:
        plan = plan_changes(batch, read_index())
        if not plan.isEmpty():
            on_plan(batch, plan)

    return file_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
