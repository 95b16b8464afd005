"""Tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A write deletes its shuffle files as it ends; else these stay until the driver happens to collect its garbage.
_CLEAN = {_CLEANED: "true"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings inside; those from before hold again afterwards."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a
    local session may go without; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Write once to the shared folder and go on from the written table.

    Cuts the lineage and lets several later steps read one result; the files
    outlive any executor. ``options`` are of the files, ``settings`` of the
    session while they are written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    with _settings(spark, _CLEAN | (settings or {})):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that goes through a shuffle at every size.

    Files of a written table are much smaller than its rows, most of all when
    nested ones are exploded; by their size Spark takes it for small and
    gathers all its rows in the driver, to broadcast them.
    """
    return df.hint("merge")


def measured(spark: SparkSession) -> dict[str, str]:
    """Settings for a write whose joins are broadcast by what shuffles are found to hold, and not by the size of files."""
    return {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": spark.conf.get("spark.sql.autoBroadcastJoinThreshold")}


def materialize_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``materialize`` of tables that don't need each other, side by side, so that a small one doesn't hold the others up."""
    with ExitStack() as around:
        for spark in {table.sparkSession for table in tables.values()}:
            around.enter_context(_settings(spark, _CLEAN))
        pool = around.enter_context(ThreadPoolExecutor(max(1, len(tables))))
        # each with the caller's list of written tables
        running = {name: pool.submit(copy_context().run, materialize, table, name) for name, table in tables.items()}
        return {name: done.result() for name, done in running.items()}


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The folders of the tables that are materialized inside, for who knows when they are done with."""
    paths: list[str] = []
    before = _WRITTEN.set(paths)
    try:
        yield paths
    finally:
        _WRITTEN.reset(before)
        if (outer := _WRITTEN.get()) is not None:
            outer.extend(paths)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def done_with(*tables: DataFrame) -> None:
    """Delete materialized tables once what was made from them is written."""
    for table in tables:
        spark = table.sparkSession
        base = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/").removeprefix("file:").lstrip("/")
        folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
        drop_tables(spark, [f for f in folders if base and base in f])
