"""A stored index: runs of facts, versions that say which of them count, and a log that orders the versions.

    tables/<name>/_run=<run>/_repository=<id>/   facts, never changed once written
    versions/<id>/                               what counts: a row for each repository and run
    log/<number>.json                            names a version; made at once, or not at all

A writer first writes its facts and a version, both under names of its own,
and then claims the next number of the log. A writer that is killed leaves
folders that no log entry names. Of two that want one number the second puts
its version on top of the first one's and tries again. Readers follow the
last entry, so all tables of a repository change at once.

Inside a repository files fall into buckets by a hash of their paths, so that
``merge_files`` rewrites the buckets of changed files and nothing else.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.tables import materialize

#: Files of a repository that share a bucket, at most about so many.
BUCKET_FILES = 32
#: How often a writer tries to be the next one.
TRIES = 50
#: Runs of a repository from which ``compact_index`` makes one.
MOST_RUNS = 8
#: Seconds that a folder no version names is left for the writer that may still be at work.
GRACE = 24 * 3600
FILE = ["repository_id", "relative_path"]
#: ``live``: the buckets of the repository that count in this run; null when all do.
VERSION = "repository_id string, run string, buckets int, live array<int>"


class IndexConflict(RuntimeError):
    """Another writer changed a repository since the version that this one's facts were made from."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing when it isn't there."""
    store, folder = _files(spark, path), _path(spark, path)
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def index_versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the log, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/log") if n.endswith(".json") and n[0].isdigit())


def _entry(spark: SparkSession, path: str, number: int) -> dict:
    stream = _files(spark, path).open(_path(spark, f"{path}/log/{number:020}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    """Makes the log entry of this number, whole, unless there is one."""
    store = _files(spark, path)
    draft, target = (_path(spark, f"{path}/log/{name}") for name in (f".{uuid.uuid4().hex}", f"{number:020}.json"))
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        return _rename_to_new(spark, store, draft, target)
    finally:
        store.delete(draft, False)


def _rename_to_new(spark: SparkSession, store, draft, target) -> bool:
    """A rename that never replaces a file.

    Hadoop's local file system looks first and renames then, so there a hard
    link is made, which the system makes at once. A store of objects must
    have a rename that fails when the target is there; HDFS has.
    """
    if store.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isAbsolute() and draft.toUri().getScheme() else store.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
        return True
    except Exception as problem:  # Py4J wraps what Java throws
        if "FileAlreadyExists" in str(problem):
            return False
        raise


def _version(spark: SparkSession, path: str, entry: dict | None) -> DataFrame:
    if entry is None:
        return spark.createDataFrame([], VERSION)
    return spark.read.schema(VERSION).parquet(f"{path}/{entry['table']}")


def bucket_of(relative_path: Column, buckets: Column) -> Column:
    """The bucket of a file in a repository of so many."""
    return F.pmod(F.xxhash64(relative_path), buckets.cast("long")).cast("int")


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _write_run(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """Each table into a folder of this run, as writers that share one clear away what others still write."""
    for name, table in tables.items():
        # one folder a repository; a large one is written by several tasks
        dealt = table.withColumn("_repository", F.col("repository_id").cast("string")).hint("rebalance", "_repository")
        dealt.write.partitionBy("_repository").parquet(f"{path}/tables/{name}/_run={run}")


def _commit(spark: SparkSession, path: str, fresh: DataFrame, schemas: dict[str, str], run: str, based_on: int | None) -> int:
    """Puts ``fresh`` rows of a version on top of the last one and makes that the next, however many others do so.

    A row of ``fresh`` without ``live`` replaces its repository; one with
    buckets takes these from the runs that held them.
    """
    for _ in range(TRIES):
        versions = index_versions(spark, path)
        last = versions[-1] if versions else -1
        entry = _entry(spark, path, last) if versions else None
        old = _version(spark, path, entry)
        if based_on is not None and last > based_on:
            _require_same(spark, path, based_on, old, fresh)
        taken = fresh.select("repository_id", F.col("live").alias("_taken"), F.lit(True).alias("_new"))
        left = old.join(taken, "repository_id", "left")
        every = F.sequence(F.lit(0), F.col("buckets") - 1)
        remaining = F.when(F.col("_new").isNull(), F.col("live")).otherwise(F.array_except(F.coalesce("live", every), F.coalesce("_taken", every)))
        kept = left.withColumn("live", remaining).where(F.col("live").isNull() | (F.size("live") > 0)).select(*old.columns)
        table = f"versions/{uuid.uuid4().hex}"
        kept.unionByName(fresh).coalesce(8).write.parquet(f"{path}/{table}")
        known = (entry or {}).get("schemas", {}) | schemas
        if _claim_made(spark, path, last + 1, {"table": table, "run": run, "schemas": known, "at": int(time.time() * 1000)}):
            return last + 1
    raise IndexConflict(f"{TRIES} other writers were faster in {path}")


def _claim_made(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    _files(spark, path).mkdirs(_path(spark, f"{path}/log"))
    return _claim(spark, path, number, entry)


def _require_same(spark: SparkSession, path: str, based_on: int, now: DataFrame, fresh: DataFrame) -> None:
    """The repositories of ``fresh`` are in the same runs as they were."""
    then = _version(spark, path, _entry(spark, path, based_on) if based_on >= 0 else None)
    ours = lambda v: v.join(fresh.select("repository_id"), "repository_id", "left_semi").select("repository_id", "run", F.coalesce(F.array_sort("live"), F.array(F.lit(-1))).alias("live"))
    changed = ours(now).exceptAll(ours(then)).unionByName(ours(then).exceptAll(ours(now))).first()
    if changed is not None:
        raise IndexConflict(f"repository {changed['repository_id']} changed since version {based_on}")


def write_index(tables: dict[str, DataFrame], path: str, repositories: DataFrame | None = None, based_on: int | None = None) -> int:
    """Replaces all facts of the repositories that come, in all tables at once; others stay. The new version's number.

    ``repositories`` (repository_id) names those that are replaced, when the
    tables may not show one because it has no facts left. With ``based_on``
    the write fails with ``IndexConflict`` when one of them has changed since
    that version; without it the last writer of a repository wins.
    """
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    _write_run(tables, path, run)
    with_paths = [t for t in tables.values() if "relative_path" in t.columns]
    ids = [t.select(_text("repository_id"), F.lit(None).cast("string").alias("relative_path")) for t in [*tables.values(), *([] if repositories is None else [repositories])]]
    paths = [t.select(_text("repository_id"), _text("relative_path")) for t in with_paths]
    sizes = reduce(DataFrame.unionByName, [*ids, *paths]).distinct().groupBy("repository_id").agg(F.count("relative_path").alias("_files"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_files") / BUCKET_FILES)).cast("int")
    fresh = materialize(sizes.select("repository_id", F.lit(run).alias("run"), buckets.alias("buckets"), F.lit(None).cast("array<int>").alias("live")), "fresh")
    return _commit(spark, path, fresh, {name: table.schema.json() for name, table in tables.items()}, run, based_on)


def read_index(spark: SparkSession, path: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last version, or of another one that is still kept.

    Only the runs that count are listed; of these a table takes the rows whose
    bucket counts in their run.
    """
    versions = index_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no finished index in {path}")
    entry = _entry(spark, path, versions[-1] if version is None else version)
    live = _version(spark, path, entry)
    runs = {r["run"] for r in live.select("run").distinct().collect()}  # one for each write whose facts still count
    return {name: _table(spark, path, name, T.StructType.fromJson(json.loads(entry["schemas"][name])), live, runs) for name in names}


def _table(spark: SparkSession, path: str, name: str, schema: T.StructType, live: DataFrame, runs: set[str]) -> DataFrame:
    root = f"{path}/tables/{name}"
    held = [f"{root}/{n}" for n in _names(spark, root) if n.removeprefix("_run=") in runs]
    stored = T.StructType([*schema.fields, T.StructField("_run", T.StringType()), T.StructField("_repository", T.StringType())])
    if not held:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(stored).option("basePath", root).parquet(*held)
    told = live.select(F.col("repository_id").alias("_repository"), F.col("run").alias("_run"), F.col("buckets").alias("_buckets"), F.col("live").alias("_live"))
    joined = table.join(told, ["_run", "_repository"])
    # facts of no file are in the first bucket
    bucket = bucket_of(F.col("relative_path"), F.col("_buckets")) if "relative_path" in schema.names else F.lit(0)
    counts = F.col("_live").isNull() | F.array_contains("_live", F.coalesce(bucket, F.lit(0)))
    return joined.where(counts).select(*[F.col(f"`{c}`") for c in schema.names])


def merge_files(spark: SparkSession, path: str, fresh: dict[str, DataFrame], affected: DataFrame, based_on: int) -> int:
    """Replaces the facts of the affected files; only their buckets are written again. The new version's number.

    ``fresh``: tables with facts of affected files that still are.
    ``affected`` (repository_id, relative_path): the files that are read again
    or forgotten, and with them those with edges into theirs, as
    ``plan_reindex`` lists them. Tables that are not in ``fresh`` lose the
    affected files' facts. ``based_on`` is the version that both were made
    from. A repository that is not in the index yet can't be merged into it.
    """
    entry = _entry(spark, path, based_on)
    names = sorted(entry["schemas"])
    sizes = _version(spark, path, entry).groupBy("repository_id").agg(F.max("buckets").alias("buckets"))
    gone = materialize(affected.select(*map(_text, FILE)).distinct(), "affected")
    if (unknown := gone.join(sizes, "repository_id", "left_anti").first()) is not None:
        raise ValueError(f"repository {unknown['repository_id']} is not in the index: write it with write_index")
    touched = gone.join(sizes, "repository_id").groupBy("repository_id", "buckets").agg(F.array_sort(F.collect_set(bucket_of(F.col("relative_path"), F.col("buckets")))).alias("live"))
    touched = materialize(touched, "touched")  # at most all buckets of a repository in a row
    before, out = read_index(spark, path, names, based_on), {}
    marks = touched.select(F.col("repository_id").alias("_r"), F.col("buckets").alias("_b"), F.col("live").alias("_l"))
    files = gone.select(F.col("repository_id").alias("_g"), F.col("relative_path").alias("_p"))
    for name in names:
        table = before[name]
        if "relative_path" not in table.columns:
            if name in fresh:
                raise ValueError(f"{name} has no relative_path: its facts are not those of files")
            bucket = F.lit(0)
        else:
            bucket = F.coalesce(bucket_of(F.col("relative_path"), F.col("_b")), F.lit(0))
        inside = table.join(marks, F.col("repository_id").cast("string") == F.col("_r")).where(F.array_contains("_l", bucket)).select(*table.columns)
        if "relative_path" in table.columns:
            inside = inside.join(files, (F.col("repository_id").cast("string") == F.col("_g")) & (F.col("relative_path") == F.col("_p")), "left_anti")
        out[name] = inside.unionByName(fresh[name].select(*table.columns)) if name in fresh else inside
    run = uuid.uuid4().hex
    _write_run(out, path, run)
    return _commit(spark, path, touched.select("repository_id", F.lit(run).alias("run"), "buckets", "live"), {n: entry["schemas"][n] for n in names}, run, based_on)


def compact_index(spark: SparkSession, path: str, most_runs: int = MOST_RUNS) -> int:
    """Repositories in more than ``most_runs`` runs are written anew as one. The last version's number."""
    number = index_versions(spark, path)[-1]
    entry = _entry(spark, path, number)
    many = _version(spark, path, entry).groupBy("repository_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most_runs).select("repository_id")
    many = materialize(many, "many")
    if many.isEmpty():
        return number
    tables = read_index(spark, path, sorted(entry["schemas"]), number)
    named = many.select(F.col("repository_id").alias("_m"))
    again = {n: t.join(named, F.col("repository_id").cast("string") == F.col("_m"), "left_semi") for n, t in tables.items()}
    return write_index(again, path, many, based_on=number)


def vacuum_index(spark: SparkSession, path: str, keep_versions: int = 1, grace: float = GRACE) -> dict[str, int]:
    """Deletes log entries before the last ``keep_versions``, and versions and runs that no entry left names.

    A folder younger than ``grace`` seconds may belong to a writer that has
    not finished and stays. How many of each kind went comes back.
    """
    store, now = _files(spark, path), time.time() * 1000
    versions = index_versions(spark, path)
    kept = versions[-max(1, keep_versions) :]
    entries = [_entry(spark, path, n) for n in kept]
    runs = {r["run"] for e in entries for r in _version(spark, path, e).select("run").distinct().collect()}
    tables = {e["table"].removeprefix("versions/") for e in entries}
    gone = {"entries": 0, "versions": 0, "runs": 0}

    def drop(kind: str, name: str, wanted: bool, wait: bool = True) -> None:
        folder = _path(spark, name)
        if wanted or (wait and now - store.getFileStatus(folder).getModificationTime() < grace * 1000):
            return
        store.delete(folder, True)
        gone[kind] += 1

    for number in versions[: -len(kept)] if kept else []:
        drop("entries", f"{path}/log/{number:020}.json", False, wait=False)
    for name in _names(spark, f"{path}/versions"):
        drop("versions", f"{path}/versions/{name}", name in tables)
    for table in _names(spark, f"{path}/tables"):
        for name in _names(spark, f"{path}/tables/{table}"):
            if name.startswith("_run="):
                drop("runs", f"{path}/tables/{table}/{name}", name.removeprefix("_run=") in runs)
    return gone
