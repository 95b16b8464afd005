"""The stored index: writers that die, writers at once, merges of changed files, and what is deleted."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sourcefacts.sources import index_store as X

FACTS = "repository_id long, relative_path string, n int"


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def many(spark, repository, files, n=0):
    return spark.range(files).select(F.lit(repository).cast("long").alias("repository_id"), F.concat(F.lit("p/F"), F.col("id").cast("string"), F.lit(".java")).alias("relative_path"), F.lit(n).alias("n"))


def held(spark, path, version=None, name="facts"):
    return sorted(tuple(r) for r in X.read_index(spark, path, [name], version)[name].collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "index")


def test_a_killed_writer_blocks_nobody(spark, path):
    X.write_index({"facts": facts(spark, [(1, "a", 1)])}, path)
    for folder in ("versions/1/_temporary/0", "versions/0/_temporary", "tables/facts/_run=dead/_repository=1/_temporary", "log"):
        (Path(path) / folder).mkdir(parents=True, exist_ok=True)
    (Path(path) / "log/.draft").write_text("{")
    many(spark, 1, 3, 9).withColumn("_run", F.lit("dead")).withColumn("_repository", F.lit("1")).write.partitionBy("_run", "_repository").mode("append").parquet(f"{path}/tables/facts")
    assert held(spark, path) == [(1, "a", 1)]
    assert X.write_index({"facts": facts(spark, [(2, "b", 2)])}, path) == 1
    assert held(spark, path) == [(1, "a", 1), (2, "b", 2)]


@pytest.mark.parametrize("at", ["_write_run", "_claim"])
def test_a_writer_that_fails_changes_nothing(spark, path, monkeypatch, at):
    X.write_index({"facts": facts(spark, [(1, "a", 1)])}, path)

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(X, at, die)
        with pytest.raises(OSError, match="killed"):
            X.write_index({"facts": facts(spark, [(1, "a", 2)])}, path)
    assert held(spark, path) == [(1, "a", 1)]
    assert X.write_index({"facts": facts(spark, [(1, "a", 3)])}, path) == 1
    assert held(spark, path) == [(1, "a", 3)]


def test_writers_at_once_lose_nothing(spark, path):
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: X.write_index({"facts": facts(spark, [(i, "a", i)]), "more": facts(spark, [(i, "b", -i)])}, path), range(4)))
    assert sorted(numbers) == [0, 1, 2, 3] == X.index_versions(spark, path)
    assert held(spark, path) == [(i, "a", i) for i in range(4)]
    assert held(spark, path, name="more") == [(i, "b", -i) for i in range(4)]


def test_the_second_of_two_is_put_on_top(spark, path, monkeypatch):
    X.write_index({"facts": facts(spark, [(1, "a", 1)])}, path)
    real, other = X._claim, []

    def late(spark, path, number, entry):
        if not other:
            other.append(number)
            X.write_index({"facts": facts(spark, [(2, "b", 2)])}, path)
        return real(spark, path, number, entry)

    monkeypatch.setattr(X, "_claim", late)
    assert X.write_index({"facts": facts(spark, [(3, "c", 3)])}, path) == 2
    assert held(spark, path) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]


def test_facts_of_an_old_version_are_refused(spark, path):
    first = X.write_index({"facts": facts(spark, [(1, "a", 1), (2, "a", 1)])}, path)
    X.write_index({"facts": facts(spark, [(2, "a", 2)])}, path)
    assert X.write_index({"facts": facts(spark, [(1, "a", 5)])}, path, based_on=first) == 2
    with pytest.raises(X.IndexConflict):
        X.write_index({"facts": facts(spark, [(2, "a", 9)])}, path, based_on=first)
    with pytest.raises(X.IndexConflict):
        X.merge_files(spark, path, {"facts": facts(spark, [(2, "a", 9)])}, facts(spark, [(2, "a", 0)]), first)
    assert held(spark, path) == [(1, "a", 5), (2, "a", 2)]


def test_hadoop_rename_never_replaces(spark, tmp_path):
    class Elsewhere:
        """A store whose scheme is not that of local files."""

        def __init__(self, real):
            self.real = real

        def getScheme(self):
            return "store"

        def __getattr__(self, name):
            return getattr(self.real, name)

    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("new"), b.write_text("old")
    store = Elsewhere(X._files(spark, f"file://{tmp_path}"))
    assert not X._rename_to_new(spark, store, X._path(spark, f"file://{a}"), X._path(spark, f"file://{b}"))
    assert b.read_text() == "old"
    assert X._rename_to_new(spark, store, X._path(spark, f"file://{a}"), X._path(spark, f"file://{tmp_path}/c"))
    assert (tmp_path / "c").read_text() == "new"


def size(path, run):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet") if f"_run={run}" in str(f))


def test_a_merge_writes_little(spark, path):
    base = X.write_index({"facts": many(spark, 1, 10_000).unionByName(many(spark, 2, 50)), "names": many(spark, 1, 10_000, 7)}, path)
    old = X._entry(spark, path, base)["run"]
    affected = facts(spark, [(1, "p/F77.java", 0), (1, "p/new.java", 0)]).limit(2)
    version = X.merge_files(spark, path, {"facts": facts(spark, [(1, "p/F77.java", 99), (1, "p/new.java", 1)])}, affected.where("n = 0"), base)
    now = {r[:2]: r[2] for r in held(spark, path)}
    assert len(now) == 10_051 and now[1, "p/F77.java"] == 99 and now[1, "p/new.java"] == 1 and now[2, "p/F7.java"] == 0
    assert (1, "p/F77.java", 7) not in held(spark, path, name="names") and len(held(spark, path, name="names")) == 9_999
    fresh = X._entry(spark, path, version)["run"]
    rewritten = spark.read.parquet(f"{path}/tables/facts/_run={fresh}").count()
    assert rewritten <= 100, "under one percent of 10,050 rows"
    assert size(path, fresh) < size(path, old)
    # what was is still there for those who read it, until it is deleted
    assert len(held(spark, path, base)) == 10_050


def test_merges_again_and_again_then_compacted(spark, path):
    files = 200
    number = X.write_index({"facts": many(spark, 1, files), "whole": spark.createDataFrame([(1, "x")], "repository_id long, what string")}, path)
    want = {f"p/F{i}.java": 0 for i in range(files)}
    for i in range(5):
        changed = [f"p/F{k}.java" for k in range(i, files, 67)]
        deleted = f"p/F{100 + i}.java"
        affected = facts(spark, [(1, p, 0) for p in [*changed, deleted]])
        number = X.merge_files(spark, path, {"facts": facts(spark, [(1, p, i + 1) for p in changed])}, affected, number)
        want |= dict.fromkeys(changed, i + 1)
        want.pop(deleted)
    assert {r[1]: r[2] for r in held(spark, path)} == want
    assert held(spark, path, name="whole") == [(1, "x")]
    assert X.compact_index(spark, path, most_runs=10) == number
    compacted = X.compact_index(spark, path, most_runs=1)
    assert compacted == number + 1 and {r[1]: r[2] for r in held(spark, path)} == want
    assert held(spark, path, name="whole") == [(1, "x")]
    gone = X.vacuum_index(spark, path, grace=0)
    assert gone["entries"] == compacted and gone["runs"] >= 6
    assert {r[1]: r[2] for r in held(spark, path)} == want


def test_only_known_repositories_are_merged(spark, path):
    base = X.write_index({"facts": facts(spark, [(1, "a", 1)])}, path)
    with pytest.raises(ValueError, match="not in the index"):
        X.merge_files(spark, path, {}, facts(spark, [(5, "a", 1)]), base)


def test_vacuum_leaves_what_counts_and_who_may_be_at_work(spark, path):
    for n in range(3):
        X.write_index({"facts": facts(spark, [(1, "a", n)] + [(2, "b", n)] * (n == 0))}, path)
    dead = Path(path) / "tables/facts/_run=dead"
    dead.mkdir()
    assert X.vacuum_index(spark, path) == {"entries": 2, "versions": 0, "runs": 0} and dead.exists()
    assert held(spark, path) == [(1, "a", 2), (2, "b", 0)]
    assert X.vacuum_index(spark, path, grace=0) == {"entries": 0, "versions": 2, "runs": 2} and not dead.exists()
    assert held(spark, path) == [(1, "a", 2), (2, "b", 0)]
    assert X.vacuum_index(spark, path, grace=0) == {"entries": 0, "versions": 0, "runs": 0}


def test_a_repository_that_is_emptied(spark, path):
    X.write_index({"facts": facts(spark, [(1, "a", 1), (2, "b", 2)])}, path)
    X.write_index({"facts": facts(spark, [])}, path, spark.createDataFrame([(1,)], "repository_id long"))
    assert held(spark, path) == [(2, "b", 2)]
    X.write_index({"facts": facts(spark, [])}, path, spark.createDataFrame([(2,)], "repository_id long"))
    assert held(spark, path) == []


def test_drift_is_found_by_digests(spark):
    import random

    from sourcefacts.operators import reindex as I

    rng = random.Random(6)
    before = {(r, f"{rng.choice(['a', 'a/b', 'a/b/c', 'd'])}/F{i}.java"): rng.choice(["h1", "h2", None]) for i in range(200) for r in (rng.randrange(4),)} | {(9, "Top.java"): "h"}
    after = {k: v for k, v in before.items() if k[0] == 0 or rng.random() > 0.05}
    after |= {k: "h3" for k in list(after) if k[0] and rng.random() < 0.05} | {(7, "new/N.java"): "h1", (1, "a/Z.java"): None}
    table = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], "repository_id int, relative_path string, content_hash string")
    a, b = table(before), table(after)
    want = sorted(map(tuple, I.diff_snapshots(a.fillna("none"), b.fillna("none")).where("change <> 'UNCHANGED'").select("repository_id", "relative_path").collect()))
    assert want
    # a null hash is no change by itself in the diff, so those that were null are compared as text
    got = I.snapshot_drift(a.fillna("none"), b.fillna("none"))
    assert sorted((r["repository_id"], r["relative_path"]) for r in got.collect()) == want
    assert I.snapshot_drift(a, a).isEmpty() and I.snapshot_drift(a.limit(0), a.limit(0)).isEmpty()
    assert {r[0] for r in I._unequal(a.fillna("none"), b.fillna("none"), "repository_id").collect()} == {r for r, _ in want}, "equal repositories are not looked into"
