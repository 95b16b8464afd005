"""What tasks hold of the positional index at once."""

import glob
import os

import pyarrow.parquet as pq

from sourcefacts.functions import tables
from sourcefacts.llm import decontamination as D

ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_the_index_is_stored_by_segment_and_deleted(spark, monkeypatch):
    leak = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"{leak} tail{i}" if i % 2 else f"word{i} " * 30) for i in range(12)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", leak)], "item_id string, text string")
    was, seen, whole = spark.conf.get(ARROW), [], D.build_index
    monkeypatch.setattr(D, "build_index", lambda d, i, t: whole(d, i, t, segment_words=20))
    monkeypatch.setattr(D, "done_with", lambda *t: seen.extend(pq.ParquetFile(f.removeprefix("file:")).metadata for x in t for f in x.inputFiles()) or tables.done_with(*t))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(glob.glob(f"{shared}/*"))
    got = {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in D.find_contamination(docs, bench).collect()}
    assert got == {i: (11, [(0, 10)], ["a"]) if i % 2 else (30, [], []) for i in range(12)}
    groups = [m.row_group(k).num_rows for m in seen for k in range(m.num_row_groups)]
    assert groups == [1] * 12
    assert {os.path.basename(p).rsplit("-", 1)[0] for p in set(glob.glob(f"{shared}/*")) - before} == {"matches"}
    assert spark.conf.get(ARROW) == was
