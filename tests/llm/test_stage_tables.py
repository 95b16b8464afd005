"""What a stage of the pipeline leaves on the disk, and what it sends through shuffles."""

import os

import corpus_pipeline as P

from sourcefacts.llm import pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i}" for i in range(60))
LEAK = "seven grey geese went over the cold northern hills before the first frost came down"
ROWS = [(1, BASE, "en", "a", None), (2, BASE + " tail", "en", "a", None), (3, f"{BASE[::-1]} {LEAK}", "en", "b", None), (4, f"{' '.join(f'mail{i}' for i in range(40))} write to ann@example.org", "en", "b", None), (5, None, "en", None, 0), (6, "", "en", None, 0)]


def _tables(spark):
    return {name for name in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) if "-" in name}


def test_a_stage_keeps_only_what_its_result_reads(spark, tmp_path):
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, DOCS)
    left = {P.near_duplicates: {"dropped"}, P.decontaminate: {"contaminated"}, P.personal_data: {"marked-terms"}}
    for stage, names in left.items():
        before = _tables(spark)
        out = stage(spark, docs, str(tmp_path))
        kept = {name.rsplit("-", 1)[0] for name in _tables(spark) - before}
        assert kept == names, stage.__name__
        assert out.count() == {P.near_duplicates: 5, P.decontaminate: 5, P.personal_data: 6}[stage]


def test_the_text_goes_through_the_shuffle_once(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = pii.sanitise(docs, everywhere=True)
    join = out._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    assert join.children().head().schema().catalogString().count("text:") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[5]["text"] is None and got[6]["text"] == "" and got[5]["n_chars"] == got[6]["n_chars"] == 0
    assert got[1]["text"] == BASE and "ann@example.org" not in got[4]["text"] and got[4]["source"] == "b"
