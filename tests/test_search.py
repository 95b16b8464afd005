"""Search texts of every kind against a plain comparison of all facts, stored postings, and excerpts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sourcefacts.operators import search as S
from sourcefacts.sources import index_store as X

ODD = [
    "src\\main", "main\\", "\\", "\\\\", "a\\\\b", "100\\%", "\\_init", "x\\%", "%", "__", "%_%", "_a%", "fi", "a", "", "  ", " FIND ", "find(", "(int", "ünï", "日本", "no such text", "java", ".j", "%find%id",
    "f_nd", "\\f\\i", "a%\\\\", "g\\%", "\\\\\\", "\\\\\\m",
]


def pattern(needle):
    """The needle as a regular expression, as SQL's LIKE reads it."""
    out, i, text = [], 0, f"%{needle}%"
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
            out.append(re.escape(text[i]) if i < len(text) else re.escape(c))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return re.compile("".join(out), re.DOTALL)


def holds(needle, texts):
    return any(pattern(needle).fullmatch((t or "").lower()) for t in texts)


def asked(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


NAMES = ["find", "findById", "save_all", "x%", "ünïcode", "日本語", "a\\b", "main", "g%", "init"]


def symbols(spark, seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(NAMES)
        kind = rng.choice(["METHOD", "METHOD", "CONSTRUCTOR", "CLASS"])
        rows.append((rng.randrange(3), f"id{i}", kind, name, f"app.{rng.choice(NAMES)}.{name}", rng.choice([None, "()", "(int)", "(a_b,100%)"]), f"src\\main/F{i % 9}.java" if i % 4 else f"src/main/java/F{i % 7}.java", i % 5))
    return rows, spark.createDataFrame(rows, "repository_id int, id string, kind string, simple_name string, qualified_name string, signature string, relative_path string, start_line int")


def callables_by_hand(rows, texts):
    out = []
    for q in dict.fromkeys(texts):
        needle = q.strip(" ").lower()
        if len(needle) < 2:
            continue
        found = [r for r in rows if r[2] != "CLASS" and holds(needle, (r[3] + (r[5] or ""), r[4], r[6]))]
        found.sort(key=lambda r: (r[3].lower() != needle, r[4].encode(), r[7], r[1].encode()))
        out += [(q, i + 1, r[1]) for i, r in enumerate(found[:20])]
    return sorted(out)


def callables(spark, texts, table, postings=None):
    return sorted((r["query"], r["place"], r["id"]) for r in S.search_callables(asked(spark, texts), table, postings).collect())


@pytest.mark.parametrize("seed", range(2))
def test_callables(spark, seed):
    rows, table = symbols(spark, seed)
    texts = ODD + random.Random(seed).sample(NAMES, 4)
    want = callables_by_hand(rows, texts)
    assert len({q for q, *_ in want}) > 15
    assert callables(spark, texts, table) == want


def test_one_odd_text_does_not_stop_the_others(spark):
    files = spark.createDataFrame([(1, "src/main/A.java", "p", "m", "MAIN"), (1, "w\\x%", None, "", "TEST")], "repository_id int, relative_path string, package_name string, module_name string, source_set string")
    got = {(r["query"], r["relative_path"]) for r in S.search_files(asked(spark, ["src\\main", "main", "w\\\\x", "x\\%", "\\\\", "\\"]), files).collect()}
    assert got == {("main", "src/main/A.java"), ("w\\\\x", "w\\x%"), ("x\\%", "w\\x%"), ("\\\\", "w\\x%")} | ({("x\\%", "w\\x%")} - set())
    points = spark.createDataFrame([(1, "e1", "GET", "/a\\b", "find", "app.C", "src/C.java")], "repository_id int, id string, http_method string, path string, method_name string, controller string, relative_path string")
    assert {r["query"] for r in S.search_endpoints(asked(spark, ["a\\b", "a\\\\b", "get", "app\\.c"]), points).collect()} == {"a\\\\b", "get", "app\\.c"}


def test_no_facts_and_no_texts(spark):
    rows, table = symbols(spark, 3)
    assert callables(spark, [], table) == [] and callables(spark, ["a", " "], table) == []
    assert callables(spark, ["find"], table.limit(0)) == []


def test_postings_are_stored_and_merged_with_their_files(spark, tmp_path):
    path = str(tmp_path / "index")
    rows, table = symbols(spark, 4)
    base = X.write_index({"symbols": table, "postings": S.callable_postings(table)}, path)
    changed = [(*r[:3], "renamed", *r[4:]) for r in rows if r[6].endswith("F3.java")]
    fresh = spark.createDataFrame(changed, table.schema)
    gone = table.where(F.col("relative_path").endswith("F3.java") | F.col("relative_path").endswith("F5.java")).select("repository_id", "relative_path").distinct()
    X.merge_files(spark, path, {"symbols": fresh, "postings": S.callable_postings(fresh)}, gone, base)
    now = [r for r in rows if not r[6].endswith(("F3.java", "F5.java"))] + changed
    stored = X.read_index(spark, path, ["symbols", "postings"])
    texts = [*ODD, "renamed", "f3.j", "f5.j"]
    assert callables(spark, texts, stored["symbols"], stored["postings"]) == callables_by_hand(now, texts)


def test_postings_of_a_file_are_written_once(spark):
    rows, table = symbols(spark, 5)
    shared = S.callable_postings(table).where("id is null")
    assert shared.count() == shared.select("repository_id", "relative_path", "gram").distinct().count()
    assert S.callable_postings(table).where("gram = ''").count() == len({(r[0], r[6]) for r in rows if r[2] != "CLASS"})


def test_many_excerpts_of_one_file(spark):
    text = "\r\n".join(f"line {i}" for i in range(1, 1201))
    files = spark.createDataFrame([("r", "F.java", text), ("r", "empty.java", ""), ("r", "none.java", None)], "repository_id string, relative_path string, content string")
    rng = random.Random(1)
    wanted = [("r", "F.java", rng.randrange(-2, 1300), rng.randrange(-2, 1300)) for _ in range(300)] + [("r", "F.java", s, s + rng.randrange(210)) for s in range(1, 1201)] + [("r", "F.java", 5, 6)] * 3
    wanted += [("r", "none.java", 1, 1), ("r", "missing.java", 1, 1), ("r", "empty.java", 1, 1), ("q", "F.java", 1, 2)]
    ranges = spark.createDataFrame(wanted, "repository_id string, relative_path string, start_line int, end_line int")
    got = S.source_excerpts(ranges, files)
    assert got.columns == [*ranges.columns, "status", "excerpt"]
    rows = got.collect()
    assert len(rows) == len(wanted)
    for r in rows:
        s, e = r["start_line"], r["end_line"]
        if r["relative_path"] != "F.java" or r["repository_id"] != "r":
            assert r["status"] == ("BAD_RANGE" if r["relative_path"] == "empty.java" else "NO_FILE") and r["excerpt"] is None
        elif s < 1 or e < s or e > 1200:
            assert (r["status"], r["excerpt"]) == ("BAD_RANGE", None)
        elif e - s + 1 > 200:
            assert (r["status"], r["excerpt"]) == ("TOO_LONG", None)
        else:
            assert (r["status"], r["excerpt"]) == ("OK", "\n".join(f"line {i}" for i in range(s, e + 1)))
