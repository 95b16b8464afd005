"""Registered queries on files, search and re-indexing, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..operators import reindex as I, search as S
from ..sources import index_store as X, java_files as J
from .proxy import fact, oracle
from .resolve_queries import symbols


def files(spark, sf_dir):
    return fact(spark, sf_dir, "files")


def described(spark, sf_dir, name="files"):
    return J.describe_files(fact(spark, sf_dir, name))


def searched_files(spark, sf_dir):
    return described(spark, sf_dir).withColumn("package_name", F.when(F.col("relative_path").contains("/p/q/"), "p.q").when(F.col("relative_path").contains("/p/"), "p").otherwise(""))


def asked(spark, sf_dir):
    """Search texts: names of parts, and some that are short or padded."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(" ")).alias("query")).distinct().unionByName(
        spark.read.parquet(f"{sf_dir}/region.parquet").select(F.substring("r_name", 1, 1).alias("query")).distinct()).unionByName(
        part.select(F.concat(F.lit("f"), (F.col("p_size") + 100).cast("string")).alias("query")).distinct()).unionByName(part.select(F.lit("find").alias("query")).distinct())


def endpoints(spark, sf_dir):
    return fact(spark, sf_dir, "endpoints").select("repository_id", "id", "http_method", "path", "method_name", "controller", "relative_path")


def edges(spark, sf_dir):
    return fact(spark, sf_dir, "edges")


def type_symbols(spark, sf_dir):
    return symbols(spark, sf_dir).where("kind <> 'METHOD'")


def type_changes(spark, sf_dir):
    """Files of types of one form changed."""
    return fact(spark, sf_dir, "types").where("kind = 'ENUM'").select("repository_id", "relative_path")


def a1_read_source_tree(spark, sf_dir):
    """Java texts are written as a tree of files and read back."""
    root = shared_dir(spark, "source-tree")
    J.write_source_tree(fact(spark, sf_dir, "java_files"), root)
    return J.read_source_tree(spark, root).select("repository_id", "relative_path", F.sha2("content", 256).alias("content_hash"), "is_text")


def a2_filter_source_paths(spark, sf_dir):
    return J.filter_source_paths(files(spark, sf_dir)).select("repository_id", "relative_path")


def a3_describe_files(spark, sf_dir):
    return described(spark, sf_dir)


def a4_source_limit_violations(spark, sf_dir):
    return J.source_limit_violations(described(spark, sf_dir), 20_000, 30)


def a5_detect_build_system(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("k", F.col("n_nationkey") % 4)
    marks = nation.select(F.col("n_nationkey").cast("long").alias("repository_id"), F.explode(F.when(F.col("k") == 0, F.array(F.lit("build.gradle.kts"))).when(F.col("k") == 1, F.array(F.lit("pom.xml"))).when(F.col("k") == 2, F.array(F.lit("pom.xml"), F.lit("settings.gradle"))).otherwise(F.array(F.lit("README")))).alias("relative_path"))
    return J.detect_build_system(marks.unionByName(files(spark, sf_dir).select("repository_id", "relative_path")))


def a6_stored_index(spark, sf_dir):
    """An index is stored, then some repositories come again: one table smaller, one without any row."""
    path = shared_dir(spark, "stored-index")
    names, callers = symbols(spark, sf_dir).select("repository_id", "id", "kind"), edges(spark, sf_dir).select("repository_id", "id", "kind")
    X.write_index({"symbols": names, "relationships": callers}, path)
    again = F.col("repository_id") % 5 == 0
    X.write_index({"symbols": names.where(again & (F.col("kind") != "METHOD")), "relationships": callers.where("false")}, path, names.where(again).select("repository_id").distinct())
    back = X.read_index(spark, path, ["symbols", "relationships"])
    return back["symbols"].withColumn("what", F.lit("symbol")).unionByName(back["relationships"].withColumn("what", F.lit("edge")))


def e1_list_endpoints(spark, sf_dir):
    return S.list_endpoints(endpoints(spark, sf_dir), "ri").select("repository_id", "place", "id", "controller", "path", "http_method")


def e2_search_endpoints(spark, sf_dir):
    return S.search_endpoints(asked(spark, sf_dir), endpoints(spark, sf_dir))


def e3_search_callables(spark, sf_dir):
    return S.search_callables(asked(spark, sf_dir), symbols(spark, sf_dir))


def e4_search_files(spark, sf_dir):
    return S.search_files(asked(spark, sf_dir), searched_files(spark, sf_dir))


def e5_normalize_queries(spark, sf_dir):
    return S.normalize_queries(asked(spark, sf_dir))


def e6_source_excerpts(spark, sf_dir):
    at = F.length("relative_path")
    ranges = files(spark, sf_dir).select("repository_id", "relative_path", (at % 3).alias("start_line"), (at % 3 + at % 7).alias("end_line"))
    return S.source_excerpts(ranges, files(spark, sf_dir))


def e7_stale_sources(spark, sf_dir):
    return S.stale_sources(fact(spark, sf_dir, "snapshot"), described(spark, sf_dir))


def e8_list_repositories(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("repository_id"), F.col("n_name").alias("display_name"), F.col("n_regionkey").alias("created_at"))
    return S.list_repositories(nation, J.filter_source_paths(files(spark, sf_dir)))


def _diff(spark, sf_dir):
    return I.diff_snapshots(described(spark, sf_dir), described(spark, sf_dir, "snapshot"))


def g1_diff_snapshots(spark, sf_dir):
    return _diff(spark, sf_dir)


def g2_dependant_files(spark, sf_dir):
    return I.dependant_files(edges(spark, sf_dir), type_symbols(spark, sf_dir), type_changes(spark, sf_dir))


def g3_plan_reindex(spark, sf_dir):
    kept = fact(spark, sf_dir, "types").select("repository_id", "relative_path", F.when(F.col("kind") == "ENUM", "MODIFIED").otherwise("UNCHANGED").alias("change"))
    return I.plan_reindex(kept, g2_dependant_files(spark, sf_dir))


def g4_retained_symbols(spark, sf_dir):
    return I.retained(type_symbols(spark, sf_dir), g2_dependant_files(spark, sf_dir)).select("repository_id", "id", "relative_path")


def g6_apply_increment(spark, sf_dir):
    index = {"symbols": type_symbols(spark, sf_dir), "relationships": edges(spark, sf_dir).join(type_symbols(spark, sf_dir).select("repository_id", F.col("id").alias("source_id"), "relative_path"), ["repository_id", "source_id"])}
    changed = type_changes(spark, sf_dir)
    fresh = {"symbols": type_symbols(spark, sf_dir).join(changed.select("repository_id", "relative_path"), ["repository_id", "relative_path"], "left_semi").where("simple_name like 'r%'")}
    return I.apply_increment(index, fresh, changed)["relationships"].select("repository_id", "id", "source_id", "target_id")


def g6_stored_merge(spark, sf_dir):
    """The same replacement in a stored index, where only the buckets of changed files and of those that depend on them are written."""
    path = shared_dir(spark, "merged-index")
    names, places = type_symbols(spark, sf_dir), type_symbols(spark, sf_dir).select("repository_id", F.col("id").alias("source_id"), "relative_path")
    calls = edges(spark, sf_dir).join(places, ["repository_id", "source_id"])
    base = X.write_index({"symbols": names, "relationships": calls}, path)
    changed = type_changes(spark, sf_dir)
    affected = changed.unionByName(g2_dependant_files(spark, sf_dir)).distinct()
    again = names.join(affected, ["repository_id", "relative_path"], "left_semi").where("kind <> 'ENUM' or simple_name like 'r%'")
    ends = names.where("kind <> 'ENUM' or simple_name like 'r%'").select("repository_id", F.col("id").alias("target_id"))
    kept = calls.join(again.select("repository_id", F.col("id").alias("source_id")), ["repository_id", "source_id"], "left_semi").where("source_id is not null")
    fresh = {"symbols": again, "relationships": kept.join(ends, ["repository_id", "target_id"], "left_semi").join(changed, ["repository_id", "relative_path"], "left_anti").select(*calls.columns)}
    X.merge_files(spark, path, fresh, affected, base)
    return X.read_index(spark, path, ["relationships"])["relationships"].select("repository_id", "id", "source_id", "target_id")


def g7_snapshot_drift(spark, sf_dir):
    return I.snapshot_drift(described(spark, sf_dir), described(spark, sf_dir, "snapshot"))


def g8_run_summary(spark, sf_dir):
    return I.run_summary({"files": files(spark, sf_dir), "symbols": symbols(spark, sf_dir), "edges": edges(spark, sf_dir)}, _diff(spark, sf_dir))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "aeg" and k[1:2].isdigit()}

_LINES = r"regexp_split_to_array(content, '\r\n|\r|\n')"
STEPS = {
    "kept": """select repository_id, relative_path, content from files where relative_path like '%.java'
      and not list_has_any(string_split(relative_path, '/'), ['.git', '.gradle', '.idea', 'build', 'target', 'out', 'generated', 'node_modules'])
      and regexp_matches(relative_path, '(^|/)src/(main|test)/java/')""",
    "told": f"""select repository_id, relative_path, case when regexp_matches(relative_path, '(^|/)src/test/java/') then 'TEST' else 'MAIN' end source_set,
      case when position('/src/' in relative_path) > 0 then substring(relative_path, 1, position('/src/' in relative_path) - 1) else '.' end module_name, sha256(content) content_hash,
      cast(len({_LINES}) - case when {_LINES}[-1] = '' then 1 else 0 end as bigint) line_count, cast(strlen(content) as bigint) file_size from files""",
    "diff": """select coalesce(a.repository_id, b.repository_id) repository_id, coalesce(a.relative_path, b.relative_path) relative_path,
      case when a.h is null then 'ADDED' when b.h is null then 'DELETED' when a.h <> b.h then 'MODIFIED' else 'UNCHANGED' end change
      from (select repository_id, relative_path, sha256(content) h from files) a full join (select repository_id, relative_path, sha256(content) h from snapshot) b on a.repository_id = b.repository_id and a.relative_path = b.relative_path""",
    "queries": """select distinct ' ' || upper(replace(p_name, ' ', '_')) || ' ' query from part union all select distinct substring(r_name, 1, 1) from region
      union all select distinct 'f' || cast(p_size + 100 as varchar) from part union all select 'find'""",
    "asked": "select query, lower(trim(query)) needle from queries where length(trim(query)) >= 2",
    "dependants": """select distinct s.repository_id, s.relative_path from edges e join types t on t.id = e.target_id and t.kind = 'ENUM' join types s on s.id = e.source_id""",
    "affected": "select repository_id, relative_path from types where kind = 'ENUM' union select * from dependants",
    "modes": """select a.repository_id, case when a.n > least(500, greatest(1, t.n // 4)) then 'BROAD' else 'INCREMENTAL' end as mode
      from (select repository_id, count(*) n from affected group by 1) a join (select repository_id, count(*) n from types group by 1) t using (repository_id)""",
}
ORACLES = {
    "a1_read_source_tree": oracle("select repository_id, relative_path, sha256(content) content_hash, true is_text from java_files"),
    "a2_filter_source_paths": oracle("select repository_id, relative_path from kept", STEPS),
    "a3_describe_files": oracle("select * from told", STEPS),
    "a4_source_limit_violations": oracle("""select repository_id, relative_path, 'FILE_TOO_LARGE' violation, file_size amount from told where file_size > 20000
      union all select repository_id, null, 'TOO_MANY_FILES', count(*) from told group by 1 having count(*) > 30""", STEPS),
    "a5_detect_build_system": oracle("""select n.n_nationkey::bigint repository_id, case n_nationkey % 4 when 0 then 'GRADLE' when 1 then 'MAVEN' when 2 then 'GRADLE_AND_MAVEN' else 'UNKNOWN' end build_system from nation n"""),
    "a6_stored_index": oracle("""select repository_id, id, kind, 'symbol' what from symbols where repository_id % 5 <> 0 or kind <> 'METHOD'
      union all select repository_id, id, kind, 'edge' from edges where repository_id % 5 <> 0"""),
    "e1_list_endpoints": oracle("""select repository_id, place, id, controller, path, http_method from (
      select *, row_number() over (partition by repository_id order by controller, path, http_method, id) place from endpoints where lower(path) like '%ri%' or lower(controller) like '%ri%') x where place <= 500"""),
    "e2_search_endpoints": oracle("""select query, place, id, http_method, path from (
      select *, row_number() over (partition by query order by (lower(path) <> needle)::int, path, http_method, id) place from endpoints e join asked a
        on lower(e.path) like '%' || needle || '%' or lower(e.http_method) like '%' || needle || '%' or lower(e.method_name) like '%' || needle || '%' or lower(e.controller) like '%' || needle || '%' or lower(e.relative_path) like '%' || needle || '%') x where place <= 20""", STEPS),
    "e3_search_callables": oracle("""select query, place, id, simple_name, qualified_name from (
      select *, row_number() over (partition by query order by (lower(simple_name) <> needle)::int, qualified_name, start_line, id) place from symbols s join asked a
        on s.kind = 'METHOD' and (lower(s.simple_name || s.signature) like '%' || needle || '%' or lower(s.qualified_name) like '%' || needle || '%' or lower(s.relative_path) like '%' || needle || '%')) x where place <= 20""", STEPS),
    "e4_search_files": oracle("""select query, place, repository_id, relative_path, detail from (
      select *, row_number() over (partition by query order by case when lower(relative_path) = needle then 0 when starts_with(lower(relative_path), needle) then 1 else 2 end, relative_path, repository_id) place
      from (select *, case when relative_path like '%/p/q/%' then 'p.q' when relative_path like '%/p/%' then 'p' else module_name end detail, case when relative_path like '%/p/q/%' then 'p.q' when relative_path like '%/p/%' then 'p' else '' end package_name from told) f
      join asked a on lower(relative_path) like '%' || needle || '%' or package_name like '%' || needle || '%') x where place <= 20""", STEPS),
    "e5_normalize_queries": oracle("select query, needle from asked", STEPS),
    "e6_source_excerpts": oracle(f"""select repository_id, relative_path, s start_line, e end_line, status, case when status = 'OK' then array_to_string(lines[s : e], chr(10)) end excerpt
      from (select *, case when s < 1 or e < s or e > len(lines) then 'BAD_RANGE' when e - s + 1 > 200 then 'TOO_LONG' else 'OK' end status from (
        select repository_id, relative_path, length(relative_path) % 3 s, length(relative_path) % 3 + length(relative_path) % 7 e, case when {_LINES}[-1] = '' then {_LINES}[:-2] else {_LINES} end lines from files) x) y"""),
    "e7_stale_sources": oracle("select repository_id, relative_path, sha256(s.content) current_hash, sha256(f.content) content_hash from snapshot s join files f using (repository_id, relative_path) where s.content <> f.content"),
    "e8_list_repositories": oracle("select n.n_nationkey::bigint repository_id, n.n_name display_name, n.n_regionkey created_at, coalesce(k.n, 0) files from nation n left join (select repository_id, count(*) n from kept group by 1) k on k.repository_id = n.n_nationkey", STEPS),
    "g1_diff_snapshots": oracle("select * from diff", STEPS),
    "g2_dependant_files": oracle("select * from dependants", STEPS),
    "g3_plan_reindex": oracle("""select a.repository_id, a.relative_path, m.mode from affected a join modes m on m.repository_id = a.repository_id and m.mode = 'INCREMENTAL'
      union all select t.repository_id, t.relative_path, m.mode from types t join modes m on m.repository_id = t.repository_id and m.mode = 'BROAD'""", STEPS),
    "g4_retained_symbols": oracle("select t.repository_id, t.id, t.relative_path from types t where not exists (select 1 from dependants d where d.relative_path = t.relative_path and d.repository_id = t.repository_id)", STEPS),
    "g6_apply_increment": oracle("""select e.repository_id, e.id, e.source_id, e.target_id from edges e join types s on s.id = e.source_id and s.kind <> 'ENUM' join types t on t.id = e.target_id and (t.kind <> 'ENUM' or t.simple_name like 'r%')"""),
    "g6_stored_merge": oracle("""select e.repository_id, e.id, e.source_id, e.target_id from edges e join types s on s.id = e.source_id and s.kind <> 'ENUM' join types t on t.id = e.target_id and (t.kind <> 'ENUM' or t.simple_name like 'r%')"""),
    "g7_snapshot_drift": oracle("select * from diff where change <> 'UNCHANGED'", STEPS),
    "g8_run_summary": oracle("""select repository_id, 'files' what, count(*) n from files group by 1 union all select repository_id, 'symbols', count(*) from symbols group by 1 union all select repository_id, 'edges', count(*) from edges group by 1
      union all select repository_id, lower(change), count(*) from diff where change <> 'UNCHANGED' group by 1, 2""", STEPS),
}
