"""Registered queries on name resolution, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import confidence_label, raw_type
from ..functions.tables import done_with, materialize, measured
from ..operators import resolve as R
from .proxy import fact, oracle


def symbols(spark: SparkSession, sf_dir: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    return fact(spark, sf_dir, "symbols", written).withColumn("roles", F.array_compact(F.array("role"))).drop("role")


def type_refs(spark: SparkSession, sf_dir: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    return fact(spark, sf_dir, "type_refs", written).withColumn("type_args", F.when(F.col("type_arg") != "", F.array("type_arg")).otherwise(F.array().cast("array<string>"))).drop("type_arg")


def facts(spark: SparkSession, sf_dir: str, written: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    made = {n: fact(spark, sf_dir, n, written) for n in ("params", "fields", "calls") if n not in (written or {})}
    return {"symbols": symbols(spark, sf_dir, written), "type_refs": type_refs(spark, sf_dir, written), **made}


def written_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The facts as tables, one after another, so that the disk holds the shuffle files of one at a time."""
    write = lambda df, name: materialize(df, name, settings=measured(spark))
    types = write(fact(spark, sf_dir, "types"), "types")
    raw = write(fact(spark, sf_dir, "raw_calls", {"types": types}), "raw-calls")
    calls = write(fact(spark, sf_dir, "calls", {"types": types, "raw_calls": raw}), "calls")
    done_with(raw)
    rest = facts(spark, sf_dir, {"types": types, "calls": calls})
    made = {name: write(table, name) for name, table in rest.items()}
    done_with(types)
    return {"calls": calls, **made}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = written_facts(spark, sf_dir)
    return R.call_outcomes(f["calls"], f["symbols"], f["fields"], f["params"])


#: Steps that the oracles share, in plain SQL.
STEPS = {
    "uniq": "select repository_id, simple_name type_name, min(id) type_id from symbols where kind in ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') group by 1, 2 having count(*) = 1",
    "look": """select repository_id, parent_id, simple_name as name, case signature when '()' then 0 when '(int)' then 1 else 3 end arity, count(*) n, min(id) method_id
      from symbols where kind = 'METHOD' group by 1, 2, 3, 4""",
    "anywhere": "select repository_id, name, arity, sum(n) n, min(method_id) method_id from look group by 1, 2, 3",
    "inherit": """select r.repository_id, r.type_id source_id, u.type_id target_id, r.ref_kind kind, 0.95 confidence, 'AST_DECLARATION' resolution_method, relative_path, line, "column",
        lower(ref_kind) || ' ' || text evidence_text, 0 emitted
      from type_refs r join uniq u on u.repository_id = r.repository_id
        and u.type_name = case r.position when 0 then r.text when 1 then substring(r.text, 5, length(r.text) - 9) else 'JpaRepository' end
      where type_kind in ('CLASS', 'INTERFACE')""",
    "known_params": """select p.*, u.type_id target_id from params p join uniq u on u.repository_id = p.repository_id
        and u.type_name = case when position = 2 then 'List' else substring(type_text, 5) end""",
    "inject": """select repository_id, type_id source_id, target_id, 'INJECTS' kind, 0.98 confidence, 'CONSTRUCTOR_INJECTION' resolution_method, relative_path, line, "column",
        'constructor parameter ' || name || ': ' || type_text evidence_text, 3 emitted from known_params""",
    "manages": """select r.repository_id, r.type_id source_id, u.type_id target_id, 'MANAGES_ENTITY' kind, 0.95 confidence, 'SPRING_DATA_GENERIC' resolution_method, relative_path, type_line line, type_column "column",
        'Spring Data repository manages app.' || u.type_name evidence_text, 1 emitted
      from type_refs r join uniq u on u.repository_id = r.repository_id and u.type_name = r.type_arg
      where position = 2 and type_kind in ('CLASS', 'INTERFACE')""",
    "convention": """select s.repository_id, s.id source_id, u.type_id target_id, 'TESTS' kind, 0.6 confidence, 'TEST_NAMING_CONVENTION' resolution_method, relative_path, 1 line, 1 "column",
        'test class naming convention' evidence_text, 2 emitted
      from symbols s join uniq u on u.repository_id = s.repository_id and u.type_name = regexp_replace(s.simple_name, 'Tests?$', '') and u.type_id <> s.id
      where s.role = 'TEST' and s.kind <> 'METHOD'""",
    "fmap": """select repository_id, type_id, name, arg_min(type_text, prio) type_text
      from (select repository_id, type_id, name, type_text, 0 prio from fields union all select repository_id, type_id, name, type_text, position from known_params) x group by 1, 2, 3""",
    "sourced": """select c.*, l.method_id source_id from calls c join look l on l.n = 1 and l.repository_id = c.repository_id and l.parent_id = c.owner_id and l.name = c.method_name and l.arity = c.method_arity""",
    "typed": """select s.*, case scope_kind when 'NONE' then owner_id else u.type_id end scope_type_id
      from sourced s left join fmap f on f.repository_id = s.repository_id and f.type_id = s.owner_id and f.name = s.scope_name
      left join uniq u on u.repository_id = s.repository_id and u.type_name =
        case scope_kind when 'NAME' then list_extract(string_split(regexp_replace(coalesce(f.type_text, scope_name), '<.*>', ''), '.'), -1) when 'THIS_FIELD' then list_extract(string_split(regexp_replace(f.type_text, '<.*>', ''), '.'), -1) end""",
    "judged": """select t.*, x.role = 'TEST' is_test, s.id store, l.n own_n, l.method_id own_id, g.n all_n, g.method_id all_id, coalesce(l.n, g.n, 0) n
      from typed t left join look l on l.repository_id = t.repository_id and l.parent_id = t.scope_type_id and l.name = t.callee and l.arity = t.arg_count
      left join anywhere g on t.scope_kind = 'NONE' and l.n is null and g.repository_id = t.repository_id and g.name = t.callee and g.arity = t.arg_count
      left join symbols s on s.id = t.scope_type_id and s.repository_id = t.repository_id and s.role = 'REPOSITORY' and s.kind <> 'METHOD'
      left join symbols x on x.id = t.source_id and x.repository_id = t.repository_id""",
    "result": """select *, coalesce(is_test, false) from_test, case when n = 1 then 'EXACT' when store is not null then 'REPOSITORY' when n > 1 then 'MULTIPLE' when scope_kind <> 'NONE' then 'EXTERNAL' else 'NO_TARGET' end outcome,
        case when n = 1 then coalesce(own_id, all_id) when store is not null then store end target_id from judged""",
    "direct": """select repository_id, source_id, target_id, case when from_test then 'TESTS' else 'CALLS' end kind, 1.0 confidence, 'EXACT_PROJECT_TYPE' resolution_method, relative_path, line, "column", expr_text evidence_text, 4 emitted
      from result where outcome = 'EXACT'""",
    "stored": """select repository_id, source_id, target_id, 'CALLS' kind, 0.9 confidence, 'SPRING_DATA_METHOD' resolution_method, relative_path, line, "column", expr_text evidence_text, 4 emitted from result where outcome = 'REPOSITORY'""",
    "touched": """select r.repository_id, r.source_id, m.target_id, case when regexp_matches(lower(callee), '^(save|delete|remove|insert|update)') then 'WRITES_ENTITY' else 'READS_ENTITY' end kind,
        0.8 confidence, 'SPRING_DATA_METHOD' resolution_method, r.relative_path, r.line, r."column", expr_text evidence_text, 5 emitted
      from result r join manages m on m.repository_id = r.repository_id and m.source_id = r.target_id
      where outcome = 'REPOSITORY' and regexp_matches(lower(callee), '^(save|delete|remove|insert|update|find|get|read|exists|count|search)')""",
    "all_edges": " union all ".join(f"select * from {n}" for n in ("inherit", "manages", "convention", "inject", "direct", "stored", "touched")),
    "deduped": """select * exclude (rn) from (select *, row_number() over (partition by repository_id, source_id, target_id, kind, relative_path, line, "column" order by emitted, -confidence, resolution_method, evidence_text) rn from all_edges) where rn = 1""",
}
_EDGE = 'select repository_id, source_id, target_id, kind, cast(confidence as double) confidence, resolution_method, relative_path, line, "column", evidence_text, emitted from {0}'


def _edge_oracle(step: str) -> str:
    return oracle(_EDGE.format(step), STEPS)


def c1_raw_type(spark, sf_dir):
    texts = type_refs(spark, sf_dir).select("text").unionByName(fact(spark, sf_dir, "params").select(F.col("type_text").alias("text"))).unionByName(fact(spark, sf_dir, "methods").select(F.col("signature").alias("text")))
    return texts.groupBy("text").agg(F.count("*").alias("n")).select("text", raw_type(F.col("text")).alias("raw_type"), "n")


def c2_unique_types(spark, sf_dir):
    return R.unique_types(symbols(spark, sf_dir))


def c3_callable_lookup(spark, sf_dir):
    return R.callable_lookup(symbols(spark, sf_dir))


def c4_inheritance_edges(spark, sf_dir):
    return R.inheritance_edges(type_refs(spark, sf_dir), symbols(spark, sf_dir))


def c5_injection_edges(spark, sf_dir):
    return R.injection_edges(fact(spark, sf_dir, "params"), symbols(spark, sf_dir))


def c6_managed_entity_edges(spark, sf_dir):
    return R.managed_entity_edges(type_refs(spark, sf_dir), symbols(spark, sf_dir))


def c7_test_convention_edges(spark, sf_dir):
    return R.test_convention_edges(symbols(spark, sf_dir))


_CALL = ["repository_id", "source_id", "callee", "arg_count", "scope_kind", "scope_name", "line", "column"]


def c8_scope_types(spark, sf_dir):
    f = facts(spark, sf_dir)
    return R.scope_types(R.call_sources(f["calls"], f["symbols"]), f["fields"], f["params"], f["symbols"]).select(*_CALL, "scope_type_id")


def c9_call_sources(spark, sf_dir):
    f = facts(spark, sf_dir)
    return R.call_sources(f["calls"], f["symbols"]).select(*_CALL)


def c10_resolve_direct_calls(spark, sf_dir):
    return R.direct_call_edges(outcomes(spark, sf_dir))


def c11_global_fallback(spark, sf_dir):
    found = outcomes(spark, sf_dir).where("scope_kind = 'NONE'")
    return found.select(*_CALL, "candidates", "outcome", "target_id")


def c12_repository_calls(spark, sf_dir):
    return R.repository_call_edges(outcomes(spark, sf_dir))


def c13_entity_access_edges(spark, sf_dir):
    f = facts(spark, sf_dir)
    return R.entity_access_edges(outcomes(spark, sf_dir), R.managed_entity_edges(f["type_refs"], f["symbols"]))


def c14_unresolved_calls(spark, sf_dir):
    return R.unresolved_calls(outcomes(spark, sf_dir))


def c15_external_references(spark, sf_dir):
    return R.external_references(outcomes(spark, sf_dir))


def c16_dedupe_relationships(spark, sf_dir):
    return R.dedupe_relationships(fact(spark, sf_dir, "edges").select("repository_id", "source_id", "target_id", "kind", "confidence", F.col("kind").alias("resolution_method"), F.lit("p").alias("relative_path"), "line", F.lit(1).alias("column"), F.col("id").alias("evidence_text"), F.col("column").alias("emitted"))).select(*R.EDGE_COLUMNS)


def c17_truncate_text(spark, sf_dir):
    return fact(spark, sf_dir, "files").select("repository_id", "relative_path", R.truncated(F.col("content"), R.EVIDENCE_CHARS).alias("evidence"), R.truncated(F.col("content"), R.EXTERNAL_CHARS).alias("display_name"))


def c18_confidence_label(spark, sf_dir):
    return fact(spark, sf_dir, "edges").groupBy("repository_id", confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"))


def c19_resolve(spark, sf_dir):
    return R.resolve(**written_facts(spark, sf_dir))["relationships"].select(*R.EDGE_COLUMNS)


QUERIES = {k: v for k, v in globals().items() if k[:1] == "c" and k[1:2].isdigit()}
_CALL_SQL = 'repository_id, source_id, callee, arg_count, scope_kind, scope_name, line, "column"'
ORACLES = {
    "c1_raw_type": oracle("""select text, list_extract(string_split(replace(regexp_replace(text, '<.*>', ''), '[]', ''), '.'), -1) raw_type, count(*) n
      from (select text from type_refs union all select type_text from params union all select signature from methods) group by text"""),
    "c2_unique_types": oracle("select * from uniq", STEPS),
    "c3_callable_lookup": oracle("select * from look", STEPS),
    "c4_inheritance_edges": _edge_oracle("inherit"),
    "c5_injection_edges": _edge_oracle("inject"),
    "c6_managed_entity_edges": _edge_oracle("manages"),
    "c7_test_convention_edges": _edge_oracle("convention"),
    "c8_scope_types": oracle(f"select {_CALL_SQL}, scope_type_id from typed", STEPS),
    "c9_call_sources": oracle(f"select {_CALL_SQL} from sourced", STEPS),
    "c10_resolve_direct_calls": _edge_oracle("direct"),
    "c11_global_fallback": oracle(f"select {_CALL_SQL}, cast(n as bigint) candidates, outcome, target_id from result where scope_kind = 'NONE'", STEPS),
    "c12_repository_calls": _edge_oracle("stored"),
    "c13_entity_access_edges": _edge_oracle("touched"),
    "c14_unresolved_calls": oracle("""select repository_id, source_id, relative_path, expr_text expression, 'CALLS' expected_kind, line, case outcome when 'MULTIPLE' then 'MULTIPLE_CANDIDATES' else 'NO_PROJECT_TARGET' end failure_reason,
      cast(case outcome when 'MULTIPLE' then n else 0 end as bigint) candidate_count from result where outcome in ('MULTIPLE', 'NO_TARGET')""", STEPS),
    "c15_external_references": oracle("""select repository_id, source_id, relative_path, expr_text display_name, line, "column" from result where outcome = 'EXTERNAL'""", STEPS),
    "c16_dedupe_relationships": oracle("""select repository_id, source_id, target_id, kind, confidence, kind resolution_method, 'p' relative_path, line, 1 "column", id evidence_text, "column" emitted
      from (select *, row_number() over (partition by repository_id, source_id, target_id, kind, line order by "column", -confidence, kind, id) rn from edges) where rn = 1"""),
    "c17_truncate_text": oracle("select repository_id, relative_path, substring(content, 1, 1900) evidence, substring(content, 1, 1400) display_name from files"),
    "c18_confidence_label": oracle("select repository_id, case when confidence >= 0.9 then 'HIGH' when confidence >= 0.7 then 'INFERRED' else 'AMBIGUOUS' end as label, count(*) n from edges group by 1, 2"),
    "c19_resolve": _edge_oracle("deduped"),
}
