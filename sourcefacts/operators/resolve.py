"""Names to symbols: typed edges with confidence, and what stays unresolved.

Every look-up table is grouped to one row for each key before it is joined, so
no join fans out, and ``repository_id`` is in every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import DATA_BASES, EVIDENCE_CHARS, EXTERNAL_CHARS, TYPE_KINDS, arity, data_access, raw_type, truncated
from ..functions.tables import done_with, materialize, shuffled

EDGE_COLUMNS = ["repository_id", "source_id", "target_id", "kind", "confidence", "resolution_method", "relative_path", "line", "column", "evidence_text", "emitted"]
EDGE_KEY = ["repository_id", "source_id", "target_id", "kind", "relative_path", "line", "column"]


def types_of(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*TYPE_KINDS))


def unique_types(symbols: DataFrame) -> DataFrame:
    """``repository_id, type_name, type_id`` where one type alone has the name."""
    named = types_of(symbols).where(F.trim("simple_name") != "")
    return (
        named.groupBy("repository_id", F.col("simple_name").alias("type_name")).agg(F.count("*").alias("n"), F.min("id").alias("type_id"))
        .where("n = 1").drop("n")
    )


def callable_lookup(symbols: DataFrame) -> DataFrame:
    """``repository_id, parent_id, name, arity`` to how many methods, and one of them."""
    methods = symbols.where("kind = 'METHOD'").withColumn("arity", arity(F.col("signature")))
    return methods.groupBy("repository_id", "parent_id", F.col("simple_name").alias("name"), "arity").agg(F.count("*").alias("n"), F.min("id").alias("method_id"))


def global_lookup(symbols: DataFrame) -> DataFrame:
    """The same over all types of a repository."""
    return callable_lookup(symbols).groupBy("repository_id", "name", "arity").agg(F.sum("n").alias("n"), F.min("method_id").alias("method_id"))


def _edges(df: DataFrame, target: str, kind: Column, confidence: Column | float, method: Column | str, evidence: Column, emitted: int, source: str = "type_id") -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "repository_id", F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("kind"), as_col(confidence).cast("double").alias("confidence"),
        as_col(method).alias("resolution_method"), "relative_path", "line", "column", truncated(evidence, EVIDENCE_CHARS).alias("evidence_text"), F.lit(emitted).alias("emitted"),
    )


def _with_type(df: DataFrame, name: Column, symbols: DataFrame, out: str, how: str = "inner") -> DataFrame:
    found = unique_types(symbols).select(F.col("repository_id").alias("_named_in"), "type_name", F.col("type_id").alias(out))
    return df.withColumn("_name", name).join(shuffled(found), (F.col("repository_id") == F.col("_named_in")) & (F.col("_name") == F.col("type_name")), how).drop("_named_in", "_name", "type_name")


def inheritance_edges(type_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS of classes and interfaces to uniquely named types.

    ``type_refs``: repository_id, type_id, type_kind, ref_kind, text, type_args, position and place.
    """
    refs = type_refs.where(F.col("type_kind").isin("CLASS", "INTERFACE"))
    word = F.when(F.col("ref_kind") == "EXTENDS", "extends ").otherwise("implements ")
    return _edges(_with_type(refs, raw_type(F.col("text")), symbols, "_target"), "_target", F.col("ref_kind"), 0.95, "AST_DECLARATION", F.concat(word, F.col("text")), 0)


def injection_edges(params: DataFrame, symbols: DataFrame) -> DataFrame:
    """INJECTS from a type to the unique types of its constructor parameters.

    ``params``: repository_id, type_id, name, type_text, position and place.
    """
    evidence = F.concat(F.lit("constructor parameter "), F.col("name"), F.lit(": "), F.col("type_text"))
    return _edges(_with_type(params, raw_type(F.col("type_text")), symbols, "_target"), "_target", F.lit("INJECTS"), 0.98, "CONSTRUCTOR_INJECTION", evidence, 3)


def managed_entity_edges(type_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """MANAGES_ENTITY from a repository type to the first type argument that is a project type."""
    based = type_refs.where((F.col("ref_kind") == "EXTENDS") & F.col("type_kind").isin("CLASS", "INTERFACE") & raw_type(F.col("text")).isin(*DATA_BASES) & (F.size("type_args") > 0))
    found = _with_type(based, raw_type(F.element_at("type_args", 1)), symbols, "_target")
    first = found.groupBy("repository_id", "type_id").agg(F.min_by(F.struct("_target", "relative_path", F.col("type_line").alias("line"), F.col("type_column").alias("column")), "position").alias("f")).select("repository_id", "type_id", "f.*")
    names = symbols.select(F.col("repository_id").alias("_r"), F.col("id").alias("_i"), "qualified_name")
    named = first.join(shuffled(names), (F.col("repository_id") == F.col("_r")) & (F.col("_target") == F.col("_i")))
    return _edges(named, "_target", F.lit("MANAGES_ENTITY"), 0.95, "SPRING_DATA_GENERIC", F.concat(F.lit("Spring Data repository manages "), F.col("qualified_name")), 1)


def test_convention_edges(symbols: DataFrame) -> DataFrame:
    """TESTS from a test type to the type it is named after."""
    tests = types_of(symbols).where(F.array_contains("roles", "TEST")).withColumnsRenamed({"id": "type_id", "start_line": "line", "start_column": "column"})
    found = _with_type(tests, F.regexp_replace("simple_name", "Tests?$", ""), symbols, "_target").where("_target <> type_id")
    return _edges(found, "_target", F.lit("TESTS"), 0.60, "TEST_NAMING_CONVENTION", F.lit("test class naming convention"), 2)


def field_types(fields: DataFrame, params: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repository_id, type_id, name, type_text``: fields, then constructor parameters of known types."""
    known = _with_type(params, raw_type(F.col("type_text")), symbols, "_target").drop("_target")
    columns = ["repository_id", "type_id", "name", "type_text"]
    both = fields.select(*columns, F.lit(0).alias("_own"), F.lit(0).alias("_at")).unionByName(known.select(*columns, F.lit(1).alias("_own"), F.col("position").alias("_at")))
    return both.groupBy("repository_id", "type_id", "name").agg(F.min_by("type_text", F.struct("_own", "_at", "type_text")).alias("type_text"))


def call_sources(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``source_id``: the enclosing method, where name and arity name one; other calls go."""
    lookup = callable_lookup(symbols).where("n = 1").select(F.col("repository_id").alias("_r"), F.col("parent_id").alias("_p"), F.col("name").alias("_n"), F.col("arity").alias("_a"), F.col("method_id").alias("source_id"))
    on = (F.col("repository_id") == F.col("_r")) & (F.col("owner_id") == F.col("_p")) & (F.col("method_name") == F.col("_n")) & (F.col("method_arity") == F.col("_a"))
    return calls.join(shuffled(lookup), on).drop("_r", "_p", "_n", "_a")


def scope_types(calls: DataFrame, fields: DataFrame, params: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``scope_type_name`` and ``scope_type_id``: the static type of what a call is made on, as written and where one type has the name."""
    known = field_types(fields, params, symbols).select(F.col("repository_id").alias("_r"), F.col("type_id").alias("_t"), F.col("name").alias("_n"), F.col("type_text").alias("_text"))
    joined = calls.join(shuffled(known), (F.col("repository_id") == F.col("_r")) & (F.col("owner_id") == F.col("_t")) & (F.col("scope_name") == F.col("_n")), "left")
    text = F.when(F.col("scope_kind") == "NAME", F.coalesce("_text", "scope_name")).when(F.col("scope_kind") == "THIS_FIELD", F.col("_text"))
    named = joined.withColumn("scope_type_name", F.nullif(raw_type(text), F.lit("")))
    typed = _with_type(named, F.col("scope_type_name"), symbols, "_found", "left")
    return typed.withColumn("scope_type_id", F.when(F.col("scope_kind") == "NONE", F.col("owner_id")).otherwise(F.col("_found"))).drop("_r", "_t", "_n", "_text", "_found")


def call_outcomes(calls: DataFrame, symbols: DataFrame, fields: DataFrame, params: DataFrame, documented_fallback: bool = False) -> DataFrame:
    """Every call whose source is known, with exactly one ``outcome``.

    EXACT (or GLOBAL: found by name and arity alone), REPOSITORY, MULTIPLE,
    EXTERNAL or NO_TARGET, with ``target_id`` and the number of candidates;
    ``asked_all`` when the methods of all types were looked at.
    A global hit is an exact one unless ``documented_fallback``. Calls are
    written after every two look-ups, so the disk holds the shuffle files of
    two at a time, and a table of these steps is deleted once the next is
    written.
    """
    sourced = materialize(call_sources(calls, symbols), "sourced")
    scoped = materialize(scope_types(sourced, fields, params, symbols), "scoped")
    done_with(sourced)
    own = callable_lookup(symbols).select(F.col("repository_id").alias("_r"), F.col("parent_id").alias("_p"), F.col("name").alias("_n"), F.col("arity").alias("_a"), F.col("n").alias("_own"), F.col("method_id").alias("_own_id"))
    everywhere = global_lookup(symbols).select(F.col("repository_id").alias("_gr"), F.col("name").alias("_gn"), F.col("arity").alias("_ga"), F.col("n").alias("_all"), F.col("method_id").alias("_all_id"))
    stores = types_of(symbols).where(F.array_contains("roles", "REPOSITORY")).select(F.col("repository_id").alias("_sr"), F.col("id").alias("_store"))
    sources = symbols.select(F.col("repository_id").alias("_xr"), F.col("id").alias("_xid"), F.array_contains("roles", "TEST").alias("from_test"))
    looked_up = (
        scoped.join(shuffled(own), (F.col("repository_id") == F.col("_r")) & (F.col("scope_type_id") == F.col("_p")) & (F.col("callee") == F.col("_n")) & (F.col("arg_count") == F.col("_a")), "left")
        .join(everywhere, (F.col("repository_id") == F.col("_gr")) & (F.col("callee") == F.col("_gn")) & (F.col("arg_count") == F.col("_ga")) & (F.col("scope_kind") == "NONE") & F.col("_own").isNull(), "left")
    )
    looked_up = materialize(looked_up.select(*scoped.columns, "_own", "_own_id", "_all", "_all_id"), "looked-up")
    done_with(scoped)
    found = (
        looked_up.join(shuffled(stores), (F.col("repository_id") == F.col("_sr")) & (F.col("scope_type_id") == F.col("_store")), "left")
        .join(shuffled(sources), (F.col("repository_id") == F.col("_xr")) & (F.col("source_id") == F.col("_xid")), "left")
    )
    n = F.coalesce("_own", "_all", F.lit(0))
    outcome = (
        F.when(n == 1, F.when(F.col("_own").isNull() & F.lit(documented_fallback), "GLOBAL").otherwise("EXACT"))
        .when(F.col("_store").isNotNull(), "REPOSITORY").when(n > 1, "MULTIPLE").when(F.col("scope_kind") != "NONE", "EXTERNAL").otherwise("NO_TARGET")
    )
    target = F.when(n == 1, F.coalesce("_own_id", "_all_id")).when(F.col("_store").isNotNull(), F.col("_store"))
    return found.withColumn("candidates", n.cast("long")).withColumn("outcome", outcome).withColumn("target_id", target).select(
        *scoped.columns, F.coalesce("from_test", F.lit(False)).alias("from_test"), ((F.col("scope_kind") == "NONE") & F.col("_own").isNull()).alias("asked_all"), "candidates", "outcome", "target_id",
    )


def direct_call_edges(outcomes: DataFrame) -> DataFrame:
    hit = outcomes.where(F.col("outcome").isin("EXACT", "GLOBAL"))
    exact = F.col("outcome") == "EXACT"
    return _edges(hit, "target_id", F.when(F.col("from_test"), "TESTS").otherwise("CALLS"), F.when(exact, 1.0).otherwise(0.70), F.when(exact, "EXACT_PROJECT_TYPE").otherwise("UNIQUE_NAME_AND_ARITY"), F.col("expr_text"), 4, "source_id")


def repository_call_edges(outcomes: DataFrame) -> DataFrame:
    return _edges(outcomes.where("outcome = 'REPOSITORY'"), "target_id", F.lit("CALLS"), 0.90, "SPRING_DATA_METHOD", F.col("expr_text"), 4, "source_id")


def entity_access_edges(outcomes: DataFrame, managed: DataFrame) -> DataFrame:
    """Reads and writes of the entity that the called repository manages."""
    entity = managed.groupBy(F.col("repository_id").alias("_r"), F.col("source_id").alias("_s")).agg(F.min_by("target_id", F.struct("relative_path", "line", "column", "target_id")).alias("_entity"))
    hit = outcomes.where("outcome = 'REPOSITORY'").withColumn("_kind", data_access(F.col("callee"))).where("_kind is not null")
    found = hit.join(shuffled(entity), (F.col("repository_id") == F.col("_r")) & (F.col("target_id") == F.col("_s")))
    return _edges(found, "_entity", F.col("_kind"), 0.80, "SPRING_DATA_METHOD", F.col("expr_text"), 5, "source_id")


def unresolved_calls(outcomes: DataFrame) -> DataFrame:
    hit = outcomes.where(F.col("outcome").isin("MULTIPLE", "NO_TARGET"))
    reason = F.when(F.col("outcome") == "MULTIPLE", "MULTIPLE_CANDIDATES").otherwise("NO_PROJECT_TARGET")
    return hit.select("repository_id", "source_id", "relative_path", truncated(F.col("expr_text"), EVIDENCE_CHARS).alias("expression"), F.lit("CALLS").alias("expected_kind"), "line", reason.alias("failure_reason"), F.when(F.col("outcome") == "MULTIPLE", F.col("candidates")).otherwise(0).cast("long").alias("candidate_count"))


def external_references(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'EXTERNAL'").select("repository_id", "source_id", "relative_path", truncated(F.col("expr_text"), EXTERNAL_CHARS).alias("display_name"), "line", "column")


LOOKUP = ["kind", "owner", "name", "arity"]


def _lookup(df: DataFrame, kind: str, owner: Column | None = None, name: Column | None = None, arity: Column | None = None) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    return df.select("repository_id", "relative_path", F.lit(kind).alias("kind"), text(owner).alias("owner"), text(name).alias("name"), (arity if arity is not None else F.lit(-1)).cast("int").alias("arity"))


def name_lookups(type_refs: DataFrame, params: DataFrame, outcomes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repository_id, relative_path, kind, owner, name, arity``: what each file's resolution asked for, found or not.

    TYPE: a type of that name. MEMBER: a method of a type (``owner``) by name
    and arity. GLOBAL: a method of any type. STORE: whether a type is a
    repository, and of what. Another answer to one of these is the only way
    in which a change elsewhere changes the edges, unresolved calls and
    external references of a file.
    """
    declared = type_refs.where(F.col("type_kind").isin("CLASS", "INTERFACE"))
    based = declared.where((F.col("ref_kind") == "EXTENDS") & raw_type(F.col("text")).isin(*DATA_BASES) & (F.size("type_args") > 0))
    tests = types_of(symbols).where(F.array_contains("roles", "TEST"))
    scoped, owned = outcomes.where("scope_type_name is not null"), outcomes.where("scope_type_id is not null")
    parts = [
        _lookup(declared, "TYPE", name=raw_type(F.col("text"))), _lookup(based, "TYPE", name=raw_type(F.element_at("type_args", 1))), _lookup(params, "TYPE", name=raw_type(F.col("type_text"))),
        _lookup(tests, "TYPE", name=F.regexp_replace("simple_name", "Tests?$", "")), _lookup(scoped, "TYPE", name=F.col("scope_type_name")),
        _lookup(owned, "MEMBER", F.col("scope_type_id"), F.col("callee"), F.col("arg_count")), _lookup(owned, "STORE", F.col("scope_type_id")),
        _lookup(outcomes.where("asked_all"), "GLOBAL", name=F.col("callee"), arity=F.col("arg_count")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def changed_answers(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repository_id, kind, owner, name, arity`` of the look-ups that answer otherwise for these symbols of changed files than for those."""
    told = lambda df: df.select("repository_id", "id", "kind", "parent_id", "simple_name", "signature", F.array_join(F.array_sort("roles"), ",").alias("_roles"), F.lit("").alias("relative_path"))
    a, b = told(before), told(after)
    changed = a.exceptAll(b).unionByName(b.exceptAll(a)).withColumnRenamed("kind", "_kind")
    types, methods = changed.where(F.col("_kind").isin(*TYPE_KINDS)), changed.where("_kind = 'METHOD'")
    n = arity(F.col("signature"))
    parts = [_lookup(types, "TYPE", name=F.col("simple_name")), _lookup(types, "STORE", F.col("id")), _lookup(methods, "MEMBER", F.col("parent_id"), F.col("simple_name"), n), _lookup(methods, "GLOBAL", name=F.col("simple_name"), arity=n)]
    return reduce(DataFrame.unionByName, parts).drop("relative_path").distinct()


def asking_files(lookups: DataFrame, answers: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files whose resolution asked for one of the answers, and those that asked for the repository types among them.

    What a repository type manages follows from names that its own file
    looked up, so who calls it is reopened with it.
    """
    first = materialize(lookups.join(answers, ["repository_id", *LOOKUP], "left_semi").select("repository_id", "relative_path").distinct(), "asking")
    stores = types_of(symbols).where(F.array_contains("roles", "REPOSITORY")).join(first, ["repository_id", "relative_path"], "left_semi").select("repository_id", F.col("id").alias("owner"))
    second = lookups.where("kind = 'STORE'").join(stores, ["repository_id", "owner"], "left_semi").select("repository_id", "relative_path")
    return first.unionByName(second).distinct()


def dedupe_relationships(edges: DataFrame) -> DataFrame:
    """The first emitted row for each key, and how ``often`` it was emitted; a row for each key and task goes into the shuffle."""
    rest = [c for c in EDGE_COLUMNS if c not in EDGE_KEY]
    order = F.struct("emitted", (-F.col("confidence")).alias("_c"), "resolution_method", "evidence_text")
    first = edges.groupBy(*EDGE_KEY).agg(F.min_by(F.struct(*rest), order).alias("_f"), F.count("*").alias("often"))
    return first.select(*EDGE_KEY, "_f.*", "often").select(*EDGE_COLUMNS, "often")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EDGE_KEY]
    return edges.withColumn("id", F.sha2(F.concat_ws("|", *parts).cast("binary"), 256))


def resolve(symbols: DataFrame, type_refs: DataFrame, params: DataFrame, fields: DataFrame, calls: DataFrame, documented_fallback: bool = False, seed_managed: DataFrame | None = None) -> dict[str, DataFrame]:
    """All edges, unresolved calls, external references and look-ups of the facts.

    Entity access does not hang on the order of files. ``seed_managed`` are
    stored MANAGES_ENTITY edges of files that are not read again.
    """
    # several kinds of edges are made of these two, which are written for that
    managed = materialize(managed_entity_edges(type_refs, symbols), "managed")
    all_managed = managed if seed_managed is None else managed.unionByName(seed_managed.select(*EDGE_COLUMNS))
    outcomes = materialize(call_outcomes(calls, symbols, fields, params, documented_fallback), "outcomes")
    parts = [
        inheritance_edges(type_refs, symbols), managed, test_convention_edges(symbols), injection_edges(params, symbols),
        direct_call_edges(outcomes), repository_call_edges(outcomes), entity_access_edges(outcomes, all_managed),
    ]
    edges = dedupe_relationships(reduce(DataFrame.unionByName, parts))
    return {
        "relationships": with_edge_ids(edges), "unresolved": unresolved_calls(outcomes), "external": external_references(outcomes),
        "lookups": name_lookups(type_refs, params, outcomes, symbols),
    }
