"""Ranked search, listings and source excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import materialize

RESULTS, ENDPOINTS, EXCERPT_LINES, MIN_QUERY = 20, 500, 200, 2
#: Characters of the runs by which queries and facts meet.
GRAM = 3
#: Lines of a part of a file whose ranges are answered together.
RANGE_LINES = 500
#: Tasks over which the postings of one run are spread.
SPREAD = 16
LINE_END = r"\r\n|\r|\n"


def normalize_queries(queries: DataFrame) -> DataFrame:
    """Adds ``needle``: trimmed and in lower case; shorter than two characters go."""
    return queries.withColumn("needle", F.lower(F.trim("query"))).where(F.length("needle") >= MIN_QUERY)


def like_pattern(needle: Column) -> Column:
    """The pattern of a needle anywhere in a text: ``%`` and ``_`` are wildcards, a backslash takes the next character as it is.

    Spark knows a backslash before a wildcard or another one only, so others
    are left out. One at the end makes the closing ``%`` a character.
    """
    return F.regexp_replace(F.concat(F.lit("%"), needle, F.lit("%")), r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def _windows(text: Column) -> Column:
    """The distinct runs of up to ``GRAM`` characters, one from each place; at the end they are shorter."""
    text = F.lower(F.coalesce(text, F.lit("")))
    at = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM)))))


def _file(name: str = "relative_path") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def postings(facts: DataFrame, own: list[Column], shared: list[Column]) -> DataFrame:
    """``repository_id, relative_path, gram, id``: where each run of three characters stands.

    ``own`` texts give a row for each fact, ``shared`` ones, which all facts of
    a file have alike, a row without ``id`` for each file. The empty run
    stands for every file. Rows belong to files, so the table can be stored
    and merged with the facts it is made from.
    """
    files = facts.select("repository_id", _file().alias("relative_path"), F.array(*[F.lower(F.coalesce(t, F.lit(""))) for t in shared]).alias("_texts")).distinct()
    everywhere = F.concat(F.array(F.lit("")), F.flatten(F.transform("_texts", _windows)))
    parts = [files.select("repository_id", "relative_path", F.explode(F.array_distinct(everywhere)).alias("gram"), F.lit(None).cast("string").alias("id"))]
    if own:
        grams = F.array_distinct(F.flatten(F.array(*map(_windows, own))))
        parts.append(facts.select("repository_id", _file().alias("relative_path"), F.explode(grams).alias("gram"), F.col("id").cast("string").alias("id")))
    return reduce(DataFrame.unionByName, parts)


def _keys(queries: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query, needle`` as asked, and ``needle, gram``: the runs by which a needle's facts are found.

    Of a needle's longest part without a wildcard that is the run that is
    written down least often; where the part is shorter than a run, all runs
    that begin with it; where there is no such part, the empty run.
    """
    parts = F.filter(F.split("needle", r"[%_\\]"), lambda x: x != "")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    asked = normalize_queries(queries).select("query", "needle").distinct().withColumn("_part", F.when(F.size(parts) > 0, longest).otherwise(F.lit("")))
    asked = materialize(asked, "asked")
    needles = asked.select("needle", "_part").distinct()
    at = F.sequence(F.lit(1), F.length("_part") - (GRAM - 1))
    long = needles.where(F.length("_part") >= GRAM).select("needle", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("_part", i, F.lit(GRAM))))).alias("gram"))
    counts = table.join(materialize(long.select("gram").distinct(), "runs"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_n"))
    # a run that stands nowhere has the least count, 0, and its needle finds nothing
    rarest = long.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("_k"))
    found = rarest.where("_k.n > 0").select("needle", F.col("_k.gram").alias("gram"))
    short = needles.where((F.length("_part") > 0) & (F.length("_part") < GRAM))
    beginnings = short.select(F.col("_part").alias("_begin")).distinct()
    known = table.select("gram").distinct().withColumn("_begin", F.explode(F.array(*[F.substring("gram", 1, n) for n in range(1, GRAM)]))).join(beginnings, "_begin", "left_semi").distinct()
    found = found.unionByName(short.join(known, short["_part"] == known["_begin"]).select("needle", "gram"))
    found = found.unionByName(needles.where("_part = ''").select("needle", F.lit("").alias("gram")))
    return asked.select("query", "needle"), materialize(found.distinct(), "keys")


def _matches(queries: DataFrame, facts: DataFrame, own: list[Column], shared: list[Column], table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of which some text holds a needle, with that ``needle``, and ``query, needle`` as asked.

    ``table``: the stored ``postings`` of the facts; made here when there are
    none. Needles and postings meet by run; the postings of one run lie over
    several tasks. What they name is then compared in full: by a file's row
    when a shared text holds the needle, by a fact's own row when only an own
    one does, so no fact comes twice; the empty run is a file's alone.
    """
    table = materialize(postings(facts, own, shared), "postings") if table is None else table
    asked, keys = _keys(queries, table)
    salt = lambda: F.pmod(F.xxhash64("relative_path", "id"), F.lit(SPREAD))
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    named = table.withColumn("_salt", salt()).join(spread, ["gram", "_salt"]).select("needle", (F.col("gram") == "").alias("_all"), "repository_id", "relative_path", "id").distinct()
    named = materialize(named.select("needle", "_all", F.col("repository_id").alias("_r"), F.col("relative_path").alias("_p"), F.col("id").alias("_i")), "named")
    holds = lambda texts: reduce(lambda a, b: a | b, [F.like(F.lower(F.coalesce(t, F.lit(""))), like_pattern(F.col("needle"))) for t in texts])
    columns = [F.col(f"`{c}`") for c in facts.columns]
    by_file = facts.join(named.where("_i is null"), (F.col("repository_id") == F.col("_r")) & (_file() == F.col("_p"))).where((holds(shared) | (F.col("_all") & holds(own))) if own else holds(shared))
    if not own:
        return by_file.select(*columns, "needle"), asked
    by_id = facts.join(named.where("_i is not null"), (F.col("repository_id") == F.col("_r")) & (F.col("id").cast("string") == F.col("_i"))).where(holds(own) & ~holds(shared))
    return by_file.select(*columns, "needle").unionByName(by_id.select(*columns, "needle")), asked


def _top(found: tuple[DataFrame, DataFrame], order: list, most: int = RESULTS) -> DataFrame:
    """The first facts of each needle, for every query that asks for it."""
    rows, asked = found
    place = F.row_number().over(W.partitionBy("needle").orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most).join(asked, "needle")


def _endpoint_texts() -> tuple[list[Column], list[Column]]:
    return [F.col(c) for c in ("path", "http_method", "method_name", "controller")], [F.col("relative_path")]


def _callable_texts() -> tuple[list[Column], list[Column]]:
    # name and signature together hold each of them
    return [F.concat("simple_name", F.coalesce("signature", F.lit(""))), F.col("qualified_name")], [F.col("relative_path")]


def _file_texts() -> tuple[list[Column], list[Column]]:
    return [], [F.col("relative_path"), F.col("package_name")]


def _callables(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("FUNCTION", "METHOD", "CONSTRUCTOR"))


def endpoint_postings(endpoints: DataFrame) -> DataFrame:
    return postings(endpoints, *_endpoint_texts())


def callable_postings(symbols: DataFrame) -> DataFrame:
    return postings(_callables(symbols), *_callable_texts())


def source_file_postings(files: DataFrame) -> DataFrame:
    return postings(files, *_file_texts())


def search_endpoints(queries: DataFrame, endpoints: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``endpoints``: repository_id, id, http_method, path, method_name, controller, relative_path. Exact paths come first.

    ``table``: stored ``endpoint_postings``.
    """
    found = _matches(queries, endpoints, *_endpoint_texts(), table)
    return _top(found, [(F.lower("path") != F.col("needle")).cast("int"), "path", "http_method", "id"]).select("query", "place", "id", "http_method", "path")


def search_callables(queries: DataFrame, symbols: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Functions, methods and constructors by name, signature, qualified name or file. Exact names come first.

    ``table``: stored ``callable_postings``.
    """
    found = _matches(queries, _callables(symbols), *_callable_texts(), table)
    return _top(found, [(F.lower("simple_name") != F.col("needle")).cast("int"), "qualified_name", "start_line", "id"]).select("query", "place", "id", "simple_name", "qualified_name")


def search_files(queries: DataFrame, files: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Files by path or package: exact path, then beginning, then the rest. ``table``: stored ``source_file_postings``."""
    found = _matches(queries, files, *_file_texts(), table)
    low = F.lower("relative_path")
    rank = F.when(low == F.col("needle"), 0).when(low.startswith(F.col("needle")), 1).otherwise(2)
    detail = F.coalesce(F.nullif("package_name", F.lit("")), F.nullif("module_name", F.lit("")), F.col("source_set"))
    rows = found[0].withColumn("_rank", rank), found[1]
    return _top(rows, ["_rank", "relative_path", "repository_id"]).select("query", "place", "repository_id", "relative_path", detail.alias("detail"))


def list_endpoints(endpoints: DataFrame, search: str = "", most: int = ENDPOINTS) -> DataFrame:
    """The first endpoints of each repository by controller, path and method."""
    needle = search.strip().lower()
    found = endpoints
    if needle:
        found = found.where(F.lower("path").like(f"%{needle}%") | F.lower("controller").like(f"%{needle}%"))
    place = F.row_number().over(W.partitionBy("repository_id").orderBy("controller", "path", "http_method", "id"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def lines_of(content: Column) -> Column:
    """Lines of a text; an end of line at its end opens no further one."""
    lines = F.split(content, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def source_excerpts(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Lines ``start_line``..``end_line`` of files, or why there are none.

    Ranges of one part of a file are asked for together, each different one
    once, so that a text is split once for all of them, however many ask.
    """
    place = ["repository_id", "relative_path", "start_line", "end_line"]
    part = lambda c: F.floor(F.col(c) / RANGE_LINES)
    asked = ranges.select(*place).distinct()
    together = asked.groupBy("repository_id", "relative_path", part("start_line").alias("_a"), part("end_line").alias("_b")).agg(F.collect_list(F.struct("start_line", "end_line")).alias("_ranges"))
    held = files.select("repository_id", "relative_path", lines_of(F.col("content")).alias("_lines"))
    joined = together.join(held, ["repository_id", "relative_path"], "left")

    def answer(r: Column) -> Column:
        start, end = r["start_line"], r["end_line"]
        status = (
            F.when(F.col("_lines").isNull(), "NO_FILE").when((start < 1) | (end < start) | (end > F.size("_lines")), "BAD_RANGE")
            .when(end - start + 1 > EXCERPT_LINES, "TOO_LONG").otherwise("OK")
        )
        lines = F.slice("_lines", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
        return F.struct(start.alias("_start"), end.alias("_end"), status.alias("status"), F.when(status == "OK", F.array_join(lines, "\n")).alias("excerpt"))

    told = joined.select(F.col("repository_id").alias("_r"), F.col("relative_path").alias("_p"), F.explode(F.transform("_ranges", answer)).alias("_x")).select("_r", "_p", "_x.*")
    same = (F.col("repository_id") == F.col("_r")) & (F.col("relative_path") == F.col("_p")) & F.col("start_line").eqNullSafe(F.col("_start")) & F.col("end_line").eqNullSafe(F.col("_end"))
    return ranges.join(told, same, "left").select(*ranges.columns, F.coalesce("status", F.lit("NO_FILE")).alias("status"), "excerpt")


def clamp_range(start: Column, end: Column, lines: int = 120) -> Column:
    """The end of a symbol's excerpt in a viewer."""
    return F.least(end, start + lines - 1)


def stale_sources(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose content is not the indexed one any more."""
    now = files.select("repository_id", "relative_path", F.sha2(F.col("content").cast("binary"), 256).alias("current_hash"))
    return now.join(index.select("repository_id", "relative_path", "content_hash"), ["repository_id", "relative_path"]).where("current_hash <> content_hash")


def list_repositories(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories with their number of files, newest first."""
    n = files.groupBy("repository_id").agg(F.count("*").alias("files"))
    return repositories.join(n, "repository_id", "left").fillna(0, ["files"]).orderBy(F.desc("created_at"), "repository_id")
