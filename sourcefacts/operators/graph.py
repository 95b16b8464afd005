"""Nodes, adjacency and result documents of the code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import confidence_label, node_kind

#: Edge kinds that a forward walk and a reverse walk follow.
FORWARD_KINDS = ("CALLS", "READS_ENTITY", "WRITES_ENTITY", "MANAGES_ENTITY")
REVERSE_KINDS = ("CALLS", "TESTS", "IMPLEMENTS", "REFERENCES")
ENTITY_KINDS = ("READS_ENTITY", "WRITES_ENTITY", "MANAGES_ENTITY")
UNCERTAIN = 0.70


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """A node for each symbol: label, place, roles of its parent or else its own, and kind."""
    owner = symbols.select(F.col("repository_id").alias("_r"), F.col("id").alias("_p"), F.col("roles").alias("_roles"))
    joined = symbols.join(owner, (F.col("repository_id") == F.col("_r")) & (F.coalesce("parent_id", "id") == F.col("_p")), "left")
    roles = F.array_sort(F.array_distinct(F.coalesce("_roles", F.array().cast("array<string>"))))
    return joined.select(
        "repository_id", F.col("id").alias("node_id"), node_kind(F.col("kind"), roles).alias("node_kind"), F.concat("simple_name", F.coalesce("signature", F.lit(""))).alias("label"),
        F.col("qualified_name").alias("subtitle"), "relative_path", "start_line", "end_line", F.array_join(roles, ",").alias("roles"),
    )


def traversable(edges: DataFrame, kinds: tuple[str, ...], include_uncertain: bool = True) -> DataFrame:
    kept = edges.where(F.col("kind").isin(*kinds))
    return kept if include_uncertain else kept.where(F.col("confidence") >= UNCERTAIN)


def ranked_edges(edges: DataFrame, node: str, most: int | None = None) -> DataFrame:
    """Adds ``edge_rank``, the place of an edge among those of its node: by
    confidence, kind, line, column and id. With ``most``, later ones go."""
    order = W.partitionBy("repository_id", node).orderBy(F.desc("confidence"), "kind", "line", "column", "id")
    ranked = edges.withColumn("edge_rank", F.row_number().over(order).cast("long"))
    return ranked if most is None else ranked.where(F.col("edge_rank") <= most)


def endpoint_roots(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """Endpoints with their handler method, its type and file."""
    handler = symbols.select("repository_id", F.col("id").alias("method_id"), F.col("parent_id").alias("_owner"), F.col("simple_name").alias("handler"), F.col("relative_path").alias("path_of_source"), "start_line", "end_line")
    owner = symbols.select("repository_id", F.col("id").alias("_owner"), F.col("qualified_name").alias("controller"))
    return endpoints.select("repository_id", F.col("id").alias("endpoint_id"), "method_id", "http_method", "path").join(handler, ["repository_id", "method_id"]).join(owner, ["repository_id", "_owner"]).drop("_owner")


def endpoint_nodes(roots: DataFrame) -> DataFrame:
    """The endpoint's own node and its edge to the handler."""
    return roots.select(
        "repository_id", F.col("endpoint_id").alias("root"), F.concat(F.lit("endpoint:"), "endpoint_id").alias("node_id"), F.concat_ws(" ", "http_method", "path").alias("label"),
        F.concat_ws(".", "controller", "handler").alias("subtitle"), F.concat(F.lit("handles:"), "endpoint_id").alias("edge_id"), F.col("method_id").alias("target_id"),
        F.lit("HANDLES_ENDPOINT").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("EXACT").alias("confidence_label"), F.lit("SPRING_MAPPING").alias("resolution_method"),
    )


def file_graphs(symbols: DataFrame, node_limit: int = 100, edge_limit: int = 250) -> DataFrame:
    """The callables that each file declares, in order of their lines, up to the limits."""
    most = min(node_limit - 1, edge_limit)
    reason = "NODE_LIMIT" if node_limit - 1 <= edge_limit else "EDGE_LIMIT"
    file = W.partitionBy("repository_id", "relative_path")
    declared = symbols.where(F.col("kind").isin("METHOD", "CONSTRUCTOR", "FUNCTION"))
    ranked = declared.withColumn("seq", F.row_number().over(file.orderBy("start_line", "id")).cast("long")).withColumn("declared", F.count("*").over(file))
    return ranked.where(F.col("seq") <= most).select(
        "repository_id", "relative_path", F.col("id").alias("node_id"), "seq", F.lit("DECLARES").alias("kind"), (F.col("declared") > most).alias("truncated"),
        F.when(F.col("declared") > most, reason).alias("reason"),
    )


def unresolved_counts(nodes: DataFrame, unresolved: DataFrame) -> DataFrame:
    """For each graph, the unresolved calls of its symbol nodes. ``nodes``: root, repository_id, node_id."""
    per_source = unresolved.groupBy("repository_id", F.col("source_id").alias("node_id")).agg(F.count("*").alias("n"))
    counted = nodes.select("root", "repository_id", "node_id").distinct().join(per_source, ["repository_id", "node_id"]).groupBy("root", "repository_id").agg(F.sum("n").alias("unresolved"))
    return counted.withColumn("warning", F.concat(F.col("unresolved").cast("string"), F.lit(" call expression(s) could not be resolved.")))


def truncation_warning(reason: Column, what: str = "Graph") -> Column:
    return F.when(reason.isNotNull(), F.concat(F.lit(f"{what} stopped at the configured "), F.replace(F.lower(reason), F.lit("_"), F.lit(" ")), F.lit(".")))


def assemble_graphs(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """One row for each root with its nodes and edges in visit order.

    The limits of a walk bound the arrays.
    """
    in_order = lambda df, cols: df.groupBy("root", "repository_id").agg(F.array_sort(F.collect_list(F.struct("seq", *cols))).alias("items"))
    n = in_order(nodes, ["node_id", "depth"]).withColumnRenamed("items", "nodes")
    e = in_order(edges, ["edge_id", "source_id", "target_id", "kind"]).withColumnRenamed("items", "edges")
    return n.join(e, ["root", "repository_id"], "left").join(done, ["root", "repository_id"], "left").withColumn("truncated", F.col("reason").isNotNull())


def edges_touching(edges: DataFrame) -> DataFrame:
    """How many edges in view touch each node of a graph; a self loop counts once."""
    ends = edges.select("root", "repository_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"))
    return ends.groupBy("root", "repository_id", "node_id").agg(F.count("*").alias("edges"))


def labelled(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence_label", confidence_label(F.col("confidence")))
