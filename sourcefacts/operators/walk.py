"""Breadth-first walks of all roots at once.

The state of a walk is (root, node); a level is a join of the frontier with
the adjacency, and the driver's loop has at most eight levels. Every level is
written to the shared folder, so the plan stays short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import materialize
from .graph import ENTITY_KINDS, ranked_edges, traversable

MAX_DEPTH = 8
NODE_LIMIT, EDGE_LIMIT, EXTERNAL_LIMIT = 100, 250, 20
#: More than the steps that a level can number (they are counted in 32 bits), so that
#: the places of two levels are never mixed.
LEVEL = 1 << 32


def _depth(max_depth: int) -> None:
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 1 and {MAX_DEPTH}")


def reach(roots: DataFrame, edges: DataFrame, max_depth: int, stop: DataFrame | None = None) -> DataFrame:
    """``root, repository_id, node_id, depth``: least depth of all nodes in reach.

    ``roots``: root, repository_id, node_id. ``edges``: repository_id,
    from_id, to_id. Nodes of ``stop`` (repository_id, node_id) are reached but
    not gone on from; roots always are gone on from.
    """
    _depth(max_depth)
    adjacency = materialize(edges.select("repository_id", F.col("from_id").alias("node_id"), F.col("to_id").alias("_to")).distinct(), "adjacency")
    found = materialize(roots.select("root", "repository_id", "node_id").distinct().withColumn("depth", F.lit(0)), "reached")
    parts, frontier = [found], found
    for depth in range(1, max_depth + 1):
        step = frontier.join(adjacency, ["repository_id", "node_id"]).select("root", "repository_id", F.col("_to").alias("node_id")).distinct()
        seen = reduce(DataFrame.unionByName, parts).select("root", "repository_id", "node_id")
        new = materialize(step.join(seen, ["root", "repository_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if new.isEmpty():
            break
        parts.append(new)
        frontier = new if stop is None else new.join(stop.select("repository_id", "node_id").distinct(), ["repository_id", "node_id"], "left_anti")
    return reduce(DataFrame.unionByName, parts)


def within_budget(frontier: DataFrame, degrees: DataFrame, node: str, totals: DataFrame, edge_limit: int) -> DataFrame:
    """The frontier rows of each root that its remaining edges can reach, before they meet the adjacency.

    ``degrees``: repository_id, ``node`` and ``degree``, its edges, of which
    each counts, as a node is gone on from once. In visit order (``o1``) the
    rows stay as long as the edges of those before them leave room for one
    more, or for the first that there is no room for. So a root's level has
    ``edge_limit`` steps and those of one node more at most. Rows without
    edges go.
    """
    before = W.partitionBy("root", "repository_id").orderBy("o1").rangeBetween(W.unboundedPreceding, -1)
    left = totals.where("not done").select("root", "repository_id", (F.lit(edge_limit) - F.col("n_edges")).alias("_left"))
    told = frontier.join(degrees, ["repository_id", node]).withColumn("_before", F.coalesce(F.sum("degree").over(before), F.lit(0)))
    return told.join(left, ["root", "repository_id"]).where(F.col("_before") <= F.col("_left")).select(*frontier.columns)


def _placed(steps: DataFrame, nodes: DataFrame, edges: DataFrame, totals: DataFrame, node_limit: int, edge_limit: int) -> DataFrame:
    """Applies the limits to one level of steps, in visit order.

    ``steps``: root, repository_id, o1, o2, o3 (their order), node_id, edge_id
    and edge_first (which limit is told when both are reached). Steps from the
    first breach on are marked with its reason in ``_reason``.
    """
    root = W.partitionBy("root", "repository_id")
    in_order = root.orderBy("o1", "o2", "o3", "edge_id", "node_id")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    known = nodes.select("root", "repository_id", "node_id").distinct().withColumn("_known", F.lit(True))
    known_edges = edges.select("root", "repository_id", "edge_id").distinct().withColumn("_held", F.lit(True))
    first = lambda col: F.row_number().over(W.partitionBy("root", "repository_id", col).orderBy("o1", "o2", "o3", "edge_id", "node_id")) == 1
    out = (
        steps.join(totals.where("not done").select("root", "repository_id", "n_nodes", "n_edges"), ["root", "repository_id"])
        .join(known, ["root", "repository_id", "node_id"], "left").join(known_edges, ["root", "repository_id", "edge_id"], "left")
        .withColumn("seq", F.row_number().over(in_order).cast("long"))
        .withColumn("is_new", F.col("_known").isNull() & first("node_id"))
        .withColumn("edge_new", F.col("_held").isNull() & first("edge_id"))
        .withColumn("_n", F.col("n_nodes") + F.coalesce(F.sum(F.col("is_new").cast("long")).over(before), F.lit(0)))
        .withColumn("_e", F.col("n_edges") + F.coalesce(F.sum(F.col("edge_new").cast("long")).over(before), F.lit(0)))
    )
    node_full, edge_full = F.col("is_new") & (F.col("_n") >= node_limit), F.col("edge_new") & (F.col("_e") >= edge_limit)
    reason = F.when(F.col("edge_first") & edge_full, "EDGE_LIMIT").when(node_full, "NODE_LIMIT").when(edge_full, "EDGE_LIMIT")
    out = out.withColumn("_why", reason).withColumn("_stop", F.min(F.when(F.col("_why").isNotNull(), F.col("seq"))).over(root))
    return out.withColumn("_reason", F.when(F.col("seq") == F.col("_stop"), F.col("_why"))).drop("_known", "_held", "n_nodes", "n_edges", "_n", "_e", "_why")


class Walk:
    """Nodes and edges of bounded graphs so far; each level is one table of steps."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, node_limit: int, edge_limit: int):
        self.node_limit, self.edge_limit = max(2, node_limit), max(1, edge_limit)
        self.nodes, self.edges = [nodes], [edges]
        self.reasons: list[DataFrame] = []

    def all_nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.nodes)

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.edges)

    def all_reasons(self) -> DataFrame:
        """``root, repository_id, reason`` of the graphs that were cut."""
        if not self.reasons:
            return self.nodes[0].select("root", "repository_id").where("false").withColumn("reason", F.lit(None).cast("string"))
        return reduce(DataFrame.unionByName, self.reasons)

    def totals(self) -> DataFrame:
        """``root, repository_id, n_nodes, n_edges, reason, done`` so far."""
        nodes, edges = self.all_nodes(), self.all_edges()
        return (
            nodes.groupBy("root", "repository_id").agg(F.count("*").alias("n_nodes"))
            .join(edges.groupBy("root", "repository_id").agg(F.count("*").alias("n_edges")), ["root", "repository_id"], "left").fillna(0, ["n_edges"])
            .join(self.all_reasons(), ["root", "repository_id"], "left").withColumn("done", F.col("reason").isNotNull())
        )

    def take(self, steps: DataFrame, depth: int, totals: DataFrame | None = None) -> DataFrame:
        """Applies the limits and keeps what is before them; the kept steps come back."""
        nodes, edges = self.all_nodes(), self.all_edges()
        totals = self.totals() if totals is None else totals
        placed = materialize(_placed(steps, nodes, edges, totals, self.node_limit, self.edge_limit), "level")
        kept = placed.where("_stop is null or seq < _stop")
        self.nodes.append(kept.where("is_new").select("root", "repository_id", "node_id", F.lit(depth).alias("depth"), (F.lit(depth * LEVEL).cast("long") + F.col("seq")).alias("seq")))
        self.edges.append(kept.where("edge_new").select("root", "repository_id", "edge_id", "source_id", "target_id", "kind", (F.lit(depth * LEVEL).cast("long") + F.col("seq")).alias("seq")))
        self.reasons.append(placed.where("_reason is not null").select("root", "repository_id", F.col("_reason").alias("reason")))
        return kept


NODE = ["root", "repository_id", "node_id", "depth", "seq"]
EDGE = ["root", "repository_id", "edge_id", "source_id", "target_id", "kind", "seq"]


def _start(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = roots.select("root", "repository_id", "node_id").distinct().withColumn("depth", F.lit(0)).withColumn("seq", F.lit(0).cast("long"))
    edges = nodes.where("false").select("root", "repository_id", F.lit("").alias("edge_id"), F.lit("").alias("source_id"), F.lit("").alias("target_id"), F.lit("").alias("kind"), "seq")
    return nodes, edges


def forward_walk(roots: DataFrame, edges: DataFrame, max_depth: int = 4, node_limit: int = NODE_LIMIT, edge_limit: int = EDGE_LIMIT, externals: DataFrame | None = None, before: tuple[DataFrame, DataFrame] | None = None) -> Walk:
    """What each root depends on, within the limits, in visit order.

    ``edges``: traversable edges with repository_id, id, source_id, target_id,
    kind, confidence, line and column. ``externals`` (repository_id,
    source_id, id, line) become leaves, at most 20 for a node, after the
    node's own edges. ``before``: nodes and edges that are there already, such
    as an endpoint's own.
    """
    _depth(max_depth)
    start_nodes, start_edges = _start(roots)
    if before is not None:
        start_nodes, start_edges = before[0].select(*NODE).unionByName(start_nodes), start_edges.unionByName(before[1].select(*EDGE))
    walk = Walk(materialize(start_nodes, "start"), materialize(start_edges, "start"), node_limit, edge_limit)
    # more edges of one node than the limit can't be taken
    adjacency = materialize(ranked_edges(edges, "source_id", walk.edge_limit + 1).select("repository_id", "source_id", "target_id", "id", "kind", "edge_rank"), "adjacency")
    leaves = None
    if externals is not None:
        rank = F.row_number().over(W.partitionBy("repository_id", "source_id").orderBy("line", "id"))
        leaves = materialize(externals.withColumn("edge_rank", rank.cast("long")).where(F.col("edge_rank") <= EXTERNAL_LIMIT).select("repository_id", "source_id", "id", "edge_rank"), "leaves")
    frontier = materialize(roots.select("root", "repository_id", F.col("node_id").alias("source_id")).distinct().withColumn("o1", F.lit(0).cast("long")), "frontier")
    counted = adjacency.select("repository_id", "source_id") if leaves is None else adjacency.select("repository_id", "source_id").unionByName(leaves.select("repository_id", "source_id"))
    degrees = materialize(counted.groupBy("repository_id", "source_id").agg(F.count("*").alias("degree")), "degrees")
    for depth in range(1, max_depth + 1):
        totals = materialize(walk.totals(), "totals")
        frontier = within_budget(frontier, degrees, "source_id", totals, walk.edge_limit)
        if leaves is not None:
            frontier = materialize(frontier, "frontier")
        steps = frontier.join(adjacency, ["repository_id", "source_id"]).select(
            "root", "repository_id", "o1", F.lit(0).alias("o2"), F.col("edge_rank").alias("o3"), F.col("target_id").alias("node_id"), F.col("id").alias("edge_id"), "source_id", "target_id", "kind", F.lit(True).alias("edge_first"),
        )
        if leaves is not None:
            leaf = F.concat(F.lit("external:"), F.col("id"))
            steps = steps.unionByName(frontier.join(leaves, ["repository_id", "source_id"]).select(
                "root", "repository_id", "o1", F.lit(1).alias("o2"), F.col("edge_rank").alias("o3"), leaf.alias("node_id"), F.concat(F.lit("external-edge:"), F.col("id")).alias("edge_id"),
                "source_id", leaf.alias("target_id"), F.lit("CALLS").alias("kind"), F.lit(False).alias("edge_first"),
            ))
        kept = walk.take(steps, depth, totals)
        cut = walk.reasons[-1]
        frontier = kept.where("is_new and o2 = 0").join(cut, ["root", "repository_id"], "left_anti").select("root", "repository_id", F.col("node_id").alias("source_id"), F.col("seq").alias("o1"))
        if frontier.isEmpty():
            break
    return walk


def blast_radius(roots: DataFrame, edges: DataFrame, endpoints: DataFrame, test_nodes: DataFrame, max_depth: int = 4, node_limit: int = NODE_LIMIT, edge_limit: int = EDGE_LIMIT, entity_edges: DataFrame | None = None) -> Walk:
    """What depends on each root, and which endpoints reach it, within the limits.

    ``edges``: traversable edges against their direction. ``endpoints``:
    repository_id, endpoint_id, method_id, http_method, path. Test nodes
    (repository_id, node_id) are shown but not gone on from. ``entity_edges``:
    the roots' own accesses, shown first whatever their confidence.
    """
    _depth(max_depth)
    nodes, none = _start(roots)
    walk = Walk(materialize(nodes, "start"), materialize(none, "start"), node_limit, edge_limit)
    # of one method's endpoints, too, no more than the limit can be taken
    handled = endpoints.withColumn("_rank", F.row_number().over(W.partitionBy("repository_id", "method_id").orderBy("http_method", "path", "endpoint_id")).cast("long"))
    handled = materialize(handled.where(F.col("_rank") <= walk.edge_limit + 1).select("repository_id", F.col("method_id").alias("source_id"), "endpoint_id", "_rank"), "endpoints")

    def reaching(sources: DataFrame) -> DataFrame:
        """Steps to the endpoints that the sources handle. ``sources``: root, repository_id, source_id, o1, o2."""
        name = F.concat(F.lit("endpoint:"), F.col("endpoint_id"))
        return sources.join(handled, ["repository_id", "source_id"]).select(
            "root", "repository_id", "o1", "o2", F.col("_rank").alias("o3"), name.alias("node_id"), F.concat(F.lit("affected:"), F.col("endpoint_id")).alias("edge_id"),
            name.alias("source_id"), F.col("source_id").alias("target_id"), F.lit("REACHES").alias("kind"), F.lit(False).alias("edge_first"),
        )

    own = roots.select("root", "repository_id", F.col("node_id").alias("source_id")).distinct()
    first = reaching(own.withColumn("o1", F.lit(0).cast("long")).withColumn("o2", F.lit(0).cast("long")))
    if entity_edges is not None:
        ranked = ranked_edges(entity_edges, "source_id", walk.edge_limit + 1)
        first = first.unionByName(own.join(ranked, ["repository_id", "source_id"]).select(
            "root", "repository_id", F.lit(1).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.col("edge_rank").alias("o3"), F.col("target_id").alias("node_id"), F.col("id").alias("edge_id"),
            "source_id", "target_id", "kind", F.lit(False).alias("edge_first"),
        ))
    walk.take(first, 0)
    incoming = materialize(ranked_edges(edges, "target_id", walk.edge_limit + 1).select("repository_id", "source_id", "target_id", "id", "kind", "edge_rank"), "incoming")
    frontier = materialize(own.select("root", "repository_id", F.col("source_id").alias("target_id")).join(walk.reasons[-1], ["root", "repository_id"], "left_anti").withColumn("o1", F.lit(0).cast("long")), "frontier")
    degrees = materialize(incoming.groupBy("repository_id", "target_id").agg(F.count("*").alias("degree")), "degrees")
    for depth in range(1, max_depth + 1):
        totals = materialize(walk.totals(), "totals")
        level = within_budget(frontier, degrees, "target_id", totals, walk.edge_limit).join(incoming, ["repository_id", "target_id"])
        back = level.select(
            "root", "repository_id", "o1", F.col("edge_rank").alias("o2"), F.lit(0).cast("long").alias("o3"), F.col("source_id").alias("node_id"), F.col("id").alias("edge_id"), "source_id", "target_id", "kind", F.lit(False).alias("edge_first"),
        )
        kept = walk.take(back.unionByName(reaching(level.select("root", "repository_id", "source_id", "o1", F.col("edge_rank").alias("o2")))), depth, totals)
        frontier = (
            kept.where("is_new and o3 = 0").join(walk.reasons[-1], ["root", "repository_id"], "left_anti").join(test_nodes.select("repository_id", "node_id").distinct(), ["repository_id", "node_id"], "left_anti")
            .select("root", "repository_id", F.col("node_id").alias("target_id"), F.col("seq").alias("o1"))
        )
        if frontier.isEmpty():
            break
    return walk


def root_entity_edges(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots' own accesses to entities, whatever their confidence."""
    own = roots.select("root", "repository_id", F.col("node_id").alias("source_id")).distinct()
    return own.join(traversable(edges, ENTITY_KINDS), ["repository_id", "source_id"])


def affected_endpoints(reached: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoints that a reached method handles, once for each root."""
    return reached.join(endpoints.select("repository_id", F.col("method_id").alias("node_id"), "endpoint_id"), ["repository_id", "node_id"]).select("root", "repository_id", "endpoint_id", F.concat(F.lit("affected:"), "endpoint_id").alias("edge_id")).distinct()
