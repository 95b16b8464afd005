"""Registered queries on graphs, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import graph as G, walk as X
from .proxy import fact, oracle
from .resolve_queries import symbols

DEPTH = 4
#: Limits of nodes and edges that many graphs of the tables reach.
CUT = (8, 12)


def forward(spark, sf_dir):
    return G.traversable(fact(spark, sf_dir, "edges"), G.FORWARD_KINDS)


def reverse(spark, sf_dir):
    return G.traversable(fact(spark, sf_dir, "edges"), G.REVERSE_KINDS, include_uncertain=False)


def type_roots(spark, sf_dir):
    return fact(spark, sf_dir, "types").select(F.col("id").alias("root"), "repository_id", F.col("id").alias("node_id"))


def test_nodes(spark, sf_dir):
    return fact(spark, sf_dir, "types").where("role = 'TEST'").select("repository_id", F.col("id").alias("node_id"))


def handlers(spark, sf_dir):
    """Endpoints with the type that handles them as their place in the type graph."""
    return fact(spark, sf_dir, "endpoints").select("repository_id", F.col("id").alias("endpoint_id"), F.col("type_id").alias("method_id"), "http_method", "path")


def externals(spark, sf_dir):
    other = fact(spark, sf_dir, "raw_calls").where("scope_kind = 'OTHER'")
    return other.select("repository_id", F.col("owner_id").alias("source_id"), F.concat_ws("-", "method_id", F.col("column").cast("string"), "callee", F.col("arg_count").cast("string")).alias("id"), F.col("column").alias("line")).distinct()


def _reached_back(spark, sf_dir):
    edges = reverse(spark, sf_dir).select("repository_id", F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"))
    return X.reach(type_roots(spark, sf_dir), edges, DEPTH, test_nodes(spark, sf_dir))


def d1_symbol_nodes(spark, sf_dir):
    return G.symbol_nodes(symbols(spark, sf_dir))


def d2_ranked_edges(spark, sf_dir):
    return G.ranked_edges(fact(spark, sf_dir, "edges"), "source_id").select("repository_id", "source_id", "id", "edge_rank")


def d3_endpoint_roots(spark, sf_dir):
    return G.endpoint_roots(fact(spark, sf_dir, "endpoints"), symbols(spark, sf_dir))


def d4_forward_reach(spark, sf_dir):
    edges = forward(spark, sf_dir).select("repository_id", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    return X.reach(type_roots(spark, sf_dir), edges, DEPTH)


def d5_traversable(spark, sf_dir):
    edges = fact(spark, sf_dir, "edges")
    certain = G.traversable(edges, G.FORWARD_KINDS, include_uncertain=False)
    return G.labelled(certain).select("repository_id", "id", "kind", "confidence_label")


def d6_bound_graph(spark, sf_dir):
    walk = X.forward_walk(type_roots(spark, sf_dir), forward(spark, sf_dir), 1, node_limit=3, edge_limit=2)
    edges = walk.all_edges().groupBy("root", "repository_id").agg(F.count("*").alias("edges"))
    nodes = walk.all_nodes().groupBy("root", "repository_id").agg(F.count("*").alias("nodes"))
    return nodes.join(edges, ["root", "repository_id"], "left").join(walk.all_reasons(), ["root", "repository_id"], "left").select("root", "repository_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "reason")


def d6_bounded_walk(spark, sf_dir):
    """Graphs of several levels that are cut; held against a queue in the tests."""
    return X.forward_walk(type_roots(spark, sf_dir), forward(spark, sf_dir), DEPTH, node_limit=8, edge_limit=12).all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def d7_external_terminals(spark, sf_dir):
    walk = X.forward_walk(type_roots(spark, sf_dir), forward(spark, sf_dir), 1, node_limit=10_000, edge_limit=10_000, externals=externals(spark, sf_dir))
    return walk.all_edges().where("edge_id like 'external-edge:%'").select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def _endpoint_walk(spark, sf_dir, node_limit=X.NODE_LIMIT, edge_limit=X.EDGE_LIMIT):
    roots = handlers(spark, sf_dir)
    name = F.concat(F.lit("endpoint:"), "endpoint_id")
    at = F.lit(0).cast("long")
    nodes = roots.select(F.col("endpoint_id").alias("root"), "repository_id", name.alias("node_id"), F.lit(0).alias("depth"), at.alias("seq"))
    edges = roots.select(F.col("endpoint_id").alias("root"), "repository_id", F.concat(F.lit("handles:"), "endpoint_id").alias("edge_id"), name.alias("source_id"), F.col("method_id").alias("target_id"), F.lit("HANDLES_ENDPOINT").alias("kind"), at.alias("seq"))
    return X.forward_walk(roots.select(F.col("endpoint_id").alias("root"), "repository_id", F.col("method_id").alias("node_id")), forward(spark, sf_dir), DEPTH, node_limit, edge_limit, before=(nodes, edges))


def d8_endpoint_graphs(spark, sf_dir):
    return _endpoint_walk(spark, sf_dir).all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def _symbol_walk(spark, sf_dir):
    return X.forward_walk(type_roots(spark, sf_dir), forward(spark, sf_dir), DEPTH)


def d9_symbol_graphs(spark, sf_dir):
    return _symbol_walk(spark, sf_dir).all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def d10_file_graphs(spark, sf_dir):
    return G.file_graphs(symbols(spark, sf_dir), node_limit=8, edge_limit=7)


def d11_blast_radius(spark, sf_dir):
    return _reached_back(spark, sf_dir)


def _cut_blast_walk(spark, sf_dir):
    """Blast radii within limits that many of them reach."""
    entity = G.traversable(fact(spark, sf_dir, "edges"), G.ENTITY_KINDS)
    return X.blast_radius(type_roots(spark, sf_dir), reverse(spark, sf_dir), handlers(spark, sf_dir), test_nodes(spark, sf_dir), DEPTH, *CUT, entity)


def d11_cut_blast_radius(spark, sf_dir):
    walk = _cut_blast_walk(spark, sf_dir)
    return walk.all_nodes().join(walk.all_reasons(), ["root", "repository_id"], "left").select("root", "repository_id", "node_id", F.col("reason").isNotNull().alias("truncated"), "reason")


def d12_cut_affected_endpoints(spark, sf_dir):
    """Endpoints in the blast radii within limits, in the order in which they are come upon."""
    edges = _cut_blast_walk(spark, sf_dir).all_edges().where("kind = 'REACHES'")
    place = F.row_number().over(W.partitionBy("root", "repository_id").orderBy("seq")).cast("long")
    return edges.select("root", "repository_id", F.expr("substring(source_id, 10)").alias("endpoint_id"), "target_id", place.alias("place"))


def d12_affected_endpoints(spark, sf_dir):
    return X.affected_endpoints(_reached_back(spark, sf_dir), handlers(spark, sf_dir))


def d13_root_entity_edges(spark, sf_dir):
    return X.root_entity_edges(type_roots(spark, sf_dir), fact(spark, sf_dir, "edges")).select("root", "repository_id", "id", "target_id", "kind", "confidence")


def d13_bounded_blast_radius(spark, sf_dir):
    entity = G.traversable(fact(spark, sf_dir, "edges"), G.ENTITY_KINDS)
    walk = X.blast_radius(type_roots(spark, sf_dir), reverse(spark, sf_dir), handlers(spark, sf_dir), test_nodes(spark, sf_dir), DEPTH, 10_000, 10_000, entity)
    return walk.all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def d13_cut_blast_edges(spark, sf_dir):
    return _cut_blast_walk(spark, sf_dir).all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def d14_unresolved_counts(spark, sf_dir):
    unresolved = fact(spark, sf_dir, "raw_calls").where("scope_kind = 'NONE'").select("repository_id", F.col("owner_id").alias("source_id"))
    return G.unresolved_counts(_symbol_walk(spark, sf_dir).all_nodes(), unresolved)


def d15_assemble_graphs(spark, sf_dir):
    walk = _symbol_walk(spark, sf_dir)
    whole = G.assemble_graphs(walk.all_nodes(), walk.all_edges(), walk.all_reasons())
    return whole.select("root", "repository_id", F.size("nodes").cast("long").alias("nodes"), F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("edges"), "truncated", "reason", F.element_at("nodes", 1)["node_id"].alias("first_node"))


def _cut_symbol_walk(spark, sf_dir):
    return X.forward_walk(type_roots(spark, sf_dir), forward(spark, sf_dir), DEPTH, *CUT, externals(spark, sf_dir))


def d8_cut_endpoint_graphs(spark, sf_dir):
    return _endpoint_walk(spark, sf_dir, *CUT).all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def d9_cut_symbol_graphs(spark, sf_dir):
    return _cut_symbol_walk(spark, sf_dir).all_edges().select("root", "repository_id", "edge_id", "source_id", "target_id", "kind")


def d15_cut_graphs(spark, sf_dir):
    """Whole graphs within limits that many of them reach, their nodes in visit order."""
    walk = _cut_symbol_walk(spark, sf_dir)
    whole = G.assemble_graphs(walk.all_nodes(), walk.all_edges(), walk.all_reasons())
    names = lambda items, key: F.array_join(F.transform(items, lambda x: x[key]), ",")
    return whole.select("root", "repository_id", names("nodes", "node_id").alias("nodes"), F.coalesce(names("edges", "edge_id"), F.lit("")).alias("edges"), "truncated", "reason")


def d16_edges_touching(spark, sf_dir):
    return G.edges_touching(_symbol_walk(spark, sf_dir).all_edges())


QUERIES = {k: v for k, v in globals().items() if k[:1] == "d" and k[1:2].isdigit()}

STEPS = {
    "fwd": "select * from edges where kind in ('CALLS', 'READS_ENTITY', 'WRITES_ENTITY', 'MANAGES_ENTITY')",
    "back": "select * from edges where kind in ('CALLS', 'TESTS', 'IMPLEMENTS', 'REFERENCES') and confidence >= 0.7",
    "hops": "select id root, repository_id, id node_id, 0 depth from types union select h.root, h.repository_id, e.target_id, h.depth + 1 from hops h join fwd e on e.repository_id = h.repository_id and e.source_id = h.node_id where h.depth < 4",
    "seen": "select root, repository_id, node_id, min(depth) depth from hops group by 1, 2, 3",
    "tests": "select id test_id from types where role = 'TEST'",
    "steps_back": """select id root, repository_id, id node_id, 0 depth, true open from types union
      select h.root, h.repository_id, e.source_id, h.depth + 1, not exists (select 1 from tests where test_id = e.source_id) from steps_back h join back e on e.repository_id = h.repository_id and e.target_id = h.node_id where h.depth < 4 and h.open""",
    "seen_back": "select root, repository_id, node_id, min(depth) depth, bool_or(open or depth = 0) open from steps_back group by 1, 2, 3",
    "own": "select distinct source_id root, target_id from edges where kind in ('READS_ENTITY', 'WRITES_ENTITY', 'MANAGES_ENTITY')",
    # an entity that the root itself uses is shown from the start and not gone on from
    "steps_shown": """select id root, repository_id, id node_id, 0 depth, true open from types union
      select h.root, h.repository_id, e.source_id, h.depth + 1, t.test_id is null and o.root is null
      from steps_shown h join back e on e.repository_id = h.repository_id and e.target_id = h.node_id left join tests t on t.test_id = e.source_id left join own o on o.root = h.root and o.target_id = e.source_id where h.depth < 4 and h.open""",
    "seen_shown": "select root, repository_id, node_id, min(depth) depth, bool_or(open or depth = 0) open from steps_shown group by 1, 2, 3",
    "eps": "select repository_id, id endpoint_id, type_id, http_method, path from endpoints",
    "symbol_edges": "select s.root, s.repository_id, e.id edge_id, e.source_id, e.target_id, e.kind from seen s join fwd e on e.repository_id = s.repository_id and e.source_id = s.node_id where s.depth < 4",
    "other": """select distinct repository_id, owner_id source_id, concat_ws('-', method_id, cast("column" as varchar), callee, cast(arg_count as varchar)) id, "column" line from raw_calls where scope_kind = 'OTHER'""",
    "ranked": 'select repository_id, source_id, target_id, id, row_number() over (partition by repository_id, source_id order by confidence desc, kind, line, "column", id) edge_rank from edges',
    "first_level": 'select source_id root, repository_id, target_id, row_number() over (partition by repository_id, source_id order by confidence desc, kind, line, "column", id) seq from fwd',
    "fresh": """select *, target_id <> root and row_number() over (partition by root, target_id order by seq) = 1 is_new from first_level""",
    "counted": "select *, seq - 1 e, 1 + count(*) filter (is_new) over (partition by root order by seq rows between unbounded preceding and current row) - is_new::int n from fresh",
    "breach": "select *, case when e >= 2 then 'EDGE_LIMIT' when is_new and n >= 3 then 'NODE_LIMIT' end why from counted",
    "cut": "select root, min(seq) filter (why is not null) stop, arg_min(why, seq) filter (why is not null) reason from breach group by root",
}


def _queue(steps: str, starts: str, node_limit: int, edge_limit: int, edge_first: bool) -> dict[str, str]:
    """A walk as a queue: one step of one root at a time, all roots side by side.

    ``steps``: repository_id, node, no (1, 2, ... of a node), next_id, edge_id,
    source_id, target_id, kind, goes_on. ``starts``: root, repository_id,
    queue (of struct(node, depth)), nodes, edges. A node is taken from the queue when
    all steps of the one before are done; nothing of depth 4 is. A step of a
    null edge has no target.
    """
    new_node, new_edge = "not list_contains(q.nodes, s.next_id)", "not list_contains(q.edges, s.edge_id)"
    node_full, edge_full = f"{new_node} and len(q.nodes) >= {node_limit}", f"{new_edge} and len(q.edges) >= {edge_limit}"
    tests = (("EDGE_LIMIT", edge_full), ("NODE_LIMIT", node_full)) if edge_first else (("NODE_LIMIT", node_full), ("EDGE_LIMIT", edge_full))
    # steps say themselves when the nodes are looked at first, as externals do
    why = "case when s.edge_id is null then null " + (f"when s.nodes_first and {node_full} then 'NODE_LIMIT' " if edge_first else "") + " ".join(f"when {test} then '{name}'" for name, test in tests) + " end"
    moved = f"""
      select q.root, q.repository_id, q.i + 1 i, case when s.edge_id is null then q.pos + 1 else q.pos end pos, case when s.edge_id is null then 1 else q.no + 1 end no,
        case when s.edge_id is not null and {why} is null and {new_node} and s.goes_on then list_append(q.queue, {{'node': s.next_id, 'depth': q.queue[q.pos].depth + 1}}) else q.queue end queue,
        case when s.edge_id is not null and {why} is null and {new_node} then list_append(q.nodes, s.next_id) else q.nodes end nodes,
        case when s.edge_id is not null and {why} is null and {new_edge} then list_append(q.edges, s.edge_id) else q.edges end edges, {why} reason
      from walked q left join numbered s on s.repository_id = q.repository_id and s.node = q.queue[q.pos].node and s.no = q.no
      where q.reason is null and q.pos <= len(q.queue) and q.queue[q.pos].depth < 4"""
    return {
        "numbered": steps, "walked": f"select root, repository_id, 0 i, 1 pos, 1 no, queue, nodes, edges, cast(null as varchar) reason from ({starts}) union all {moved}",
        "ended": "select root, repository_id, max_by(nodes, i) nodes, max_by(edges, i) edges, max_by(reason, i) reason from walked group by root, repository_id",
    }


_RANK = 'row_number() over (partition by repository_id, {} order by confidence desc, kind, line, "column", id)'
_EMPTY = "cast([] as varchar[])"
_AHEAD = f"""select repository_id, source_id node, row_number() over (partition by repository_id, source_id order by external, rank) no, next_id, edge_id, source_id, target_id, kind, not external goes_on, external nodes_first from (
    select repository_id, source_id, false external, {_RANK.format('source_id')} rank, target_id next_id, id edge_id, target_id, kind from fwd
    {{}}) x"""
_LEAVES = """union all select * from (select repository_id, source_id, true, row_number() over (partition by repository_id, source_id order by line, id) rank, 'external:' || id, 'external-edge:' || id, 'external:' || id, 'CALLS' from other) y where rank <= 20"""
_TYPE_STARTS = f"select id root, repository_id, [{{'node': id, 'depth': 0}}] queue, [id] nodes, {_EMPTY} edges from types"
#: Of the endpoints of a method those first that a walk comes upon first.
_HANDLED = "select repository_id, type_id, endpoint_id, row_number() over (partition by repository_id, type_id order by http_method, path, endpoint_id) rank from eps"
_BEHIND = f"""select repository_id, node, row_number() over (partition by repository_id, node order by o0, o1, o2) no, next_id, edge_id, source_id, target_id, kind, goes_on from (
    select b.repository_id, b.target_id node, 0 o0, b.rank o1, 0 o2, b.source_id next_id, b.id edge_id, b.source_id, b.target_id, b.kind, t.test_id is null goes_on from back_ranked b left join tests t on t.test_id = b.source_id
    union all select b.repository_id, b.target_id, 0, b.rank, h.rank, 'endpoint:' || h.endpoint_id, 'affected:' || h.endpoint_id, 'endpoint:' || h.endpoint_id, b.source_id, 'REACHES', false
      from back_ranked b join handled h on h.repository_id = b.repository_id and h.type_id = b.source_id
    union all select repository_id, 'first ' || type_id, 0, rank, 0, 'endpoint:' || endpoint_id, 'affected:' || endpoint_id, 'endpoint:' || endpoint_id, type_id, 'REACHES', false from handled
    union all select repository_id, 'first ' || source_id, 1, {_RANK.format('source_id')}, 0, target_id, id, source_id, target_id, kind, false from edges where kind in ('READS_ENTITY', 'WRITES_ENTITY', 'MANAGES_ENTITY')) x"""
_BACK_STARTS = f"select id root, repository_id, [{{'node': 'first ' || id, 'depth': -1}}, {{'node': id, 'depth': 0}}] queue, [id] nodes, {_EMPTY} edges from types"
_ENDPOINT_STARTS = """select endpoint_id root, repository_id, [{'node': type_id, 'depth': 0}] queue, ['endpoint:' || endpoint_id, type_id] nodes, ['handles:' || endpoint_id] edges from eps"""
_MORE = {"back_ranked": f"select *, {_RANK.format('target_id')} rank from back", "handled": _HANDLED}
AHEAD = STEPS | _queue(_AHEAD.format(_LEAVES), _TYPE_STARTS, *CUT, True)
PLAIN = STEPS | _queue(_AHEAD.format(""), _TYPE_STARTS, *CUT, True)
FROM_ENDPOINTS = STEPS | _queue(_AHEAD.format(""), _ENDPOINT_STARTS, *CUT, True)
BEHIND = STEPS | _MORE | _queue(_BEHIND, _BACK_STARTS, *CUT, False)


def _edges_of(more: str = "") -> str:
    return f"""select w.root, w.repository_id, e.edge_id, s.source_id, s.target_id, s.kind from (select root, repository_id, unnest(edges) edge_id from ended) e
      join ended w on w.root = e.root and w.repository_id = e.repository_id join (select distinct edge_id, source_id, target_id, kind from numbered {more}) s on s.edge_id = e.edge_id"""


_GRAPH_EDGE = "root, repository_id, edge_id, source_id, target_id, kind"
ORACLES = {
    "d1_symbol_nodes": oracle("""select s.repository_id, s.id node_id,
        case coalesce(p.role, case when s.parent_id is null then s.role end) when 'CONTROLLER' then 'CONTROLLER' when 'SERVICE' then 'SERVICE' when 'REPOSITORY' then 'REPOSITORY' when 'ENTITY' then 'ENTITY' when 'TEST' then 'TEST' when 'COMPONENT' then 'COMPONENT' else s.kind end node_kind,
        s.simple_name || coalesce(s.signature, '') as label, s.qualified_name subtitle, s.relative_path, s.start_line, s.end_line, coalesce(p.role, case when s.parent_id is null then s.role end, '') roles
      from symbols s left join symbols p on p.id = s.parent_id"""),
    "d2_ranked_edges": oracle("select repository_id, source_id, id, edge_rank from ranked", STEPS),
    "d3_endpoint_roots": oracle("""select e.repository_id, e.method_id, e.id endpoint_id, e.http_method, e.path, m.simple_name handler, m.relative_path path_of_source, m.start_line, m.end_line, t.qualified_name controller
      from endpoints e join symbols m on m.id = e.method_id join symbols t on t.id = m.parent_id"""),
    "d4_forward_reach": oracle("select * from seen", STEPS),
    "d5_traversable": oracle("select repository_id, id, kind, case when confidence >= 0.9 then 'HIGH' when confidence >= 0.7 then 'INFERRED' else 'AMBIGUOUS' end confidence_label from fwd where confidence >= 0.7", STEPS),
    "d6_bound_graph": oracle("""select t.id root, t.repository_id, 1 + coalesce(sum(b.is_new::int) filter (c.stop is null or b.seq < c.stop), 0)::bigint nodes, count(b.seq) filter (c.stop is null or b.seq < c.stop) edges, any_value(c.reason) reason
      from types t left join breach b on b.root = t.id left join cut c on c.root = t.id group by 1, 2""", STEPS),
    "d7_external_terminals": oracle("""select source_id root, repository_id, 'external-edge:' || id edge_id, source_id, 'external:' || id target_id, 'CALLS' kind
      from (select *, row_number() over (partition by repository_id, source_id order by line, id) rn from other) x where rn <= 20""", STEPS),
    "d8_endpoint_graphs": oracle(f"""select {_GRAPH_EDGE} from (
        select p.endpoint_id root, p.repository_id, s.edge_id, s.source_id, s.target_id, s.kind from eps p join symbol_edges s on s.root = p.type_id
        union all select endpoint_id, repository_id, 'handles:' || endpoint_id, 'endpoint:' || endpoint_id, type_id, 'HANDLES_ENDPOINT' from eps) x""", STEPS),
    "d9_symbol_graphs": oracle(f"select {_GRAPH_EDGE} from symbol_edges", STEPS),
    "d10_file_graphs": oracle("""select repository_id, relative_path, id node_id, seq, 'DECLARES' kind, n > 7 truncated, case when n > 7 then 'NODE_LIMIT' end reason
      from (select *, row_number() over (partition by repository_id, relative_path order by start_line, id) seq, count(*) over (partition by repository_id, relative_path) n from symbols where kind = 'METHOD') x where seq <= 7"""),
    "d11_blast_radius": oracle("select root, repository_id, node_id, depth from seen_back", STEPS),
    "d6_bounded_walk": oracle(_edges_of(), PLAIN),
    "d8_cut_endpoint_graphs": oracle(_edges_of("union all select 'handles:' || endpoint_id, 'endpoint:' || endpoint_id, type_id, 'HANDLES_ENDPOINT' from eps"), FROM_ENDPOINTS),
    "d9_cut_symbol_graphs": oracle(_edges_of(), AHEAD),
    "d15_cut_graphs": oracle("select root, repository_id, array_to_string(nodes, ',') nodes, array_to_string(edges, ',') edges, reason is not null truncated, reason from ended", AHEAD),
    "d11_cut_blast_radius": oracle("select root, repository_id, unnest(nodes) node_id, reason is not null truncated, reason from ended", BEHIND),
    "d13_cut_blast_edges": oracle(_edges_of(), BEHIND),
    "d12_cut_affected_endpoints": oracle("""select root, repository_id, edge_id[10:] endpoint_id, target_id, row_number() over (partition by root, repository_id order by pos) place from (
      select root, repository_id, unnest(edges) edge_id, generate_subscripts(edges, 1) pos from ended) e join (select distinct edge_id edge, target_id from numbered) s on s.edge = e.edge_id where edge_id like 'affected:%'""", BEHIND),
    "d12_affected_endpoints": oracle("select distinct s.root, s.repository_id, p.endpoint_id, 'affected:' || p.endpoint_id edge_id from seen_back s join eps p on p.type_id = s.node_id and p.repository_id = s.repository_id", STEPS),
    "d13_root_entity_edges": oracle("select source_id root, repository_id, id, target_id, kind, confidence from edges where kind in ('READS_ENTITY', 'WRITES_ENTITY', 'MANAGES_ENTITY')"),
    "d13_bounded_blast_radius": oracle(f"""select {_GRAPH_EDGE} from (
        select s.root, s.repository_id, e.id edge_id, e.source_id, e.target_id, e.kind from seen_shown s join back e on e.repository_id = s.repository_id and e.target_id = s.node_id where s.depth < 4 and s.open
        union all select distinct s.root, s.repository_id, 'affected:' || p.endpoint_id, 'endpoint:' || p.endpoint_id, s.node_id, 'REACHES' from seen_shown s join eps p on p.type_id = s.node_id and p.repository_id = s.repository_id
        union all select source_id, repository_id, id, source_id, target_id, kind from edges where kind in ('READS_ENTITY', 'WRITES_ENTITY', 'MANAGES_ENTITY')) x""", STEPS),
    "d14_unresolved_counts": oracle("""select s.root, s.repository_id, cast(count(*) as bigint) unresolved, cast(count(*) as varchar) || ' call expression(s) could not be resolved.' warning
      from seen s join raw_calls c on c.repository_id = s.repository_id and c.owner_id = s.node_id and c.scope_kind = 'NONE' group by 1, 2""", STEPS),
    "d15_assemble_graphs": oracle("""select s.root, s.repository_id, count(*) nodes, coalesce(any_value(e.n), 0) edges, false truncated, cast(null as varchar) reason, s.root first_node
      from seen s left join (select root, count(*) n from symbol_edges group by 1) e on e.root = s.root group by 1, 2""", STEPS),
    "d16_edges_touching": oracle("""select root, repository_id, node_id, count(distinct edge_id) edges from (
        select root, repository_id, edge_id, source_id node_id from symbol_edges union all select root, repository_id, edge_id, target_id from symbol_edges) x group by 1, 2, 3""", STEPS),
}
