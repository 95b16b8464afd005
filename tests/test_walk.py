"""Bounded walks against a queue, on random graphs with cycles, loops and small limits."""

import random
from collections import deque

import pytest

from sourcefacts.operators import walk as X


def by_queue(root, out, leaves, depth, node_limit, edge_limit):
    nodes, edges, reason, queue = [root], [], None, deque([(root, 0)])
    while queue and not reason:
        node, d = queue.popleft()
        if d >= depth:
            continue
        for edge, target in out.get(node, []):
            if len(edges) >= edge_limit:
                reason = "EDGE_LIMIT"
            elif target not in nodes and len(nodes) >= node_limit:
                reason = "NODE_LIMIT"
            if reason:
                break
            if target not in nodes:
                nodes.append(target)
                queue.append((target, d + 1))
            edges.append(edge)
        for leaf in [] if reason else leaves.get(node, []):
            if len(nodes) >= node_limit:
                reason = "NODE_LIMIT"
            elif len(edges) >= edge_limit:
                reason = "EDGE_LIMIT"
            if reason:
                break
            nodes.append(f"external:{leaf}")
            edges.append(f"external-edge:{leaf}")
    return nodes, edges, reason


@pytest.mark.parametrize("seed", range(4))
def test_forward(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    rows, leaf_rows, out, leaves = [], [], {}, {}
    for i in range(26):
        a, b, c = rng.choice(names), rng.choice(names), rng.choice([0.7, 0.9])
        rows.append(("r", f"e{i:02}", a, b, "CALLS", c, rng.randrange(3), 1))
    for i in range(6):
        leaf_rows.append(("r", rng.choice(names), f"x{i}", i))
    for _, e, a, b, kind, c, line, col in sorted(rows, key=lambda r: (-r[5], r[4], r[6], r[7], r[1])):
        out.setdefault(a, []).append((e, b))
    for _, a, x, _ in leaf_rows:
        leaves.setdefault(a, []).append(x)
    depth, node_limit, edge_limit = rng.randint(1, 4), rng.randint(2, 9), rng.randint(1, 14)
    edges = spark.createDataFrame(rows, "repository_id string, id string, source_id string, target_id string, kind string, confidence double, line int, column int")
    external = spark.createDataFrame(leaf_rows, "repository_id string, source_id string, id string, line int")
    roots = spark.createDataFrame([(n, "r", n) for n in names], "root string, repository_id string, node_id string")
    walk = X.forward_walk(roots, edges, depth, node_limit, edge_limit, external)
    got_nodes, got_edges = walk.all_nodes().orderBy("seq").collect(), walk.all_edges().orderBy("seq").collect()
    reasons = {r["root"]: r["reason"] for r in walk.all_reasons().collect()}
    for n in names:
        nodes, es, reason = by_queue(n, out, leaves, depth, node_limit, edge_limit)
        assert [r["node_id"] for r in got_nodes if r["root"] == n] == nodes
        assert [r["edge_id"] for r in got_edges if r["root"] == n] == es
        assert reasons.get(n) == reason


def back_by_queue(root, incoming, handled, own, tests, depth, node_limit, edge_limit):
    nodes, edges, reason, queue = [root], [], None, deque([(root, 0)])

    def add(edge, node):
        nonlocal reason
        if node not in nodes and len(nodes) >= node_limit:
            reason = "NODE_LIMIT"
        elif edge not in edges and len(edges) >= edge_limit:
            reason = "EDGE_LIMIT"
        if reason:
            return False
        fresh = node not in nodes
        if fresh:
            nodes.append(node)
        if edge not in edges:
            edges.append(edge)
        return fresh

    def endpoints(node):
        for e in handled.get(node, []):
            if not reason:
                add(f"affected:{e}", f"endpoint:{e}")

    endpoints(root)
    for edge, target in own.get(root, []):
        if not reason:
            add(edge, target)
    while queue and not reason:
        node, d = queue.popleft()
        for edge, source in incoming.get(node, []) if d < depth else []:
            if not reason and add(edge, source) and source not in tests:
                queue.append((source, d + 1))
            if not reason:
                endpoints(source)
    return nodes, edges, reason


@pytest.mark.parametrize("seed", range(4))
def test_blast_radius(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(10)]
    rows, incoming, handled, own = [], {}, {}, {}
    for i in range(28):
        kind = "CALLS" if rng.random() < 0.8 else "READS_ENTITY"
        rows.append(("r", f"e{i:02}", rng.choice(names), rng.choice(names), kind, rng.choice([0.7, 0.9]), rng.randrange(3), 1))
    in_order = sorted(rows, key=lambda r: (-r[5], r[4], r[6], r[7], r[1]))
    for _, e, a, b, kind, *_ in in_order:
        if kind == "CALLS":
            incoming.setdefault(b, []).append((e, a))
        else:
            own.setdefault(a, []).append((e, b))
    points = [("r", f"p{i}", rng.choice(names), rng.choice(["GET", "POST"]), f"/{rng.randrange(4)}") for i in range(6)]
    for _, e, m, *_ in sorted(points, key=lambda p: (p[3], p[4], p[1])):
        handled.setdefault(m, []).append(e)
    tests = set(rng.sample(names, 2))
    depth, node_limit, edge_limit = rng.randint(2, 4), rng.randint(4, 14), rng.randint(3, 24)
    edges = spark.createDataFrame(rows, "repository_id string, id string, source_id string, target_id string, kind string, confidence double, line int, column int")
    endpoints = spark.createDataFrame(points, "repository_id string, endpoint_id string, method_id string, http_method string, path string")
    roots = spark.createDataFrame([(n, "r", n) for n in names], "root string, repository_id string, node_id string")
    shown = spark.createDataFrame([("r", n) for n in tests], "repository_id string, node_id string")
    walk = X.blast_radius(roots, edges.where("kind = 'CALLS'"), endpoints, shown, depth, node_limit, edge_limit, edges.where("kind <> 'CALLS'"))
    got_nodes, got_edges = walk.all_nodes().orderBy("seq").collect(), walk.all_edges().orderBy("seq").collect()
    reasons = {r["root"]: r["reason"] for r in walk.all_reasons().collect()}
    for n in names:
        nodes, es, reason = back_by_queue(n, incoming, handled, own, tests, depth, node_limit, edge_limit)
        assert [r["node_id"] for r in got_nodes if r["root"] == n] == nodes
        assert [r["edge_id"] for r in got_edges if r["root"] == n] == es
        assert reasons.get(n) == reason


def test_bounded_walk_of_the_tables(spark, sf_dir):
    from sourcefacts.jobs import graph_queries as Q

    out = {}
    for r in sorted(Q.forward(spark, sf_dir).collect(), key=lambda r: (-r["confidence"], r["kind"], r["line"], r["column"], r["id"])):
        out.setdefault(r["source_id"], []).append((r["id"], r["target_id"]))
    got = {}
    for r in Q.d6_bounded_walk(spark, sf_dir).collect():
        got.setdefault(r["root"], set()).add(r["edge_id"])
    cut = 0
    for r in Q.type_roots(spark, sf_dir).collect():
        _, edges, reason = by_queue(r["root"], out, {}, Q.DEPTH, 8, 12)
        assert got.get(r["root"], set()) == set(edges)
        cut += reason is not None
    assert cut


def test_depth_is_checked(spark):
    with pytest.raises(ValueError):
        X.reach(spark.createDataFrame([], "root string, repository_id string, node_id string"), spark.createDataFrame([], "repository_id string, from_id string, to_id string"), 9)
