"""Waves, labels, cycle checks and paths with conflicts against plain models, deep chains and cycles included."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import graph


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(list(edges), "parent long, child long")


def plain_waves(nodes, edges):
    up = defaultdict(set)
    for p, c in edges:
        up[c].add(p)
    out, left = {}, set(nodes)
    while ready := {n for n in left if up[n] <= set(out)}:
        out |= {n: max((out[p] + 1 for p in up[n]), default=0) for n in ready}
        left -= ready
    return out | dict.fromkeys(left)


def plain_reach(edges):
    down = defaultdict(set)
    for p, c in edges:
        down[p].add(c)

    def of(n):
        seen, todo = set(), [n]
        while todo:
            for c in down[todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    return of


def some(seed, n=60, cyclic=True):
    rng = random.Random(seed)
    edges = {(a, a + 1) for a in range(0, 25)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(40)}
    if cyclic:
        edges |= {(50, 44), (44, 50), (33, 33), (58, 57), (57, 58)}
    return list(range(n)), sorted(edges)


@pytest.mark.parametrize(("seed", "cyclic"), [(1, True), (2, False), (3, True)])
def test_waves_and_labels(spark, seed, cyclic):
    nodes, edges = some(seed, cyclic=cyclic)
    n, e = frames(spark, nodes, [*edges, edges[0]])
    want = plain_waves(nodes, edges)
    assert {r.node: r.wave for r in graph.waves(n, e).collect()} == want
    mark = {r.node: r for r in graph.labels(n, e).collect()}
    reach = plain_reach(edges)
    for a in nodes:
        for b in reach(a) - {a}:
            x, y = mark[a], mark[b]
            assert x.wave is None or y.wave is None or x.wave < y.wave
            assert x.top is None or y.top is None or (x.top >= y.top and x.low <= y.low)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    count = []
    real = session.cut
    monkeypatch.setattr(graph, "cut", lambda df: count.append(1) or real(df))
    n, e = frames(spark, range(10_001), [(i, i + 1) for i in range(10_000)])
    rows = graph.waves(n, e).agg(F.count("wave"), F.max("wave"), F.count_if(F.col("wave") == F.col("node"))).first()
    assert tuple(rows) == (10_001, 10_000, 10_001) and len(count) < 2 * 20


@pytest.mark.parametrize("seed", [4, 5])
def test_cycle_check(spark, seed):
    nodes, edges = some(seed)
    rng = random.Random(seed)
    asked = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)} | {(3, 3), (50, 44), (1, 25), (25, 1), (999, 1), (1, 999)}
    reach = plain_reach(edges)
    want = {(p, c) for p, c in asked if p == c or p in reach(c)}
    got = graph.would_cycle(frames(spark, nodes, edges)[1], spark.createDataFrame(sorted(asked), "parent long, child long")).collect()
    assert {(r.parent, r.child) for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "parent long, child long")
    assert graph.would_cycle(none, none).collect() == []


def test_cycle_check_writes_each_layer_once(spark, monkeypatch):
    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := real(df), written.append(out.count()))[0])
    n = 256
    tree = spark.createDataFrame([(k // 2, k) for k in range(n)], "parent long, child long")  # with an edge from 0 to itself
    asked = {(k, k // d) for k in range(n) for d in (3, 4)}
    got = {(r.parent, r.child) for r in graph.would_cycle(tree, spark.createDataFrame(sorted(asked), "parent long, child long")).collect()}
    above = lambda k: {k >> i for i in range(1, 10)}
    assert got == {(p, c) for p, c in asked if p == c or c in above(p)}
    assert sum(written) < 16 * n


def test_run_states_keep_nodes_alone(spark):
    nodes, edges = some(6)
    reach = plain_reach(edges)
    bad = {4, 30}
    behind = set().union(*(reach(b) for b in bad))
    n, e = frames(spark, nodes, edges)
    got = {r.node: r.state for r in graph.run_states(n, e, spark.createDataFrame([(b,) for b in bad], "node long")).collect()}
    assert got == {x: "skipped" if x in behind else "failed" if x in bad else "done" for x in nodes}


EDGE = "edge_id string, source_node_id string, predicate string, target_node_id string, conflict_status string, dedupe_key string, direction string"


def edges_of(spark, rows):
    return spark.createDataFrame([(i, a, p, b, "conflict" if bad else "none", k or i, d) for i, a, p, b, bad, k, d in rows], EDGE)


def plain_path(rows, start, target, most, direction, include):
    """Breadth first, edge by edge in their order."""
    unique = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        unique.setdefault(r[5] or r[0], r)
    queue, visited, conflicts, found = [(start, [start], [])], {start}, set(), None
    while queue:
        node, nodes, hops = queue.pop(0)
        if len(hops) == most:
            continue
        for i, a, _, b, bad, _, d in unique.values():
            both = direction == "both" or d == "bidirectional"
            to = b if (both or direction == "outbound") and a == node else a if (both or direction == "inbound") and b == node else None
            if to is None:
                continue
            if bad:
                conflicts.add(i)
                if not include:
                    continue
            if to in visited:
                continue
            visited.add(to)
            if to == target:
                found = (nodes + [to], hops + [i])
            else:
                queue.append((to, nodes + [to], hops + [i]))
    nodes, hops = found or ([], [])
    return (found is not None, nodes, hops, sorted(conflicts), 0 if include else len(conflicts))


@pytest.mark.parametrize("direction", graph.DIRECTIONS)
@pytest.mark.parametrize("include", [False, True])
def test_paths_with_conflicts(spark, direction, include):
    rng = random.Random(9)
    fixture = [("d-c", "D", "on", "C", False, None, "directed"), ("c-a", "C", "on", "A", False, None, "directed"), ("a-d", "A", "on", "D", False, None, "directed"), ("b-c", "B", "on", "C", True, None, "directed"), ("a-b", "A", "on", "B", False, None, "directed")]
    names = "ABCDEFGHIJ"
    rows = fixture + [(f"x{i:02}", rng.choice(names), rng.choice("pq"), rng.choice(names), rng.random() < 0.25, f"k{i // 2}" if i % 7 == 0 else None, rng.choice(["directed", "directed", "bidirectional", None])) for i in range(14)]
    pairs = [("A", "C"), ("C", "A"), ("A", "A"), ("A", "Z"), ("E", "B"), ("J", "C"), ("B", "D")]
    for most, some_ in ((3, fixture), (3, rows), (1, rows)):
        got = graph.relation_paths(edges_of(spark, some_), spark.createDataFrame(pairs, "start string, target string"), most, direction, include).collect()
        assert {(r.start, r.target): (r.found, r.nodes, r.edge_ids, r.conflicts, r.excluded) for r in got} == {p: plain_path(some_, *p, most, direction, include) for p in pairs}


def test_the_fixture(spark):
    rows = [("edge.d-c", "d", "depends_on", "c", False, None, "directed"), ("edge.c-a", "c", "depends_on", "a", False, None, "directed"), ("edge.a-d", "a", "depends_on", "d", False, None, "directed"), ("edge.b-c", "b", "depends_on", "c", True, None, "directed"), ("edge.a-b", "a", "depends_on", "b", False, None, "directed")]
    find = lambda *how: tuple(graph.relation_paths(edges_of(spark, rows), spark.createDataFrame([("a", "c")], "start string, target string"), *how).first())[2:]
    assert find(3) == (True, ["a", "d", "c"], ["edge.a-d", "edge.d-c"], ["edge.b-c"], 1)
    assert find(3, "outbound", True) == (True, ["a", "b", "c"], ["edge.a-b", "edge.b-c"], ["edge.b-c"], 0)
    assert find(1)[0] is False
    with pytest.raises(ValueError, match="direction"):
        find(3, "sideways")
