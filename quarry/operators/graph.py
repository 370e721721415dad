"""Bounded paths, reachability and execution waves by frontier joins; the driver holds no nodes, only counts of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.session import table as cut


def valid_at(edges: DataFrame, at: str) -> DataFrame:
    t = F.lit(at).cast("timestamp_ntz")
    return edges.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 6, both_ways: bool = False, inbound: bool = False) -> DataFrame:
    """pairs: start, target. The first path, in the order of nodes, of the fewest hops up to `most`; conflict edges do not count.

    Edges are walked from source to target, the other way (inbound), or both ways.

    Each hop joins the frontier with the edges and keeps one path per node, so a node is expanded once, and cycles end by themselves.
    """
    step = edges.where("conflict_status = 'none'").select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"))
    if inbound:
        step = step.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if both_ways:
        step = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = step.distinct()
    seen = pairs.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    frontier = seen
    for _ in range(most):
        reached = frontier.join(step, F.col("node") == F.col("a")).groupBy("start", "b").agg(F.min(F.concat("path", F.array("b"))).alias("path")).select("start", F.col("b").alias("node"), "path")
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    asked = pairs.select(F.col("start").alias("_start"), "target")
    found = asked.join(seen, (F.col("_start") == F.col("start")) & (F.col("target") == F.col("node")), "left")
    return found.select(F.col("_start").alias("start"), "target", F.array_join("path", ">").alias("path"), F.when(F.col("path").isNotNull(), F.size("path") - 1).cast("long").alias("hops"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node of everything reachable from the starts (column node) over edges (parent, child), distinct, until nothing is new."""
    seen = starts.select(F.col("node").alias("start"), "node").distinct()
    frontier, out = seen, None
    while True:
        frontier = frontier.join(edges, F.col("node") == F.col("parent")).select("start", F.col("child").alias("node")).distinct()
        if out is not None:
            frontier = frontier.join(out, ["start", "node"], "left_anti")
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        out = frontier if out is None else out.unionByName(frontier)
    return out if out is not None else seen.limit(0)


def longest(nodes: DataFrame, edges: DataFrame, own: dict[str, Column], weight: dict[str, int]) -> DataFrame:
    """node and, for each name, the largest of own(v) + weight * (edges from v to the node) over all v from which the node is reached, itself included.

    Nodes on or behind a cycle have nulls. Chains of nodes with one parent are contracted first: every such node points to its parent, and pointers jump, twice as far
    in each round, to the first node above that has none or several. Only these are then peeled in rounds, one for each layer of them, whatever the chains between.
    """
    names = list(own)
    edge = cut(edges.select(F.col("parent").alias("node"), F.col("child").alias("to")).distinct().select(F.col("node").alias("parent"), F.col("to").alias("child")))
    into = edge.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("up"), F.bool_or(F.col("parent") == F.col("child")).alias("loop"))
    rows = nodes.select("node").distinct().join(into.withColumnRenamed("child", "node"), "node", "left")
    single = F.coalesce((F.col("n") == 1) & ~F.col("loop"), F.lit(False))
    # what is known of the way up to `up`, which is not included: hops, and the largest value on it
    p = cut(rows.select("node", F.when(single, F.col("up")).otherwise(F.col("node")).alias("up"), single.cast("long").alias("hops"), (~single).alias("done"), F.coalesce("n", F.lit(0)).alias("n"), *(e.cast("long").alias(k) for k, e in own.items())))
    settled, active, jumps = p.where("done"), p.where("not done"), 0
    most = p.count().bit_length() + 1
    while jumps < most and not active.isEmpty():
        q = p.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("done").alias("_done"), *(F.col(k).alias(f"_{k}") for k in names))
        root = F.col("_node") == F.col("_up")
        further = [F.when(root, F.col(k)).otherwise(F.greatest(F.col(k), F.col(f"_{k}") + weight[k] * F.col("hops"))).alias(k) for k in names]
        moved = cut(active.join(q, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"), "n", *further))
        settled, active = settled.unionByName(moved.where("done")), moved.where("not done")
        p = settled.unionByName(active)
        jumps += 1
    heads = settled.where("hops = 0")
    known = values = heads.where("n = 0").select("node", *names)
    # heads with parents: how many ways in are known, and the largest value over these; each is written again only while some are missing
    waiting = heads.where("n > 0").select(F.col("node").alias("child"), "n", F.lit(0).cast("long").alias("met"), *names)
    above = edge.join(settled.select(F.col("node").alias("parent"), "up", "hops", *names), "parent").join(waiting.select("child"), "child", "left_semi")
    # of a head, each way in: the head above it, and what the chain between adds; one without a head above lies behind a cycle
    way = ["child", "head", "_hops", *(f"_{k}" for k in names)]
    open_ = cut(above.select("child", F.col("up").alias("head"), F.col("hops").alias("_hops"), *(F.col(k).alias(f"_{k}") for k in names)))
    while not known.isEmpty():
        met = cut(open_.join(known.select(F.col("node").alias("head"), F.lit(True).alias("h"), *(F.col(k).alias(f"h_{k}") for k in names)), "head", "left"))
        got = met.where("h").select("child", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("met"), *((F.greatest(F.col(f"_{k}"), F.col(f"h_{k}") + weight[k] * F.col("_hops")) + weight[k]).alias(k) for k in names))
        open_ = met.where("h is null").select(*way)
        waiting = cut(waiting.unionByName(got).groupBy("child").agg(F.max("n").alias("n"), F.sum("met").alias("met"), *(F.max(k).alias(k) for k in names)))
        known, waiting = waiting.where("met = n").select(F.col("child").alias("node"), *names), waiting.where("met < n")
        values = values.unionByName(known)
    up = values.select(F.col("node").alias("up"), *(F.col(k).alias(f"u_{k}") for k in names))
    behind = settled.where("hops > 0").join(up, "up").select("node", *(F.greatest(F.col(k), F.col(f"u_{k}") + weight[k] * F.col("hops")).alias(k) for k in names))
    return nodes.select("node").distinct().join(values.unionByName(behind), "node", "left")


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, wave: the longest way to it over edges (parent, child); nodes on or behind a cycle have none."""
    return longest(nodes, edges, {"wave": F.lit(0)}, {"wave": 1})


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, wave, top, low: less the longest way on from it, and the largest and smallest hash of what the node reaches, itself included.

    Where a node reaches another, its wave is smaller, and its interval from low to top holds the other's. Nulls say nothing: such nodes reach a cycle.
    If there are any, wave is that of waves() for all nodes.
    """
    turned = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    h = F.shiftright(F.hash("node"), 1)
    reach = cut(longest(nodes, turned, {"top": h, "_low": -h, "_on": F.lit(0)}, {"top": 0, "_low": 0, "_on": 1}).select("node", (-F.col("_on")).alias("wave"), "top", (-F.col("_low")).alias("low")))
    if reach.where("wave is null").isEmpty():
        return reach
    return cut(reach.drop("wave").join(waves(nodes, edges), "node").select("node", "wave", "top", "low"))


def _excluded(a: str, b: str) -> Column:
    """Whether the labels with prefix a and b say that a's node does not reach b's, another one."""
    c = F.col
    return F.coalesce((c(f"{a}wave") >= c(f"{b}wave")) | (c(f"{a}top") < c(f"{b}top")) | (c(f"{a}low") > c(f"{b}low")), F.lit(False))


def _branching(edges: DataFrame, key: str) -> tuple[int, int]:
    """How many edges a node has at most on the side of key, and how many pairs of edges share a node there."""
    each = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum(F.col("n") * F.col("n"))).first()
    return each[0] or 0, each[1] or 0


def would_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate edges (parent, child) whose child already reaches the parent, or is the parent.

    Labels rule out most; where they cannot, a search between the two only visits nodes that, by their labels, may lie on a way from the child to the parent. It goes
    the way that the edges branch less: from the child on, or from the parent back. Edges from a node to itself lead nowhere and are left out.
    """
    asked = candidates.select("parent", "child").distinct()
    edge = cut(edges.select("parent", "child").where("parent <> child").distinct())
    mark = labels(edge.select(F.explode(F.array("parent", "child")).alias("node")).distinct(), edge)
    of = lambda prefix: mark.select(*(F.col(c).alias(f"{prefix}{c}") for c in mark.columns))
    (most_in, pairs_in), (most_out, pairs_out) = _branching(edge, "child"), _branching(edge, "parent")
    start, goal = ("parent", "child") if pairs_in < pairs_out else ("child", "parent")
    apart = (lambda at: _excluded("g_", at)) if start == "parent" else (lambda at: _excluded(at, "g_"))
    # without branches and cycles, no search comes to a node twice
    plain = (most_in if start == "parent" else most_out) <= 1 and mark.where("wave is null or top is null").isEmpty()
    rest = asked.where("parent <> child").join(of("g_"), F.col(goal) == F.col("g_node")).join(of("s_"), F.col(start) == F.col("s_node")).where(~apart("s_"))
    keep = ["parent", "child", "at", "g_wave", "g_top", "g_low"]
    frontier = cut(rest.withColumn("at", F.col(start)).select(*keep))
    seen, found = frontier.select("parent", "child", "at"), asked.where("parent = child")
    step = edge.select(F.col(goal).alias("from"), F.col(start).alias("to"))
    step = cut(step.join(of("n_"), F.col("to") == F.col("n_node")).select("from", "to", "n_wave", "n_top", "n_low").repartition("from"))
    while not frontier.isEmpty():
        near = frontier.join(step, F.col("at") == F.col("from")).withColumn("hit", F.col("to") == F.col(goal)).where(F.col("hit") | ~apart("n_"))
        near = near.select("parent", "child", F.col("to").alias("at"), "g_wave", "g_top", "g_low", "hit")
        near = cut(near if plain else near.distinct())
        hit = near.where("hit").select("parent", "child")
        found, frontier = found.unionByName(hit), near.where("not hit").select(*keep)
        if not plain:
            frontier = cut(frontier.join(hit, ["parent", "child"], "left_anti").join(seen, ["parent", "child", "at"], "left_anti"))
            seen = seen.unionByName(frontier.select("parent", "child", "at"))
    return found if plain else found.distinct()


def below(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node of everything that some start (column node) reaches over edges (parent, child); starts only where they are reached."""
    frontier = seen = starts.select("node").distinct()
    out = None
    while True:
        reached = frontier.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        new = cut(reached if out is None else reached.join(out, "node", "left_anti"))
        if new.isEmpty():
            return seen.limit(0) if out is None else out
        out = new if out is None else cut(out.unionByName(new))
        frontier = new


def run_states(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """node, state of an execution in waves: failed as given, skipped if it depends on a failed one through any others, else done."""
    bad = failed.select("node").distinct()
    behind = below(edges.select("parent", "child"), bad)
    rows = nodes.select("node").distinct().join(bad.withColumn("_f", F.lit(True)), "node", "left").join(behind.withColumn("_s", F.lit(True)), "node", "left")
    return rows.select("node", F.when(F.col("_s"), "skipped").when(F.col("_f"), "failed").otherwise("done").alias("state"))


DIRECTIONS = ("outbound", "inbound", "both")


def relation_paths(edges: DataFrame, pairs: DataFrame, most: int = 6, direction: str = "outbound", include_conflicts: bool = False) -> DataFrame:
    """start, target, found, nodes, edge_ids, conflicts, excluded: a path of the fewest hops, and the conflicting edges that the search met.

    Of edges with the same dedupe_key (edge_id where there is none) the first in the order of source, predicate, target and id counts; of paths with the same number of
    hops, the first in that order of their edges. The search goes on to `most` hops whether the target was found or not, but not beyond the target, and never back to
    the start. Conflicting edges are walked only if they are included, and told either way; excluded is how many were not walked.
    An edge whose `direction` is bidirectional is walked both ways.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    order = ["source_node_id", "predicate", "target_node_id", "edge_id"]
    key = "dedupe_key" if "dedupe_key" in edges.columns else "edge_id"
    rows = edges.withColumn("_n", F.row_number().over(W.Window.partitionBy(key).orderBy(*order))).where("_n = 1")
    both = F.lit(direction == "both") | (F.coalesce("direction", F.lit("directed")) == "bidirectional" if "direction" in edges.columns else F.lit(False))
    way = lambda a, b, when: rows.where(when).select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct(*order).alias("e"), (F.col("conflict_status") != "none").alias("conflict"))
    step = way("source_node_id", "target_node_id", both | F.lit(direction == "outbound")).unionByName(way("target_node_id", "source_node_id", both | F.lit(direction == "inbound"))).distinct()
    asked = cut(pairs.select("start", "target").distinct())
    pair = ["start", "target"]
    at = asked.select(*pair, F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast(f"array<{step.schema['e'].dataType.simpleString()}>").alias("way"))
    seen, met, hit = at.select(*pair, "node"), None, None
    for _ in range(most):
        near = cut(at.join(step, F.col("node") == F.col("a")))
        bad = near.where("conflict").select(*pair, F.col("e.edge_id").alias("edge_id")).distinct()
        met = bad if met is None else met.unionByName(bad)
        walked = near if include_conflicts else near.where("not conflict")
        best = walked.groupBy(*pair, "b").agg(F.min(F.struct(F.concat("way", F.array("e")).alias("way"), F.concat("nodes", F.array("b")).alias("nodes"))).alias("m"))
        new = cut(best.select(*pair, F.col("b").alias("node"), "m.nodes", "m.way").join(seen, [*pair, "node"], "left_anti"))
        seen = seen.unionByName(new.select(*pair, "node"))
        here = new.where("node = target")
        hit = here if hit is None else hit.unionByName(here)
        at = new.where("node <> target")
    told = met.distinct().groupBy(*pair).agg(F.sort_array(F.collect_list("edge_id")).alias("conflicts"))
    none = F.array().cast("array<string>")
    out = asked.join(hit.select(*pair, "nodes", F.transform("way", lambda e: e["edge_id"]).alias("edge_ids"), F.lit(True).alias("found")), pair, "left").join(told, pair, "left")
    conflicts = F.coalesce("conflicts", none)
    return out.select(*pair, F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("nodes", none).alias("nodes"), F.coalesce("edge_ids", none).alias("edge_ids"), conflicts.alias("conflicts"), (F.lit(0) if include_conflicts else F.size(conflicts)).cast("long").alias("excluded"))


def dependencies_by_file(items: DataFrame) -> DataFrame:
    """items: item_id, files. Each item depends on the item before it that touches the same file."""
    w = W.Window.partitionBy("file").orderBy("item_id")
    each = items.select("item_id", F.explode(F.array_distinct("files")).alias("file")).withColumn("parent", F.lag("item_id").over(w))
    return each.where("parent is not null").select("parent", F.col("item_id").alias("child")).distinct()
