"""The retrieval gateway for a batch of requests: fan-out, rewrite of empty results, authorisation, reranking, windows, sufficiency."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.operators import retrieval
from quarry.plans import planner

#: What each intent's structured query looks like, and the bounds of a request.
KIND = {"comparison": "compare_event_counts", "temporal": "select_event_time", "multi_hop": "find_relation_path"}
FIELDS = {
    "comparison": {"kind", "event_type", "from", "to", "include_conflicts", "left_subject_id", "right_subject_id"},
    "temporal": {"kind", "event_type", "from", "to", "include_conflicts", "subject_id", "selector"},
    "multi_hop": {"kind", "start_node_id", "target_node_id", "predicates", "direction", "max_hops", "as_of", "include_conflicts"},
}
STRUCTURED_FILTERS = {"subject_id", "event_type", "from", "to", "include_conflicts"}
MOST_IDENTIFIER, MOST_FILTERS, MOST_VALUE, MOST_ROLES, MOST_HOPS, MOST_PREDICATES = 256, 16, 512, 64, 6, 32


class Unavailable(RuntimeError):
    """Nothing could be searched or checked, which is not the same as that nothing was found."""


class Incomplete(RuntimeError):
    """A retriever failed where every one of them has to answer."""


def _identifier(value) -> bool:
    return isinstance(value, str) and bool(value.strip()) and len(value) <= MOST_IDENTIFIER


def _whole(value, low: int, high: int | None = None) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= low and (high is None or value <= high)


def _time(value) -> datetime | None:
    try:
        t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (ValueError, AttributeError):
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def _range_ok(q: Mapping) -> bool:
    """from and to are times, if they are there, and in order."""
    given = [q[n] for n in ("from", "to") if q.get(n) is not None]
    ends = [_time(v) for v in given]
    return None not in ends and (len(ends) < 2 or ends[0] <= ends[1])


def _principal_ok(p, agent_id) -> bool:
    if not isinstance(p, Mapping) or not _identifier(p.get("tenant_id")):
        return False
    roles = p.get("role_ids") or []
    named = all(_identifier(p[n]) for n in ("user_id", "agent_id", "session_id") if p.get(n) is not None)
    return named and p.get("agent_id") in (None, agent_id) and isinstance(roles, (list, tuple)) and len(roles) <= MOST_ROLES and all(map(_identifier, roles)) and len(set(roles)) == len(roles)


def _structured_ok(intent: str, q) -> bool:
    if intent not in KIND:
        return q is None
    if not isinstance(q, Mapping) or set(q) - FIELDS[intent] or q.get("kind") != KIND[intent] or not isinstance(q.get("include_conflicts", False), bool):
        return False
    if intent == "multi_hop":
        names = q.get("predicates")
        several = names is None or (isinstance(names, (list, tuple)) and 1 <= len(names) <= MOST_PREDICATES and all(map(_identifier, names)) and len(set(names)) == len(names))
        ends = _identifier(q.get("start_node_id")) and _identifier(q.get("target_node_id")) and q["start_node_id"] != q["target_node_id"]
        return ends and several and q.get("direction") in ("outbound", "inbound", "both") and _whole(q.get("max_hops"), 1, MOST_HOPS) and _time(q.get("as_of")) is not None
    if not _identifier(q.get("event_type")) or not _range_ok(q):
        return False
    if intent == "comparison":
        return _identifier(q.get("left_subject_id")) and _identifier(q.get("right_subject_id")) and q["left_subject_id"] != q["right_subject_id"]
    return _identifier(q.get("subject_id")) and q.get("selector") in ("first", "last")


def request_errors(request: Mapping, agents: tuple[str, ...] | None = None) -> list[str]:
    """The fields for which a request is refused; empty where it is in order. agents: the known ones (None: any)."""
    intent, agent = request.get("intent"), request.get("agent_id")
    filters, more = request.get("filters"), request.get("structured_filters")
    name_ok = lambda n: isinstance(n, str) and re.fullmatch("[a-z][a-z0-9_]{0,63}", n) is not None
    value_ok = lambda v: len(v) <= MOST_VALUE if isinstance(v, str) else isinstance(v, (bool, int)) or (isinstance(v, float) and math.isfinite(v))
    structured_filters = more is None if more is None or not isinstance(more, Mapping) else not set(more) - STRUCTURED_FILTERS and all(_identifier(more[n]) for n in ("subject_id", "event_type", "from", "to") if more.get(n) is not None) and isinstance(more.get("include_conflicts", False), bool) and _range_ok(more)
    if intent == "count_events":
        structured_filters = structured_filters and isinstance(more, Mapping) and _identifier(more.get("subject_id")) and _identifier(more.get("event_type"))
    target = request.get("evidence_coverage_target")
    rules = {
        "query_id": isinstance(request.get("query_id"), str) and bool(request["query_id"].strip()),
        "original_query": isinstance(request.get("original_query"), str) and bool(request["original_query"].strip()),
        "purpose": isinstance(request.get("purpose"), str) and bool(request["purpose"].strip()),
        "intent": intent in {i[0] for i in planner.INTENTS},
        "agent_id": _identifier(agent) and (agents is None or agent in agents),
        "principal": _principal_ok(request.get("principal"), agent),
        "token_budget": _whole(request.get("token_budget"), 1) and _whole(request.get("estimated_chunk_tokens"), 1),
        "require_citations": isinstance(request.get("require_citations"), bool),
        "required_entity_count": request.get("required_entity_count") is None or _whole(request["required_entity_count"], 1, 1000),
        "evidence_coverage_target": target is None or (isinstance(target, (int, float)) and not isinstance(target, bool) and 0 <= target <= 1),
        "filters": filters is None or (isinstance(filters, Mapping) and len(filters) <= MOST_FILTERS and all(map(name_ok, filters)) and all(map(value_ok, filters.values()))),
        "structured_filters": structured_filters,
        "structured_query": _structured_ok(intent, request.get("structured_query")),
    }
    known = {*rules, "estimated_chunk_tokens"}
    return [n for n, ok in rules.items() if not ok] + sorted(set(request) - known)


def request_faults(requests: DataFrame, agents: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, faults of a batch of requests, each a JSON text `body`: what request_errors() says; no JSON object is the fault `body`."""

    def faults(text: str | None) -> list[str]:
        try:
            body = json.loads(text or "")
        except ValueError:
            return ["body"]
        return request_errors(body, agents) if isinstance(body, dict) else ["body"]

    def run(batches):
        for pdf in batches:
            yield pdf[["query_id"]].assign(faults=[faults(t) for t in pdf["body"]])

    return requests.select("query_id", "body").mapInPandas(run, "query_id long, faults array<string>")


Retriever = Callable[[DataFrame], DataFrame]


@dataclass
class FanOut:
    """lists: query_id, retriever, chunk_id, score, rank. trace: query_id, retriever, returned, failed."""

    lists: DataFrame
    trace: DataFrame
    failed: dict[str, str] = field(default_factory=dict)


def fan_out(queries: DataFrame, retrievers: Mapping[str, Retriever], candidate_k: int | str = 10, strict: bool = False) -> FanOut:
    """Asks every retriever about all queries. One that fails counts as without results, and is named; if all fail, Unavailable. If strict, the first that fails ends it as Incomplete.

    A retriever's plan is run here once (its list is written to the shared folder), so that its failure is known and stays its own.
    """
    from quarry import session

    spark = queries.sparkSession
    lists, failed = None, {}
    for name, retriever in retrievers.items():
        try:
            hits = retriever(queries)
            hits = hits.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= 0) & F.col("chunk_id").isNotNull())
            part = session.cut(retrieval.best_of(hits.select("query_id", "chunk_id", "score"), queries, candidate_k).withColumn("retriever", F.lit(name)))
        except Exception as e:  # noqa: BLE001  whatever befalls one retriever must not take the others along
            if strict:
                raise Incomplete(f"retriever {name} failed: {str(e)[:200]}") from e
            failed[name] = str(e)[:200]
            continue
        lists = part if lists is None else lists.unionByName(part)
    if lists is None:
        raise Unavailable(f"all {len(retrievers)} retrievers failed: {failed}")
    names = spark.createDataFrame([(n, n in failed) for n in retrievers], "retriever string, failed boolean")
    each = queries.select("query_id").withColumn("retriever", F.explode(F.array(*map(F.lit, retrievers)))).join(F.broadcast(names), "retriever")
    trace = each.join(lists.groupBy("query_id", "retriever").agg(F.count(F.lit(1)).alias("returned")), ["query_id", "retriever"], "left").na.fill(0, ["returned"])
    return FanOut(lists, trace.select("query_id", "retriever", "returned", "failed"), failed)


def rewrite_empty(first: FanOut, queries: DataFrame, rewrite: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], FanOut]) -> DataFrame:
    """The lists, where queries without any result were asked again in other words; a retry counts only if it found something.

    rewrite: query_id, query -> query_id, rewritten (null or the same words: no retry).
    """
    empty = first.trace.groupBy("query_id").agg(F.sum("returned").alias("n")).where("n = 0").select("query_id")
    asked = queries.join(empty, "query_id", "left_semi")
    if asked.isEmpty():
        return first.lists.withColumn("rewritten", F.lit(None).cast("string"))
    new = rewrite(asked.select("query_id", "query")).select("query_id", F.trim("rewritten").alias("rewritten"))
    new = new.join(asked.select("query_id", "query"), "query_id").where((F.length("rewritten") > 0) & (F.col("rewritten") != F.col("query")))
    kept = first.lists.withColumn("rewritten", F.lit(None).cast("string"))
    if new.isEmpty():
        return kept
    try:
        found = again(queries.drop("query").join(new.select("query_id", F.col("rewritten").alias("query")), "query_id")).lists
    except Unavailable:
        return kept
    return kept.unionByName(found.join(new.select("query_id", "rewritten"), "query_id"))


def windows(fused: DataFrame, plans: DataFrame, column: str) -> DataFrame:
    """The first rows of each query, as many as its plan's column says; fused has `position`."""
    return fused.join(retrieval.small(plans.select("query_id", F.col(column).alias("_k"))), "query_id").where(F.col("position") <= F.col("_k")).drop("_k")


def authorise(fused: DataFrame, readable: DataFrame, memory_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits that may be read, positions closed up; and for each query, how many there were, are left, and were denied."""
    allowed = retrieval.authorised(fused, readable, memory_of)
    kept = allowed.withColumn("position", F.row_number().over(W.Window.partitionBy("query_id").orderBy("position")))
    counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused")).join(allowed.groupBy("query_id").agg(F.count(F.lit(1)).alias("authorized")), "query_id", "left").na.fill(0, ["authorized"])
    return kept, counts.withColumn("denied", F.col("fused") - F.col("authorized"))


def rerank(window: DataFrame, score: Callable[[str, list[str]], list[float]], strict: bool = False) -> DataFrame:
    """Reorders each query's window by the scorer: one score in 0..1 for each candidate.

    window: query_id, query, chunk_id, content, score, position. What the scorer gives is checked; a scorer that fails, or breaks the
    rule, leaves the order as it is, or, if strict, ends the job. A query's window is bounded by its plan.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "chunk_id"])
        try:
            got = [float(s) for s in score(pdf["query"].iloc[0], pdf["content"].tolist())]
            if len(got) != len(pdf) or not all(0 <= s <= 1 for s in got):
                raise ValueError("a reranker must give one score from 0 to 1 for each candidate")
        except Exception:
            if strict:
                raise
            got = None
        out = pdf[["query_id", "chunk_id", "score"]].copy()
        if got is not None:
            out["score"] = got
            out = out.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable")
        out["position"] = range(1, len(out) + 1)
        out["reranked"] = got is not None
        return out

    return window.groupBy("query_id").applyInPandas(one, "query_id long, chunk_id long, score double, position int, reranked boolean")


def word_overlap(query: str, contents: list[str]) -> list[float]:
    """A local scorer: the share of the query's distinct words that a candidate holds."""
    own = set(query.lower().split())
    return [len(own & set(c.lower().split())) / max(1, len(own)) for c in contents]


def sufficiency(evidence: DataFrame, plans: DataFrame, structured: DataFrame | None = None) -> DataFrame:
    """query_id, selected, coverage, status, generation_allowed.

    evidence: query_id, chunk_id; plans: query_id, min_context_k, coverage_target, structured_required; structured: query_id, conflicts
    (how many), for the queries that have a structured answer.
    """
    n = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("selected"))
    rows = plans.join(n, "query_id", "left").na.fill(0, ["selected"])
    if structured is not None:
        rows = rows.join(structured.select("query_id", "conflicts", F.lit(True).alias("_has")), "query_id", "left")
    else:
        rows = rows.withColumns({"conflicts": F.lit(0), "_has": F.lit(False)})
    rows = rows.withColumn("coverage", F.round(F.least(F.lit(1.0), F.col("selected") / F.greatest(F.lit(1), "min_context_k")), 6))
    enough = (F.col("selected") >= F.col("min_context_k")) & (F.col("coverage") >= F.col("coverage_target")) & (~F.col("structured_required") | F.coalesce("_has", F.lit(False)))
    return rows.select("query_id", F.col("selected").cast("long").alias("selected"), "coverage", F.when(enough, "sufficient").otherwise("insufficient").alias("status"), (enough & (F.coalesce("conflicts", F.lit(0)) == 0)).alias("generation_allowed"))
