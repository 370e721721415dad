"""Evidence selection, expansion and parent substitution: greedy scans in which skipping and stopping differ.

No window expresses them, so each is a plain function over one query's candidates, called by applyInPandas. A query has at most
`fusion_k` (150) candidates by its plan, so a group is small by contract.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def select(candidates: Iterable[dict[str, Any]], plan: dict[str, Any]) -> tuple[list[dict[str, Any]], int, str]:
    """Accepted candidates in order, tokens used, and what ended the scan.

    By score, each candidate is asked in turn: is the pack full; is the score, once the least number is in, under the floor, far under
    the one before, or far under the best; does the token budget burst (stop); does it bring no new entity from a source of the first
    one's type that has given enough (skip)?
    """
    ranked = sorted((c for c in candidates if c["score"] is not None and 0 <= c["score"] < float("inf")), key=lambda c: (-c["score"], c["chunk_id"]))
    taken: list[dict[str, Any]] = []
    entities: set[str] = set()
    given: dict[tuple, int] = {}
    tokens = 0
    for c in ranked:
        settled = len(taken) >= plan["min_context_k"]
        last = taken[-1]["score"] if taken else 0.0
        stop = (
            "context_k" if len(taken) >= plan["context_k"]
            else "score_floor" if settled and c["score"] < plan["score_floor"]
            else "marginal_gain" if settled and last > 0 and (last - c["score"]) / last >= plan["marginal_gain_floor"]
            else "relative_floor" if settled and ranked[0]["score"] > 0 and c["score"] / ranked[0]["score"] < plan.get("relative_floor", 0.0)
            else "token_budget" if tokens + c["token_count"] > plan["max_context_tokens"]
            else ""
        )
        if stop:
            return taken, tokens, stop
        keys = list(c.get("entity_keys") if c.get("entity_keys") is not None else [])
        source = (c["source_type"], tuple(sorted(keys)))
        fresh = any(k not in entities for k in keys)
        if taken and not fresh and c["source_type"] == taken[0]["source_type"] and given.get(source, 0) >= plan.get("max_chunks_per_source", 8):
            continue
        taken.append(c)
        given[source] = given.get(source, 0) + 1
        tokens += c["token_count"]
        entities.update(keys)
    return taken, tokens, "exhausted"


def select_batch(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """candidates: query_id, chunk_id, score, token_count, source_type, entity_keys. query_id, chunk_id, place, used_tokens, stopped_by."""
    limits = ["context_k", "min_context_k", "max_context_tokens", "score_floor", "marginal_gain_floor"]
    joined = candidates.select("query_id", "chunk_id", "score", "token_count", "source_type", "entity_keys").join(plans.select("query_id", *limits), "query_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, used, why = select(pdf.to_dict("records"), {k: pdf[k].iloc[0] for k in limits})
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "chunk_id": [c["chunk_id"] for c in taken], "place": range(1, len(taken) + 1), "used_tokens": used, "stopped_by": why}, columns=["query_id", "chunk_id", "place", "used_tokens", "stopped_by"])

    return joined.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, place long, used_tokens long, stopped_by string")


def expand(hits: list[dict[str, Any]], around: dict[Any, list[dict[str, Any]]], budget: int, most: int = 8) -> list[Any]:
    """Ids of the hits, then of their related chunks by priority while each fits the budget; one that does not fit is skipped."""
    held = {h["chunk_id"]: h["token_count"] for h in hits}
    used = sum(held.values())
    if used > budget:
        raise ValueError("the hits alone exceed the token budget")
    for h in hits:
        near = sorted(around.get(h["chunk_id"], []), key=lambda c: (-c["priority"], -c.get("score", 0.0), c["chunk_id"]))[:most]
        for c in near:
            if c["chunk_id"] not in held and c["token_count"] <= budget - used:
                held[c["chunk_id"]] = c["token_count"]
                used += c["token_count"]
    return list(held)


def expand_batch(hits: DataFrame, related: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """hits: query_id, chunk_id, token_count, place; related: anchor_id, chunk_id, priority, token_count. query_id, chunk_id, place."""
    near = related.toDF(*(f"r_{c}" for c in related.columns))
    joined = hits.join(near, hits["chunk_id"] == near["r_anchor_id"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.drop_duplicates("chunk_id").sort_values("place").to_dict("records")
        around: dict[Any, list[dict[str, Any]]] = {}
        for r in pdf[pdf["r_chunk_id"].notna()].to_dict("records"):
            around.setdefault(r["chunk_id"], []).append({"chunk_id": int(r["r_chunk_id"]), "priority": r["r_priority"], "token_count": int(r["r_token_count"])})
        ids = expand(own, around, budget, most)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "chunk_id": ids, "place": range(1, len(ids) + 1)})

    return joined.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, place long")


def substitute(hits: list[dict[str, Any]], budget: int) -> list[tuple[Any, float, int]]:
    """Each child becomes its parent where the parent fits what is left of the budget; one entry per chunk with its best score.

    Where the hits alone exceed the budget all of them stay, as themselves unless their parent makes room.
    """
    used = sum(h["token_count"] for h in hits)
    out: dict[Any, list] = {}
    for h in hits:
        parent, grow = h.get("parent_id"), 0
        if parent is not None and parent == parent:
            grow = (0 if parent in out else h["parent_tokens"]) - h["token_count"]
        if parent is None or parent != parent or used + grow > budget:
            key, tokens = h["chunk_id"], h["token_count"]
        else:
            key, tokens = int(parent), h["parent_tokens"]
            used += grow
        if key in out:
            out[key][0] = max(out[key][0], h["score"])
        else:
            out[key] = [h["score"], int(tokens)]
    return [(k, s, t) for k, (s, t) in out.items()]


def substitute_batch(hits: DataFrame, budget: int) -> DataFrame:
    """hits: query_id, chunk_id, score, token_count, parent_id, parent_tokens, place. query_id, chunk_id, score, token_count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = substitute(pdf.sort_values("place").to_dict("records"), budget)
        return pd.DataFrame([(pdf["query_id"].iloc[0], *r) for r in rows], columns=["query_id", "chunk_id", "score", "token_count"])

    return hits.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, score double, token_count long")
