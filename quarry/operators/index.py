"""Index versions: what a principal may search, request filters, approximate search with over-fetch, evaluation and guards of builds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry import session
from quarry.functions import text as T
from quarry.operators import retrieval
from quarry.operators import visibility as vis

#: The columns a request may filter by.
FILTERS = ("memory_id", "source_type", "kind", "stage")
#: The checks that must have passed before a version is activated.
CHECKS = ("structure", "source_watermark", "acl", "recall", "citation")
#: Over-fetch of an approximate search: times the results wanted, at least so many, and so many attempts.
OVERFETCH, LEAST, ATTEMPTS = 4, 64, 4


def filtered(filters: Mapping[str, str]) -> Column:
    """Equality on each of the named columns; other names and empty values are errors."""
    out = F.lit(True)
    for name, value in filters.items():
        if name not in FILTERS:
            raise ValueError(f"unsupported retrieval filter: {name}")
        if not isinstance(value, str) or not value:
            raise ValueError(f"filter {name} requires a non-empty string value")
        out = out & (F.col(name).cast("string") == value)
    return out


def searchable(chunks: DataFrame, memories: DataFrame, acl: DataFrame, versions: DataFrame, p: vis.Principal, logical_name: str, filters: Mapping[str, str] | None = None) -> DataFrame:
    """Child chunks of readable memories in an active version of that name; other tenants' versions only serve public memories.

    versions is a dimension and is broadcast where it is small; filters on it and on the memory come before the chunks are joined.
    """
    live = versions.where((F.col("status") == "active") & (F.col("logical_name") == logical_name)).select("index_version_id", F.col("tenant_id").alias("_version_tenant"))
    own = vis.readable_memories(memories, acl, p).select("memory_id", "scope", *(c for c in ("kind", "stage") if c in memories.columns))
    rows = chunks.where("chunk_level = 'child'").join(retrieval.small(live), "index_version_id").join(own, "memory_id")
    return rows.where((F.col("scope") == "public") | (F.col("_version_tenant") == p.tenant_id)).where(filtered(filters or {})).drop("_version_tenant", "scope")


# --- approximate search ---


def overfetched(search, queries: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """Searches that cannot see who may read what: fetch more than k, filter, and fetch twice as many where too few are left.

    search(queries, limit, attempt) gives query_id, chunk_id, score, rank; allowed: chunk_id. A query is done when it has k results or
    when its search returned fewer candidates than it might have. All queries that are not done go on together, at most ATTEMPTS times. What an
    attempt found and what it left over are written, so that a later attempt runs none of the earlier ones again.
    """
    out, left, limit = None, queries, max(OVERFETCH * k, LEAST)
    for attempt in range(ATTEMPTS):
        found = session.cut(search(left, limit, attempt).select("query_id", "chunk_id", "score"))
        kept = retrieval.top(found.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), k)
        offered = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("offered"))
        have = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
        state = left.select("query_id").join(offered, "query_id", "left").join(have, "query_id", "left").na.fill(0, ["offered", "have"])
        last = attempt == ATTEMPTS - 1
        done = state.where(F.lit(last) | (F.col("have") >= k) | (F.col("offered") < limit)).select("query_id")
        part = kept.join(done, "query_id", "left_semi").select("query_id", "chunk_id", "score", "rank", F.lit(attempt + 1).alias("attempts"))
        out = part if out is None else out.unionByName(part)
        if last:
            break
        left = session.cut(left.join(done, "query_id", "left_anti"))
        if left.isEmpty():
            break
        limit *= 2
    return out


# --- building, evaluation, activation ---


def counts(chunks: DataFrame) -> DataFrame:
    """index_version_id, document_count, chunk_count."""
    return chunks.groupBy("index_version_id").agg(F.countDistinct("memory_id").alias("document_count"), F.count(F.lit(1)).alias("chunk_count"))


def evaluate(chunks: DataFrame, memories: DataFrame, acl: DataFrame, version: DataFrame, p: vis.Principal, cases: DataFrame, stage: str, k: int = 10) -> DataFrame:
    """What a version that is still being built would answer; cases: query_id, query, query_vector (null for lexical).

    version: its one row, which must say `building`. hybrid is half the lexical and half the vector score, over all chunks with a vector: a chunk among the
    k best either matches the words, and all such pairs get their vector score, or is among the k nearest vectors.
    """
    if stage not in ("lexical", "vector", "hybrid"):
        raise ValueError(f"unknown stage: {stage}")
    state = version.select("index_version_id", "status").head(2)
    if len(state) != 1 or state[0]["status"] != "building":
        raise ValueError("only a version that is being built can be evaluated")
    own = chunks.where((F.col("index_version_id") == state[0]["index_version_id"]) & (F.col("chunk_level") == "child")).join(vis.readable_memories(memories, acl, p).select("memory_id"), "memory_id", "left_semi")
    if stage == "lexical":
        return retrieval.lexical(own, cases.select("query_id", "query"), k)
    asked = cases.where("query_vector is not null").select("query_id", "query_vector")
    near = retrieval.vector(own, asked, k)
    if stage == "vector":
        return near
    held = own.where("embedding is not null").select("chunk_id", "content", "embedding")
    words = retrieval.lexical(held, cases.select("query_id", "query"), None).withColumnRenamed("score", "_l")
    met = words.join(held.select("chunk_id", "embedding"), "chunk_id").join(retrieval.small(asked), "query_id").select("query_id", "chunk_id", "_l", F.round(T.similarity(F.col("query_vector"), F.col("embedding")), 6).alias("_v"))
    beside = near.select("query_id", "chunk_id", F.col("score").alias("_v")).join(words, ["query_id", "chunk_id"], "left_anti").withColumn("_l", F.lit(0.0))
    both = met.unionByName(beside).withColumn("score", F.round(0.5 * F.col("_v") + 0.5 * F.col("_l"), 7))
    return retrieval.top(both, k).select("query_id", "chunk_id", "score", "rank")


def degraded_policy(chunks: DataFrame, allow_build: bool = False, auto_activate: bool = False, allow_activation: bool = False) -> DataFrame:
    """index_version_id, degraded (chunks), verdict: whether a version with chunks of a parser's fallback may be built and activated."""
    n = F.count_if(F.coalesce(F.col("parser_mode") == "degraded", F.lit(False)))
    refused = F.lit("build_not_allowed") if not allow_build else F.lit("activation_not_allowed") if auto_activate and not allow_activation else F.lit("allowed")
    return chunks.groupBy("index_version_id").agg(n.alias("degraded")).withColumn("verdict", F.when(F.col("degraded") == 0, "allowed").otherwise(refused))


def activation_guard(versions: DataFrame) -> DataFrame:
    """index_version_id, reason (null: may be activated).

    versions carry a report: struct(passed, build_id, index_version_id, source_watermark, configuration_digest, checks), checks being
    array of struct(name, score, threshold, passed). Every check must be there once, be passed and reach its threshold.
    """
    r = F.col("report")
    names = F.array_sort(F.transform(r["checks"], lambda c: c["name"]))
    same = F.lit(True)
    for c in ("build_id", "index_version_id", "source_watermark", "configuration_digest"):
        same = same & r[c].eqNullSafe(F.col(c))
    good = F.forall(r["checks"], lambda c: c["passed"] & (c["score"] >= c["threshold"]))
    reason = (
        F.when(r.isNull(), "no_report").when(~F.coalesce(r["passed"], F.lit(False)), "not_passed").when(~same, "identity")
        .when(~F.coalesce(names == F.array(*(F.lit(c) for c in sorted(CHECKS))), F.lit(False)), "checks").when(~F.coalesce(good, F.lit(False)), "check_failed")
    )
    return versions.select("index_version_id", reason.alias("reason"))


# --- validity ---


def vector_errors(rows: DataFrame, key: str = "chunk_id", vector: str = "embedding", most: int = 4096) -> DataFrame:
    """key, error of vectors that are not 1 to `most` finite values with a norm that is finite and not zero."""
    v = F.col(vector)
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    error = F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) > most, "too_long").when(~finite, "not_finite").when((norm == 0) | F.isnan(norm) | (norm == F.lit(float("inf"))), "norm")
    return rows.select(key, error.alias("error")).where("error is not null")


def chunk_rules() -> dict[str, Column]:
    """Rules for lifecycle.broken(): every rule that a chunk has to keep before it is stored."""
    sha, level = "^sha256:[a-f0-9]{64}$", F.coalesce("chunk_level", F.lit("child"))
    filled = lambda c: F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False))
    with_vector, with_model = F.col("embedding").isNotNull(), F.col("embedding_model").isNotNull()
    v = F.col("embedding")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return {
        "identity": filled("chunk_id") & filled("memory_id") & filled("index_version_id"),
        "content": filled("content"),
        "source_type": filled("source_type"),
        "ordinal": F.col("ordinal") >= 0,
        "token_count": F.col("token_count") > 0,
        "chunk_digest": F.col("chunk_digest").rlike(sha),
        "citation_digest": F.col("citation_digest").rlike(sha),
        "digest_of_content": F.col("chunk_digest") == T.digest(F.col("content")),
        "citation": filled("citation_artifact_id") & F.col("citation_uri").rlike("^(?i)[a-z][a-z0-9+.-]*:"),
        "entity_keys": F.size(F.array_distinct(F.coalesce("entity_keys", F.array().cast("array<string>")))) == F.size(F.coalesce("entity_keys", F.array().cast("array<string>"))),
        "parent": (level != "parent") | (F.col("parent_chunk_id").isNull() & ~with_vector & ~with_model),
        "own_parent": ~F.coalesce(F.col("parent_chunk_id") == F.col("chunk_id"), F.lit(False)),
        "structure_path": F.forall(F.coalesce("structure_path", F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0),
        "model": (with_vector == with_model) & (~with_model | filled("embedding_model")),
        "vector": ~with_vector | ((F.size(v) >= 1) & (F.size(v) <= 4096) & F.coalesce((norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))),
    }


def hit_errors(hits: DataFrame) -> DataFrame:
    """chunk_id, error of hits without id or content, with a score that is no finite number from 0, no tokens, or a malformed digest."""
    s = F.col("score")
    error = (
        F.when(F.coalesce(F.length(F.col("chunk_id").cast("string")) == 0, F.lit(True)), "id").when(F.coalesce(F.length("content") == 0, F.lit(True)), "content")
        .when(s.isNull() | F.isnan(s) | (s < 0) | (s == F.lit(float("inf"))), "score").when(F.coalesce(F.col("token_count") <= 0, F.lit(True)), "token_count")
        .when(~F.coalesce(F.col("digest").rlike("^sha256:[a-f0-9]{64}$"), F.lit(False)), "digest")
    )
    return hits.select("chunk_id", error.alias("error")).where("error is not null")


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.Window.partitionBy(*key).orderBy(*by))).where("_n = 1").drop("_n")
