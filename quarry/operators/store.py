"""Stores: memories, grants, artifacts with lineage, maintenance ledger, chunk writes, leases, deletion reconciliation.

A store is a table; what comes in is compared with it by key, and what is new is appended. Nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.operators import lifecycle
from quarry.operators import visibility as vis


def append(df: DataFrame, path: str) -> None:
    """Appends to a Parquet table; the committer makes a write whole or leaves none of it."""
    df.write.mode("append").parquet(path)


def capture(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories to insert (version 1), and memory_ids that are known with another digest, tenant, scope or owner."""
    new, conflicts = lifecycle.upsert(stored, incoming, "memory_id", ["content_digest", "tenant_id", "scope", "owner_id"])
    return new.withColumn("version", F.lit(1)), conflicts


GRANT = ["memory_id", "principal_type", "principal_id", "permission"]


def grant(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Grants that are not there yet, each once."""
    return incoming.select(*GRANT).distinct().join(stored.select(*GRANT), GRANT, "left_anti")


def store_artifacts(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts to insert, their lineage (artifact_id, source_artifact_id, relation), and conflicts (artifact_id, reason, existing_id).

    An id that is known must have the same digest, uri, scope and owner; a (digest, scope, owner) that is known under another id is a
    conflict as well. Of incoming rows that clash with each other, the smallest id counts as stored first.
    """
    of = ["digest", "scope", "owner_id"]
    once, clash = lifecycle.upsert(stored, incoming, "artifact_id", [*of, "uri"])
    own = W.Window.partitionBy(*of).orderBy("artifact_id")
    once = once.withColumn("_first", F.first("artifact_id").over(own)).join(stored.select(*of, F.col("artifact_id").alias("_known")), of, "left")
    taken = F.coalesce("_known", F.when(F.col("_first") != F.col("artifact_id"), F.col("_first")))
    same_content = once.where(taken.isNotNull()).select("artifact_id", F.lit("digest").alias("reason"), taken.alias("existing_id"))
    new = once.where(taken.isNull()).drop("_first", "_known")
    lineage = new.select("artifact_id", F.explode(F.array_distinct("lineage_ids")).alias("source_artifact_id"), F.lit("derived_from").alias("relation"))
    return new, lineage, clash.distinct().select("artifact_id", F.lit("identity").alias("reason"), F.col("artifact_id").alias("existing_id")).unionByName(same_content)


def readable_artifacts(artifacts: DataFrame, acl: DataFrame, principal_type: str, principal_id: str) -> DataFrame:
    """Public, owned, or granted to the principal."""
    granted = acl.where((F.col("principal_type") == principal_type) & (F.col("principal_id") == principal_id) & (F.col("permission") == "read")).select(F.col("artifact_id").alias("_granted")).distinct()
    rows = artifacts.join(granted, F.col("artifact_id") == F.col("_granted"), "left")
    return rows.where((F.col("scope") == "public") | (F.col("owner_id") == principal_id) | F.col("_granted").isNotNull()).drop("_granted")


MOST_SOURCES = 10_000


def active_source(memories: DataFrame, tenant_id: str, limit: int = MOST_SOURCES) -> DataFrame:
    """What an index of the tenant is built from: active public and tenant memories, by time and id. More than `limit` of them are an error, not a cut."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    rows = memories.where((F.col("tenant_id") == tenant_id) & (F.col("status") == "active") & F.col("scope").isin("public", "tenant"))
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} active memories of {tenant_id}")
    return rows.orderBy("updated_at", "memory_id")


def newest(rows: DataFrame, at: str, key: str, limit: int = 100, where: Column | None = None) -> DataFrame:
    """The newest rows, ties by key; the limit is the feature."""
    return (rows if where is None else rows.where(where)).orderBy(F.desc(at), key).limit(limit)


def list_readable(memories: DataFrame, acl: DataFrame, p: vis.Principal, scopes: tuple[str, ...] | None = None, limit: int = 100) -> DataFrame:
    """Memories that the principal may read, newest first."""
    return newest(vis.readable_memories(memories, acl, p, scopes), "updated_at", "memory_id", limit)


MOST_EDGES = 20_001


def list_edges(edges: DataFrame, p: vis.Principal, limit: int = MOST_EDGES) -> DataFrame:
    """Readable edges by source, predicate, target and id."""
    return vis.readable_facts(edges, p).orderBy("source_node_id", "predicate", "target_node_id", "edge_id").limit(min(limit, MOST_EDGES))


# --- leases ---


def claim(rows: DataFrame, key: str, due: Column, order: list[str], worker: str, now: str, lease_seconds: int, limit: int) -> DataFrame:
    """The first `limit` rows that are due, as they are once the worker has them: owner, end of the lease, one attempt more."""
    t = F.lit(now).cast("timestamp_ntz")
    return rows.where(due).orderBy(*order, key).limit(limit).select(key, F.lit(worker).alias("lease_owner"), F.timestamp_add("SECOND", F.lit(lease_seconds), t).alias("lease_expires_at"), (F.col("attempt") + 1).alias("attempt"))


# --- reconciliation of deletions ---


def reconcile(targets: DataFrame, receipts: DataFrame, memories: DataFrame, stale_before: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Failed targets that are stale become pending again, oldest first, at most `limit`: the events to send, and each deletion's new status.

    targets: deletion_id, target, status, attempt, updated_at; receipts: deletion_id, memory_id, tenant_id; memories give the digest.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("the limit of a reconciliation must be between 1 and 1000")
    stale = targets.where((F.col("status") == "failed") & (F.col("updated_at") <= F.lit(stale_before).cast("timestamp_ntz"))).orderBy("updated_at", "deletion_id", "target").limit(limit)
    rows = stale.join(receipts, "deletion_id").join(memories.select("memory_id", "content_digest"), "memory_id")
    next_attempt = (F.col("attempt") + 1).cast("string")
    events = rows.select(
        F.concat_ws(".", F.lit("event.memory-deletion-retry"), "deletion_id", "target", next_attempt).alias("event_id"), F.lit("MemoryDeletionPropagationRequested").alias("event_type"),
        F.concat_ws(":", F.lit("memory-delete-retry"), "deletion_id", "target", next_attempt).alias("idempotency_key"), "deletion_id", "target", "memory_id", "tenant_id", "content_digest",
    )
    again = rows.select("deletion_id", "target").withColumn("_again", F.lit(True))
    after = targets.join(again, ["deletion_id", "target"], "left").withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status")))
    touched = after.join(rows.select("deletion_id").distinct(), "deletion_id", "left_semi")
    return events, touched.groupBy("deletion_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("pending").alias("propagation_status"))


def batches_of(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]
