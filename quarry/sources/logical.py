"""Logical tables over the input tables: events, memories, grants, edges, usage ledger, tasks.

All rules are column expressions over one scan each, so filters and column selection still reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structured_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        s("user_id").alias("subject_id"),
        "event_type",
        F.col("ts").alias("occurred_from"),
        F.concat_ws(":", s("user_id"), "event_type", F.get_json_object("props", "$.k")).alias("dedupe_key"),
        F.when(F.col("event_id") % 10 == 0, "conflict").when(F.col("event_id") % 10 == 1, "superseded").otherwise("none").alias("conflict_status"),
        F.element_at(F.array(*map(F.lit, ("public", "tenant", "user_private", "agent_private"))), (u % 4 + 1).cast("int")).alias("scope"),
        F.concat(F.lit("t"), s(u % 2)).alias("tenant_id"),
        F.when(u % 4 == 1, F.concat(F.lit("t"), s(u % 2))).when(u % 4 == 2, F.concat(F.lit("u"), s(u % 3))).when(u % 4 == 3, F.concat(F.lit("a"), s(u % 3))).otherwise("system").alias("owner_id"),
        "value",
    )


def memory_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("memory_id"),
        F.concat(F.lit("t"), s(d % 2)).alias("tenant_id"),
        F.element_at(F.array(*map(F.lit, ("public", "tenant", "agent_private", "user_private", "session"))), (d % 5 + 1).cast("int")).alias("scope"),
        F.when(d % 5 == 1, F.concat(F.lit("t"), s(d % 2))).when(d % 5 == 2, F.concat(F.lit("a"), s(d % 3))).when(d % 5 == 3, F.concat(F.lit("u"), s(d % 3))).when(d % 5 == 4, F.concat(F.lit("s"), s(d % 3))).otherwise("system").alias("owner_id"),
        F.col("source").alias("source_type"),
        F.when(d % 17 == 0, "deleted").otherwise("active").alias("status"),
        (d % 4 + 1).cast("int").alias("version"),
        "text",
        "n_chars",
        F.col("lang").alias("kind"),
        F.when(d % 3 == 0, "raw").otherwise("curated").alias("stage"),
        F.timestamp_add("DAY", (d % 365).cast("int"), F.lit("1997-01-01").cast("timestamp_ntz")).alias("updated_at"),
    )


def index_version(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(10).select(
        i.alias("index_version_id"),
        F.concat(F.lit("t"), s(i % 2)).alias("tenant_id"),
        F.when(i % 3 == 0, "other").otherwise("memory.hybrid").alias("logical_name"),
        F.when(i == 9, "building").when(i % 4 == 3, "retired").otherwise("active").alias("status"),
    )


def memory_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document; those whose id is a vector's id too have an embedding."""
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(d.alias("chunk_id"), d.alias("memory_id"), (d % 10).alias("index_version_id"), F.when(d % 9 == 0, "parent").otherwise("child").alias("chunk_level"), F.col("source").alias("source_type"), F.col("text").alias("content"))
    return rows.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def memory_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"))
    grant = lambda n, kind, who, what: F.when(F.col("memory_id") % n == 0, F.struct(F.lit(kind).alias("principal_type"), F.lit(who).alias("principal_id"), F.lit(what).alias("permission")))
    every = F.array(grant(7, "role", "r1", "read"), grant(11, "user", "u1", "delete"), grant(13, "user", "u2", "read"))
    return d.select("memory_id", F.explode(F.filter(every, lambda g: g.isNotNull())).alias("g")).select("memory_id", "g.*")


def structured_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edges(table: str, prefix: str, key: str, target: str, to: str, predicate: str) -> DataFrame:
        k = F.col(key).cast("long")
        return read(spark, sf_dir, table).select(
            F.concat(F.lit(f"{prefix}:"), s(k)).alias("source_node_id"),
            F.lit(predicate).alias("predicate"),
            F.concat(F.lit(f"{to}:"), s(target)).alias("target_node_id"),
            F.concat(F.lit(f"e.{prefix}."), s(k)).alias("edge_id"),
            F.add_months(F.lit("1994-01-01").cast("date"), (12 * (k % 5)).cast("int")).cast("timestamp_ntz").alias("valid_from"),
            F.when(k % 3 != 0, F.lit("1998-01-01").cast("timestamp_ntz")).alias("valid_to"),
            F.when(k % 29 == 0, "conflict").otherwise("none").alias("conflict_status"),
            F.concat(F.lit("t"), s(k % 2)).alias("tenant_id"),
            F.when(k % 4 == 3, "user_private").otherwise("public").alias("scope"),
            F.concat(F.lit("u"), s(k % 3)).alias("owner_id"),
        )

    return (
        edges("supplier", "supplier", "s_suppkey", "s_nationkey", "nation", "located_in")
        .unionByName(edges("customer", "customer", "c_custkey", "c_nationkey", "nation", "located_in"))
        .unionByName(edges("nation", "nation", "n_nationkey", "n_regionkey", "region", "part_of"))
    )


def model_invocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws(".", s("l_orderkey"), s("l_linenumber"), s("l_partkey")).alias("invocation_id"),
        F.col("o_custkey").alias("run_id"),
        F.col("l_orderkey").alias("task_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("agent_id"),
        F.col("l_linestatus").alias("workload"),
        F.col("l_returnflag").alias("provider"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"),
        F.col("l_linenumber").cast("long").alias("attempt"),
        F.col("l_quantity").cast("long").alias("total_tokens"),
        F.floor(F.col("l_quantity") / 2).cast("long").alias("input_tokens"),
        F.floor(F.col("l_extendedprice")).cast("long").alias("cost_microusd"),
        (F.col("l_extendedprice") / 1000).alias("cost_usd"),
        (F.col("l_partkey") % 900 + 100).cast("long").alias("latency_ms"),
        F.col("o_orderdate").alias("started_at"),
    )


def workflow_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lease = F.when(k % 4 == 1, F.timestamp_add("DAY", (k % 21 - 10).cast("int"), F.lit("1998-01-01").cast("timestamp_ntz")))
    return read(spark, sf_dir, "orders").select(
        k.alias("task_id"),
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("subject"),
        F.element_at(F.array(*map(F.lit, ("pending", "leased", "completed", "pending"))), (k % 4 + 1).cast("int")).alias("status"),
        F.col("o_orderdate").alias("available_at"),
        F.timestamp_add("DAY", (k % 900).cast("int"), F.col("o_orderdate")).alias("deadline"),
        (k % 5).alias("attempt"),
        F.lit(3).cast("long").alias("max_attempts"),
        lease.alias("lease_expires_at"),
        (k % 19 == 0).alias("cancellation_requested"),
        (k % 12).alias("hop_count"),
        F.concat(F.lit("f"), s(k % 40)).alias("task_fingerprint"),
    )
