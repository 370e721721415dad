"""Writes to the store that check before they commit: chunks, invocations with their budgets, deletions with their cascade, reports.

Each is one batch of sink.write(), so what belongs together is there together, once, or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import ledger, lifecycle
from quarry.operators import visibility as vis
from quarry.sources import sink

CHUNK = "chunk_id long, memory_id long, index_version_id long, parent_chunk_id long, content string, chunk_digest string"
INVOCATION = "invocation_id string, run_id long, agent_id string, status string, total_tokens long, cost_usd double"
GONE = "memory_id long, deletion_id string"


class Refused(ValueError):
    """A batch that may not be written; errors has a row for each reason."""

    def __init__(self, errors: DataFrame):
        super().__init__(f"batch refused: {errors.limit(3).collect()}")
        self.errors = errors


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks that are stored and whose memory is not deleted."""
    gone = sink.read(spark, path, "deleted", GONE).select("memory_id").distinct()
    return sink.read(spark, path, "chunks", CHUNK).join(gone, "memory_id", "left_anti").select(*(c.split(" ")[0] for c in CHUNK.split(", ")))


def put_chunks(path: str, batch: str, incoming: DataFrame) -> bool:
    """Adds chunks that are new; one that is known must be the same, and a parent must be of the same memory and version, stored or in the batch.

    A deleted memory takes no chunks. Otherwise the batch is refused whole.
    """
    if sink.committed(path, batch):
        return False
    spark = incoming.sparkSession
    names = [c.split(" ")[0] for c in CHUNK.split(", ")]
    incoming = incoming.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in CHUNK.split(", ")))
    rows = session.cut(incoming.drop("content"))  # texts are not needed to check
    stored = chunks(spark, path).drop("content")
    fixed = ["memory_id", "index_version_id", "parent_chunk_id", "chunk_digest"]
    new, clash = lifecycle.upsert(stored, rows, "chunk_id", fixed)
    twice = rows.groupBy("chunk_id").agg(F.count_distinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fixed))).alias("n")).where("n > 1")
    known = stored.select("chunk_id", "memory_id", "index_version_id").unionByName(rows.select("chunk_id", "memory_id", "index_version_id")).distinct()
    of = known.select(F.col("chunk_id").alias("parent_chunk_id"), "memory_id", "index_version_id")
    strays = rows.where("parent_chunk_id is not null").join(of, ["parent_chunk_id", "memory_id", "index_version_id"], "left_anti")
    dead = rows.join(sink.read(spark, path, "deleted", GONE).select("memory_id").distinct(), "memory_id", "left_semi")
    reason = lambda df, why: df.select("chunk_id", F.lit(why).alias("error"))
    errors = session.cut(reason(clash.unionByName(twice.select("chunk_id")), "contradicts").unionByName(reason(strays, "parent")).unionByName(reason(dead, "deleted")).distinct())
    if not errors.isEmpty():
        raise Refused(errors)
    ids = session.cut(new.select("chunk_id"))
    total, distinct = rows.count(), rows.select("chunk_id").distinct().count()
    if ids.count() < distinct:  # texts are only shuffled where some are known or come twice
        incoming = incoming.join(ids, "chunk_id", "left_semi")
    if distinct < total:
        incoming = incoming.dropDuplicates(["chunk_id"])
    return sink.write(path, batch, {"chunks": incoming.select(*names)})


#: Stored ids that are compared at once, before there are more slices, and the most slices.
SLICE, SLICES = 4_000_000, 4


def put_invocations(path: str, batch: str, calls: DataFrame) -> bool:
    """Adds invocations that are new, and what they add to their runs' budgets, in one commit. Of rows with the same id, the smallest counts.

    Ids are compared first, a slice of them after the other; whole rows are only shuffled where their ids come twice. So calls are read several times, and have to be the same each time.
    """
    if sink.committed(path, batch):
        return False
    names = [c.split(" ")[0] for c in INVOCATION.split(", ")]
    rows, stored = calls.select(*names), sink.read(calls.sparkSession, path, "invocations", INVOCATION).select("invocation_id")
    ids = rows.select("invocation_id", F.lit(1).alias("_n"), F.lit(False).alias("_known")).unionByName(stored.select("invocation_id", F.lit(0).alias("_n"), F.col("invocation_id").isNotNull().alias("_known")))
    slices = min(SLICES, 1 + sink.count(path, "invocations") // SLICE)
    parts = [ids.where(F.pmod(F.xxhash64("invocation_id"), F.lit(slices)) == i) if slices > 1 else ids for i in range(slices)]
    each = [p.groupBy("invocation_id").agg(F.sum("_n").alias("n"), F.max("_known").alias("known")).where("n > 0") for p in parts]
    odd = F.col("known") | (F.col("n") > 1)
    found = [e.agg(F.count_if(~F.col("known")), F.count_if(odd)).first() for e in each]
    if not any(fresh for fresh, _ in found):
        rows = rows.limit(0)
    elif any(others for _, others in found):
        rest = [n for n in names if n != "invocation_id"]
        of = None
        for e, (_, others) in zip(each, found, strict=True):
            if others:
                part = session.table(e.where(odd).select(F.col("invocation_id").alias("_id"), "known"))
                of = part if of is None else of.unionByName(part)
        same = F.col("invocation_id").eqNullSafe(F.col("_id"))
        twice = rows.join(of.where(~F.col("known")), same, "left_semi").groupBy("invocation_id").agg(F.min(F.struct(*rest)).alias("c"))
        rows = rows.join(of, same, "left_anti").unionByName(twice.select("invocation_id", "c.*").select(*names))
    return sink.write(path, batch, {"invocations": rows, "budgets": lambda staged: ledger.budgets(staged("invocations"))})


def budgets(spark: SparkSession, path: str) -> DataFrame:
    """run_id and its counters over all batches: sums of what each batch added."""
    rows = sink.read(spark, path, "budgets")
    return rows.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in rows.columns if c not in ("run_id", "_batch")))


def delete_memories(path: str, batch: str, memories: DataFrame, facts: DataFrame, deletion_id: str, targets: tuple[str, ...] = ("index", "events", "cache")) -> bool:
    """Marks memories as deleted, with a receipt for each (what goes with it) and a pending propagation to each target, in one commit.

    facts: source_memory_ids. Chunks of a deleted memory are no longer read; files are not changed.
    """
    if sink.committed(path, batch):
        return False
    spark = memories.sparkSession
    ids = session.cut(memories.select(F.col("memory_id").cast("long").alias("memory_id")).where("memory_id is not null").distinct().join(sink.read(spark, path, "deleted", GONE), "memory_id", "left_anti"))
    named = ids.withColumn("deletion_id", F.concat_ws(".", F.lit(deletion_id), F.col("memory_id").cast("string")))
    receipts = lifecycle.cascade_counts(ids, chunks(spark, path), facts).withColumn("deletion_id", F.concat_ws(".", F.lit(deletion_id), F.col("memory_id").cast("string")))
    pending = named.select("deletion_id", F.explode(F.array(*map(F.lit, targets))).alias("target")).withColumns({"status": F.lit("pending"), "attempt": F.lit(0).cast("long")})
    return sink.write(path, batch, {"deleted": named.select("memory_id", "deletion_id"), "receipts": receipts.select("deletion_id", "memory_id", "chunks", "facts"), "deletion_targets": pending})


def put_responses(path: str, batch: str, hits: DataFrame, trace: dict[str, str]) -> bool:
    """Answers to requests as JSON documents, one a query: its hits in order, and what was asked of the batch.

    hits: query_id, chunk_id, score, rank; at most what the search's limit let through for each query.
    """
    each = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"))
    body = F.struct(F.col("query_id"), F.size("hits").alias("returned"), F.col("hits"), F.create_map(*(F.lit(x) for pair in sorted(trace.items()) for x in pair)).alias("trace"))
    return sink.write(path, batch, {"responses": each.select("query_id", F.to_json(body).alias("body"))})


EVENT = "event_id long, scope string, source_memory_ids array<long>"


def put_events(path: str, batch: str, events: DataFrame, memories: DataFrame) -> bool:
    """Adds events (or edges) that are new. One that is readable by more than some memory it comes from, or comes from none that is active, makes the batch refused."""
    if sink.committed(path, batch):
        return False
    names = [c.split(" ")[0] for c in EVENT.split(", ")]
    rows = session.cut(events.select(*names).dropDuplicates(["event_id"]))
    wide = vis.broader_than_source(rows.withColumnRenamed("event_id", "fact_id"), memories).select(F.col("fact_id").alias("event_id"))
    none = rows.where("source_memory_ids is null or size(source_memory_ids) = 0").select("event_id")
    errors = session.cut(wide.unionByName(none).select(F.col("event_id").alias("chunk_id"), F.lit("visibility").alias("error")))
    if not errors.isEmpty():
        raise Refused(errors)
    stored = sink.read(events.sparkSession, path, "events", EVENT).select("event_id")
    return sink.write(path, batch, {"events": rows.join(stored, "event_id", "left_anti").select(*names)})


def record_cycle(spark: SparkSession, path: str, cycle_id: str, kind: str, completed_at: str, report: str) -> bool:
    """A maintenance cycle in the ledger, once for its id."""
    row = spark.createDataFrame([(cycle_id, kind, completed_at, report)], "cycle_id string, kind string, completed_at string, report string")
    return sink.write(path, f"cycle.{cycle_id}", {"cycles": row.withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))})
