"""Shared plumbing: table access, shared scratch space, clash-free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel

PART = 32 << 20  # bytes of text for a part of an exchange between blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so that a lost executor costs no recomputation beyond it.

    The files go when the application ends; shuffle files that only led to them go as soon as they are written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/quarry-{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what spool() wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._spooled)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB (or one row) go to Python workers, unless the session sets a figure of its own."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(4 << 20))


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has; the one figure that is to grow with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(docs: DataFrame) -> DataFrame:
    """The texts in blocks, each a row with a number of its own, written to the shared folder; see kernel."""

    def run(batches):
        from pyspark import TaskContext

        yield from kernel.text_rows(TaskContext.get().partitionId(), batches)

    return spool(keyed_text(docs).mapInArrow(kernel.tidy(run), "block long, size long, a binary, b binary, c binary"), "blocks")


def parts_of(text: DataFrame) -> int:
    """How many parts an exchange between these blocks has: as many as shuffles have, and more where a part's texts would pass PART bytes."""
    total = text.agg(F.sum("size")).first()[0] or 0
    return max(partitions(text.sparkSession), -(-total // PART))


def asked(text: DataFrame, ask, parts: int) -> DataFrame:
    """What the blocks ask, brought to the parts."""
    return text.select("block", "a", "b", "c").mapInArrow(kernel.tidy(ask), kernel.ROW).repartitionById(parts, F.col("part"))


def together(text: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """The blocks' texts and the answers to them, brought together."""
    home = F.expr(f"cast(pmod(shiftright(block, 32) + (block & 4294967295) * 7919, {parts}) as int)")
    own = text.select(home.alias("part"), "block", F.lit(kernel.TEXT).alias("kind"), "a", "b", "c")
    return own.unionByName(told).repartitionById(parts, F.col("part"))


def keyed_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id and text, whatever other columns there are; a row without doc_id cannot be named in a result and is left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).where("doc_id is not null")
