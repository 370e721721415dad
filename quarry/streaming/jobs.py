"""Structured Streaming jobs: exactly-once receipts, storm detection, outbox dispatch, mailbox source.

Event time must be a timestamp with time zone for watermarks, so columns without one are cast at the source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def mailbox(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSONL folder; what has been drained is the checkpoint's offset."""
    return spark.readStream.schema(schema).json(path)


def drain(spark: SparkSession, path: str, schema: str, to: str, checkpoint: str) -> int:
    """Moves what a mailbox holds and has not been drained yet to a Parquet table, once; how many messages are there now."""
    mailbox(spark, path, schema).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(to).count()


def parquet_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet file, or a growing folder of them, as a stream of at most `files` files a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a plain path has to be a folder


def receipts(deliveries: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first delivery of each (consumer, event_id) within the watermark."""
    return deliveries.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["consumer", "event_id"])


def storms(events: DataFrame, keys: list[str], window: str, slide: str, most: int, lateness: str = "10 minutes") -> DataFrame:
    """Sliding windows whose count of a key exceeds `most`; state is one count per key and open window."""
    timed = events.withColumn("occurred_from", F.col("occurred_from").cast("timestamp")).withWatermark("occurred_from", lateness)
    return timed.groupBy(F.window("occurred_from", window, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("observations")).where(F.col("observations") > most).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "observations")


def dispatch(outbox: DataFrame, publish: Callable[[DataFrame, int], DataFrame], results: str, checkpoint: str) -> StreamingQuery:
    """At-least-once dispatch: `publish` gives event_id and ok for a batch; outcomes are stored by batch, so that a rerun replaces them.

    Failed events get a time to be tried again; the next run of the source folder picks them up from there.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        done = publish(batch, batch_id)
        rows = batch.select("event_id", "attempts").join(done, "event_id", "left").select("event_id", (F.col("attempts") + 1).alias("attempts"), F.when(F.coalesce("ok", F.lit(False)), "published").when(F.col("attempts") + 1 >= 3, "discarded").otherwise("retry").alias("status"))
        rows.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    return outbox.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what is available into a memory table (tests) and returns it."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
