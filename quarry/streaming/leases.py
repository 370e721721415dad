"""Leases with timers: tasks or outbox rows as keyed state that survives restarts, moved by workers' events and by the clock.

A key's state is what a worker needs to go on: status, owner, end of the lease, attempts, when it may be tried again, checkpoint. A claim takes what is pending
and due, while attempts are left; heartbeat, checkpoint, complete and fail only count from the owner while the lease lasts. A lease that runs out, by a timer or
because a later event finds it so, makes the row pending again, or failed once its attempts are used up; so does a failure, after a delay that doubles. A row
may have a deadline, after which it is failed whatever else happens. What is refused changes nothing and is told as refused.

The state is in RocksDB under the query's checkpoint: a lost executor or a restarted query goes on from the last batch, and a file sink keeps each row once.
A key's events of one micro-batch are ordered by (at, seq) in memory; the source's limit of files a batch bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "status string, owner string, until long, attempt long, due long, deadline long, checkpoint string"
OUT = "key long, seq long, at timestamp, event string, worker string, accepted boolean, status string, attempt long, checkpoint string"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """Times are microseconds; timers are milliseconds, and fire once the watermark has passed them."""

    def __init__(self, max_attempts: int, backoff_seconds: int, most_backoff_seconds: int, deadline_seconds: int | None):
        self.max_attempts, self.backoff, self.most, self.deadline = max_attempts, backoff_seconds * 1_000_000, most_backoff_seconds * 1_000_000, deadline_seconds and deadline_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", STATE)

    def _read(self) -> dict:
        if not self.state.exists():
            return {"status": "pending", "owner": None, "until": 0, "attempt": 0, "due": 0, "deadline": 0, "checkpoint": None}
        return dict(zip(("status", "owner", "until", "attempt", "due", "deadline", "checkpoint"), self.state.get(), strict=True))

    def _free(self, s: dict, at: int) -> None:
        """Pending again after a while, or failed."""
        s["status"] = "failed" if s["attempt"] >= self.max_attempts else "pending"
        s["due"] = at + min(self.most, self.backoff * 2 ** max(0, s["attempt"] - 1))
        s["owner"], s["until"] = None, 0

    def _clock(self, key: int, s: dict, at: int, out: list) -> None:
        """What time alone has changed by `at`, in its order."""
        if s["status"] == "leased" and s["until"] <= at and not (s["deadline"] and s["deadline"] < s["until"]):
            end, owner = s["until"], s["owner"]
            self._free(s, end)
            out.append((key, None, end, "expired", owner, True, s))
        if s["deadline"] and s["deadline"] <= at and s["status"] in ("pending", "leased"):
            s["status"], s["owner"], s["until"] = "failed", None, 0
            out.append((key, None, s["deadline"], "deadline", None, True, s))

    def _event(self, s: dict, e) -> bool:
        at = e.at_us
        if e.event == "claim":
            if s["status"] != "pending" or s["attempt"] >= self.max_attempts or s["due"] > at:
                return False
            s["status"], s["owner"], s["until"], s["attempt"] = "leased", e.worker, at + e.lease_us, s["attempt"] + 1
        elif s["status"] != "leased" or s["owner"] != e.worker:
            return False
        elif e.event == "heartbeat":
            s["until"] = at + e.lease_us
        elif e.event == "checkpoint":
            s["checkpoint"] = e.payload
        elif e.event == "complete":
            s["status"], s["owner"], s["until"] = "completed", None, 0
        elif e.event == "fail":
            self._free(s, at)
        else:
            return False
        return True

    def _write(self, s: dict) -> None:
        self.state.update(tuple(s.values()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [t for t in (s["until"] if s["status"] == "leased" else 0, s["deadline"] if s["status"] in ("pending", "leased") else 0) if t]
        if ends:
            self.handle.registerTimer(-(-min(ends) // 1000))

    @staticmethod
    def _table(out: list) -> pd.DataFrame:
        rows = [(k, q, pd.Timestamp(at, unit="us"), e, w, a, *rest) for k, q, at, e, w, a, rest in out]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")]).astype({"seq": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        s, out = self._read(), _Log()
        for e in pd.concat(list(rows)).sort_values(["at_us", "seq"]).itertuples():
            if self.deadline and not s["deadline"]:
                s["deadline"] = e.at_us + self.deadline
            self._clock(key[0], s, e.at_us, out)
            out.append((key[0], e.seq, e.at_us, e.event, e.worker, self._event(s, e), s))
        self._write(s)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, out = self._read(), _Log()
        self._clock(key[0], s, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._write(s)
        if out:
            yield self._table(out)

    def close(self) -> None:
        pass


class _Log(list):
    """Rows with the state as it was when they were added."""

    def append(self, row: tuple) -> None:
        s = row[-1]
        super().append((*row[:-1], (s["status"], s["attempt"], s["checkpoint"])))


def transitions(events: DataFrame, max_attempts: int = 3, backoff_seconds: int = 0, most_backoff_seconds: int = 60, deadline_seconds: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """A stream of key, seq, at (timestamp), event, worker, lease_seconds, payload, as a stream of OUT: every event as it was taken or refused, and what timers did."""
    at = F.col("at").cast("timestamp")
    rows = events.select(F.col("key").cast("long").alias("key"), F.col("seq").cast("long").alias("seq"), at.alias("at"), "event", "worker", F.unix_micros(at).alias("at_us"), (F.col("lease_seconds").cast("long") * 1_000_000).alias("lease_us"), F.col("payload").cast("string").alias("payload"))
    keyed = rows.withWatermark("at", lateness).groupBy("key")
    return keyed.transformWithStateInPandas(statefulProcessor=Leases(max_attempts, backoff_seconds, most_backoff_seconds, deadline_seconds), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def run(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Runs what is available into a Parquet table; started again with the same folders, it goes on where it stopped."""
    spark = stream.sparkSession
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, was)


def table(spark: SparkSession, to: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(to)
