"""Leases as keyed state with timers: against a plain model, over a crash between batches, and with the clock alone."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.streaming import jobs, leases

START = datetime(2024, 1, 1)
SCHEMA = "key long, seq long, at timestamp, event string, worker string, lease_seconds long, payload string"


def model(rows, max_attempts=3, backoff=0, most=60, deadline=None):
    """Rows that are told for each event, in plain Python."""
    out = []
    for key in sorted({r[0] for r in rows}):
        status, owner, until, attempt, due, checkpoint, end = "pending", None, None, 0, None, None, None
        for _, seq, at, event, worker, seconds, payload in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            end = end or (deadline and at + timedelta(seconds=deadline))

            def free(when):
                return "failed" if attempt >= max_attempts else "pending", when + timedelta(seconds=min(most, backoff * 2 ** (attempt - 1)))  # noqa: B023

            if status == "leased" and until <= at and not (end and end < until):
                status, due = free(until)
            if end and end <= at and status in ("pending", "leased"):
                status = "failed"
            mine = status == "leased" and owner == worker
            ok = True
            if event == "claim":
                ok = status == "pending" and attempt < max_attempts and (due is None or due <= at)
                if ok:
                    status, owner, until, attempt = "leased", worker, at + timedelta(seconds=seconds), attempt + 1
            elif not mine or event == "noise":
                ok = False
            elif event == "heartbeat":
                until = at + timedelta(seconds=seconds)
            elif event == "checkpoint":
                checkpoint = payload
            elif event == "complete":
                status = "completed"
            elif event == "fail":
                status, due = free(at)
            out.append((key, seq, ok, status, attempt, checkpoint))
    return sorted(out)


def some(seed, n=240, keys=9):
    rng = random.Random(seed)
    kinds = ["claim"] * 4 + ["heartbeat"] * 2 + ["checkpoint", "complete", "fail", "fail", "noise"]
    return [(rng.randrange(keys), i, START + timedelta(seconds=i * 4 + rng.randrange(3)), rng.choice(kinds), f"w{rng.randrange(2)}", 20, f"p{i}") for i in range(n)]


def told(spark, to):
    return sorted((r.key, r.seq, r.accepted, r.status, r.attempt, r.checkpoint) for r in leases.table(spark, to).where("seq is not null").collect())


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("rules", [{}, {"backoff_seconds": 8, "most_backoff_seconds": 15, "max_attempts": 4}, {"deadline_seconds": 300}])
def test_against_a_plain_model_with_a_crash_between_batches(spark, tmp_path, rules):
    rows, src, to, check = some(5), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    put(spark, src, rows[:80])
    stream = lambda: leases.transitions(jobs.parquet_stream(spark, src), lateness="1 minute", **rules)
    leases.run(stream(), to, check).awaitTermination()
    put(spark, src, rows[80:150])

    def broken(pdf):
        raise RuntimeError("lost")

    bad = stream().mapInPandas(lambda batches: (broken(b) for b in batches), leases.OUT)
    with pytest.raises(Exception, match="lost|terminated"):  # the batch fails after its state was changed, before it is committed
        leases.run(bad, to, check).awaitTermination()
    put(spark, src, rows[150:])
    leases.run(stream(), to, check).awaitTermination()
    names = {"max_attempts": "max_attempts", "backoff_seconds": "backoff", "most_backoff_seconds": "most", "deadline_seconds": "deadline"}
    assert told(spark, to) == model(rows, **{names[k]: v for k, v in rules.items()})


def test_timers_free_and_fail_without_events(spark, tmp_path):
    src, to, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    at = lambda s: START + timedelta(seconds=s)
    put(spark, src, [(1, 1, at(0), "claim", "a", 10, None), (2, 2, at(0), "claim", "a", 10, None), (2, 3, at(5), "heartbeat", "a", 500, None)])
    stream = lambda: leases.transitions(jobs.parquet_stream(spark, src), max_attempts=2)
    leases.run(stream(), to, check).awaitTermination()
    put(spark, src, [(9, 4, at(60), "claim", "z", 10, None)])  # time goes on elsewhere
    leases.run(stream(), to, check).awaitTermination()
    put(spark, src, [(1, 5, at(61), "heartbeat", "a", 10, None), (1, 6, at(62), "claim", "b", 10, "x"), (9, 7, at(200), "noise", "z", 10, None)])
    leases.run(stream(), to, check).awaitTermination()
    put(spark, src, [(9, 8, at(300), "noise", "z", 10, None)])
    leases.run(stream(), to, check).awaitTermination()
    rows = [(r.key, r.event, r.accepted, r.status, r.attempt) for r in leases.table(spark, to).orderBy("at", F.col("event").desc()).collect() if r.key == 1]
    assert rows == [(1, "claim", True, "leased", 1), (1, "expired", True, "pending", 1), (1, "heartbeat", False, "pending", 1), (1, "claim", True, "leased", 2), (1, "expired", True, "failed", 2)]
    assert not [r for r in leases.table(spark, to).collect() if r.key == 2 and r.event == "expired"]
