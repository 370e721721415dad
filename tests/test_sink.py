"""The store: commits, aborts, repeated batches, several tables at once, streams; and the writes that check first."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarry import queries as Q
from quarry import session
from quarry.operators import writes
from quarry.sources import sink
from quarry.streaming import jobs


def files(path):
    return sorted(f for _, _, fs in os.walk(path) for f in fs if not f.startswith(".") and f != "written.json")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commit_abort_repeat(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.range(100).repartition(4).select("id", F.array("id").alias("list"), F.lit(None).cast("string").alias("s"))
    assert sink.write(path, "b1", {"t": a}) and not sink.write(path, "b1", {"t": a})
    assert rows(sink.read(spark, path, "t").drop("_batch")) == rows(a)
    before = files(path)

    def broken(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    bad = a.mapInPandas(broken, a.schema)
    with pytest.raises(Exception, match="lost"):
        sink.write(path, "b2", {"u": a, "t": bad})  # the first table was staged, the second fails
    assert files(path) == before and not sink.committed(path, "b2") and sink.read(spark, path, "t").count() == 100
    with pytest.raises(ValueError, match="no batch"):
        sink.read(spark, path, "u")
    assert sink.write(path, "b2", {"u": a, "t": a.where("id < 10")}) and sink.read(spark, path, "t").count() == 110
    assert rows(sink.read(spark, path, "t").groupBy("_batch").count()) == [("b1", 100), ("b2", 10)]
    assert sink.write(path, "b3", {"t": a.where("id < 0"), "empty": a.where("id < 0")}) and sink.read(spark, path, "t").count() == 110
    assert rows(sink.read(spark, path, "empty")) == []


def test_stream_batches_once(spark, tmp_path):
    src, path, check = (str(tmp_path / n) for n in ("in", "store", "c"))
    spark.range(10).coalesce(1).write.mode("append").parquet(src)
    run = lambda c: sink.stream(jobs.parquet_stream(spark, src), path, c, lambda df: {"t": df}).awaitTermination()
    run(check)
    run(str(tmp_path / "lost"))  # a checkpoint that was lost gives the same batch again
    assert sink.read(spark, path, "t").count() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    run(check)
    assert rows(sink.read(spark, path, "t").select("id")) == [(i,) for i in range(15)]


def chunk(spark, *some):
    return spark.createDataFrame([(c, m, 1, p, f"text {c}", d) for c, m, p, d in some], writes.CHUNK)


def test_chunks_are_checked_before_they_are_written(spark, tmp_path):
    path = str(tmp_path / "store")
    assert writes.put_chunks(path, "1", chunk(spark, (1, 10, None, "a"), (2, 10, 1, "b"), (3, 11, None, "c"), (3, 11, None, "c")))
    for batch, reason in ((chunk(spark, (2, 10, 1, "other"), (4, 10, None, "d")), "contradicts"), (chunk(spark, (5, 11, 1, "e")), "parent"), (chunk(spark, (6, 10, 77, "f")), "parent"), (chunk(spark, (7, 10, None, "g"), (7, 10, None, "h")), "contradicts")):
        with pytest.raises(writes.Refused) as e:
            writes.put_chunks(path, "2", batch)
        assert {r.error for r in e.value.errors.collect()} == {reason}
    assert writes.put_chunks(path, "2", chunk(spark, (1, 10, None, "a"), (4, 10, 1, "d"))) and not writes.put_chunks(path, "2", chunk(spark, (9, 9, None, "z")))
    assert [r.chunk_id for r in writes.chunks(spark, path).orderBy("chunk_id").collect()] == [1, 2, 3, 4]
    facts = spark.createDataFrame([([10, 11],), ([10],)], "source_memory_ids array<long>")
    gone = spark.createDataFrame([(10, "x"), (10, "y"), (None, "z")], "memory_id long, deletion_id string")
    assert writes.delete_memories(path, "3", gone, facts, "d1") and not writes.delete_memories(path, "3", gone, facts, "d1")
    assert [r.chunk_id for r in writes.chunks(spark, path).collect()] == [3]
    assert rows(sink.read(spark, path, "receipts").drop("_batch")) == [("d1.10", 10, 3, 2)]
    assert rows(sink.read(spark, path, "deletion_targets").select("deletion_id", "target", "status")) == [("d1.10", t, "pending") for t in ("cache", "events", "index")]
    assert writes.delete_memories(path, "4", gone, facts, "d2") and sink.read(spark, path, "receipts").count() == 1  # deleted already
    with pytest.raises(writes.Refused):
        writes.put_chunks(path, "5", chunk(spark, (12, 10, None, "late")))


def test_budgets_are_written_with_their_invocations(spark, tmp_path):
    path = str(tmp_path / "store")
    call = lambda *some: spark.createDataFrame([(i, r, "a", "ok", t, c) for i, r, t, c in some], writes.INVOCATION)
    assert writes.put_invocations(path, "1", call(("x", 1, 10, 0.5), ("x", 1, 10, 0.5), ("y", 2, 5, 0.25)))
    assert writes.put_invocations(path, "2", call(("x", 1, 10, 0.5), ("z", 1, 7, 0.125)))
    assert not writes.put_invocations(path, "2", call(("q", 1, 7, 0.125)))
    assert {r.run_id: (r.model_calls, r.tokens_used, r.ledger_cost) for r in writes.budgets(spark, path).collect()} == {1: (2, 17, 625000), 2: (1, 5, 250000)}


def test_invocations_are_compared_by_id_alone(spark, tmp_path, monkeypatch):
    """No copy of the rows is kept beside the store; ids that come twice, are known or are null, in several slices of ids."""
    monkeypatch.setattr(session, "cut", lambda df: pytest.fail("rows are written a second time"))
    monkeypatch.setattr(writes, "SLICE", 1, raising=False)
    path = str(tmp_path / "store")
    call = lambda *some: spark.createDataFrame([(i, r, "a", "ok", t, 0.5) for i, r, t in some], writes.INVOCATION)
    assert writes.put_invocations(path, "1", call(*((f"x{i}", i % 3, i) for i in range(20))))
    assert writes.put_invocations(path, "2", call(("x1", 1, 1), ("new", 1, 9), ("new", 1, 7), ("other", 2, 5), (None, 0, 3), (None, 0, 2)))
    assert rows(sink.read(spark, path, "invocations").where("_batch = '2'").select(F.coalesce("invocation_id", F.lit("")), "total_tokens")) == [("", 2), ("new", 7), ("other", 5)]
    assert writes.put_invocations(path, "3", call(*((f"x{i}", i % 3, i) for i in range(20))))
    assert writes.put_invocations(path, "4", call((None, 0, 3)))  # a null is no id that could be known
    assert rows(sink.read(spark, path, "invocations").groupBy("_batch").count()) == [("1", 20), ("2", 3), ("4", 1)]
    assert rows(writes.budgets(spark, path).select("run_id", "model_calls", "tokens_used")) == [(0, 9, 68), (1, 8, 77), (2, 7, 62)]


def test_budget_store_leaves_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(session, "_stored", {})
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", held()
    setting = spark.conf.get(name, None)
    Q.QUERIES["budget_store"](spark, "/root/testdata/sf0.001")
    deadline = time.monotonic() + 20
    while held() > before and time.monotonic() < deadline:  # files go in the background
        time.sleep(0.2)
    assert held() <= before and spark.conf.get(name, None) == setting


def test_responses(spark, tmp_path):
    path = str(tmp_path / "store")
    hits = spark.createDataFrame([(1, 7, 0.5, 2), (1, 9, 0.75, 1), (2, 7, 0.25, 1)], "query_id long, chunk_id long, score double, rank int")
    assert writes.put_responses(path, "r", hits, {"intent": "fact"})
    assert rows(sink.read(spark, path, "responses").select("body"))[0] == ('{"query_id":1,"returned":2,"hits":[{"rank":1,"chunk_id":9,"score":0.75},{"rank":2,"chunk_id":7,"score":0.5}],"trace":{"intent":"fact"}}',)


def test_events_and_cycles(spark, tmp_path):
    path = str(tmp_path / "store")
    memories = spark.createDataFrame([(1, "public", "active"), (2, "user_private", "active"), (3, "public", "deleted")], "memory_id long, scope string, status string")
    event = lambda *some: spark.createDataFrame(list(some), writes.EVENT)
    assert writes.put_events(path, "1", event((1, "public", [1]), (2, "user_private", [1, 2]), (2, "user_private", [1, 2])), memories)
    for bad in ((3, "public", [1, 2]), (4, "public", [3]), (5, "public", [99]), (6, "public", [])):
        with pytest.raises(writes.Refused):
            writes.put_events(path, "2", event((1, "public", [1]), bad), memories)
    assert writes.put_events(path, "2", event((1, "public", [1]), (7, "public", [1])), memories) and rows(sink.read(spark, path, "events").select("event_id")) == [(1,), (2,), (7,)]
    assert writes.record_cycle(spark, path, "a", "gc", "2024-01-01 00:00:00", "{}") and not writes.record_cycle(spark, path, "a", "gc", "2025-01-01 00:00:00", "{}")
    assert sink.read(spark, path, "cycles").count() == 1
