"""Run traces over streams of different shapes: pages of a run that is in many parts, and reading on by key."""

from datetime import datetime, timedelta

from quarry.operators import ledger


def streams(spark):
    at = lambda i: datetime(2024, 1, 1) + timedelta(seconds=i % 50)  # noqa: E731  ties
    a = spark.createDataFrame([(1 if i % 3 else i % 7, at(i), i, "x", i * 1.5) for i in range(600)] + [(None, at(0), 1, "no run", 0.0), (1, None, 2, "no time", 0.0)], "run_id long, occurred_at timestamp_ntz, activity_id long, what string, cost double")
    b = spark.createDataFrame([(1, at(i), f"b{i}", [i]) for i in range(40)], "run_id long, occurred_at timestamp_ntz, activity_id string, list array<int>")
    return {"a": a, "b": b, "none": a.limit(0), "bare": a.limit(3).select("run_id", "occurred_at", "activity_id")}


def test_pages_of_a_run_that_is_in_many_parts(spark):
    rows = ledger.merged(streams(spark))
    want = {}
    for r in sorted((r for r in rows.collect()), key=lambda r: (r.run_id, r.occurred_at, r.activity_id, r.kind)):
        want.setdefault(r.run_id, []).append((r.occurred_at, r.activity_id, r.kind))
    got = {}
    for r in ledger.paged(rows, 7).collect():
        got.setdefault(r.run_id, {})[r.place] = ((r.occurred_at, r.activity_id, r.kind), r.page)
    assert set(got) == set(want)
    for run, own in want.items():
        assert [got[run][i + 1] for i in range(len(got[run]))] == [(k, i // 7) for i, k in enumerate(own)]


def test_details_and_reading_on_by_key(spark):
    rows = ledger.merged(streams(spark))
    assert {r.details for r in rows.where("kind = 'b' and activity_id = 'b3'").collect()} == {'{"list":[3]}'} and rows.where("kind = 'bare' and details <> '{}'").count() == 0
    whole = [(r.occurred_at, r.activity_id, r.kind) for r in ledger.page_after(rows, 1, size=10_000).collect()]
    read, after = [], None
    while page := [(r.occurred_at, r.activity_id, r.kind) for r in ledger.page_after(rows, 1, after, 150).collect()]:
        read += page
        after = (str(page[-1][0]), *page[-1][1:])
    assert read == whole == sorted(whole) and len(whole) > 300
