"""The stored inverted index against the search that reads texts: same rows, whatever the shards, the queries and what is allowed."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import postings, retrieval

WORDS = ["amber", "birch", "cedar", "delta", "ember", "the", "of", "fjord"]
QUERIES = [
    "amber birch", '"amber birch" cedar', "amber -delta", "amber or birch", "ember", '"cedar delta" or "delta cedar"', "the of", "amber amber", "統一資料 amber", "資料庫", "", "--- |", "nowhere", "amber birch cedar delta ember fjord",
    '-"amber birch" cedar', "amber or birch cedar", "a-b.c fjord", "or", '"amber', "birch delta -fjord or ember",
]


def texts(n=160, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = " ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 1, 2, 3, 8, 30))))
        out.append((i * 3 + 1, t + rng.choice(["", "", " 統一資料庫", " 資料", " A-B.c amber_x"])))
    return [*out, (5000, None), (5001, ""), (5002, "amber " * 3000), (5003, "Amber Birch CEDAR")]


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts()], "chunk_id long, content string, term string, shard string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, q, 1 + i % 4) for i, q in enumerate(QUERIES)], "query_id long, query string, k int")


@pytest.fixture(scope="module")
def stored(spark, chunks, tmp_path_factory):
    return postings.Stored.build(chunks.where("chunk_id < 400"), str(tmp_path_factory.mktemp("p") / "index"), shard_chunks=7, shard_tokens=120)


def test_same_rows_as_the_search_over_texts(spark, chunks, queries, stored):
    some = chunks.where("chunk_id < 400")
    assert hits(stored.search(queries, 5)) == hits(retrieval.lexical(some, queries, 5))
    assert hits(stored.search(queries, "k", least=1)) == hits(retrieval.lexical(some, queries, "k", least=1))


def test_insert_and_allowed(spark, chunks, queries, tmp_path):
    stored = postings.Stored.build(chunks.where("chunk_id < 100"), str(tmp_path / "index"), shard_chunks=5, shard_tokens=60)
    stored.insert(chunks.where("chunk_id >= 100"))
    stored = postings.Stored.open(spark, stored.path)
    assert hits(stored.search(queries, 4)) == hits(retrieval.lexical(chunks, queries, 4))
    allowed = chunks.where("chunk_id % 5 < 2").select("chunk_id", F.lit("x").alias("shard"))
    assert hits(stored.search(queries, 4, allowed=allowed)) == hits(retrieval.lexical(chunks.where("chunk_id % 5 < 2"), queries, 4))
    assert stored.search(queries, 4, allowed=allowed.limit(0)).count() == 0


def test_blocks_of_queries_and_thresholds(spark, chunks, queries, stored, monkeypatch):
    want = hits(retrieval.lexical(chunks.where("chunk_id < 400"), queries, 2))
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "SEEDS", 1)
    assert hits(stored.search(queries, 2)) == want


def test_queries_without_text_make_no_blocks(spark, queries, stored, monkeypatch):
    """A batch may hold many queries that have only a vector."""
    asked, block = [], postings.Stored._block
    monkeypatch.setattr(postings.Stored, "_block", lambda self, spark, a, limits: asked.append(len(a.ids)) or block(self, spark, a, limits))
    monkeypatch.setattr(postings, "BLOCK", 32)
    silent = spark.range(100, 400).selectExpr("id as query_id", "cast(null as string) as query", "1 as k")
    assert hits(stored.search(queries.unionByName(silent), 2)) == hits(stored.search(queries, 2))
    assert asked == [len(QUERIES)] * 2


def test_thresholds_leave_shards_out(spark, stored):
    """Shards are ordered by length, so that the first ones hold what a common word is found in most often."""
    asked = postings.Asked.of([{"query_id": 1, "latin": ["amber"], "han": [], "units": [{"alternative": 0, "excluded": False, "terms": ["amber"]}]}], 2, 2)
    rows = stored.table(spark).where("term = 'amber'").selectExpr("0 as t", "shard", "most")
    bounds = [r.bound for r in rows.groupBy("shard").applyInArrow(postings._bound(asked), "shard long, q int, bound double").collect()]
    kth = max(r.score for r in stored.search(spark.createDataFrame([(1, "amber")], "query_id long, query string"), 2).where("rank = 2").collect())
    assert len(bounds) > 5 and sum(b >= kth for b in bounds) < len(bounds) / 2


def test_only_folders_of_the_terms_and_no_positions_are_read(spark, stored):
    table = stored.table(spark).where("bucket in (1)").select("shard", "docs", "tfs")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "positions" not in plan.partition("ReadSchema")[2]
    terms = [r.term for r in stored.table(spark).where("bucket >= 0").groupBy("term", "shard").count().where("count > 1").collect()]
    assert terms == []  # one block a term and shard


def test_empty_tables(spark, queries, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, content string")
    stored = postings.Stored.build(none, str(tmp_path / "index"))
    assert stored.search(queries, 3).collect() == []
    assert stored.search(queries.limit(0), 3).collect() == []
    stored.insert(spark.createDataFrame([(1, "amber birch")], "chunk_id long, content string"))
    assert [r.chunk_id for r in stored.search(queries.where("query_id = 0"), 3).collect()] == [1]
