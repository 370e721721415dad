"""Every query with SQL against DuckDB; sequential operators against plain models; streams against batches."""

import hashlib
import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import queries as Q
from quarry.operators import chunking, evidence, governance, graph, lifecycle, retrieval
from quarry.operators import visibility as vis
from quarry.sources import parsers
from quarry.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    rel = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_selection_stops_and_skips():
    plan = {"context_k": 5, "min_context_k": 2, "max_context_tokens": 100, "score_floor": 0.3, "marginal_gain_floor": 0.5, "max_chunks_per_source": 2}
    c = lambda i, s, t=10, src="a", e=("x",): {"chunk_id": i, "score": s, "token_count": t, "source_type": src, "entity_keys": list(e)}

    def run(rows, **more):
        taken, _, why = evidence.select(rows, plan | more)
        return [x["chunk_id"] for x in taken], why

    assert run([c(i, 1.0, e=(str(i),)) for i in range(9)]) == ([0, 1, 2, 3, 4], "context_k")
    assert run([c(1, 0.9), c(2, 0.8), c(3, 0.2)]) == ([1, 2], "score_floor")
    assert run([c(1, 1.0), c(2, 0.9), c(3, 0.4)]) == ([1, 2], "marginal_gain")
    assert run([c(1, 1.0), c(2, 0.95), c(3, 0.8)], relative_floor=0.84) == ([1, 2], "relative_floor")
    assert run([c(1, 1.0, 60), c(2, 0.9, 50), c(3, 0.8, 1)]) == ([1], "token_budget")
    assert run([c(1, 1.0), c(2, 1.0), c(3, 1.0), c(4, 1.0, src="b"), c(5, 1.0, e=("y",))]) == ([1, 2, 4, 5], "exhausted")
    assert run([c(1, float("nan")), c(2, -1.0)]) == ([], "exhausted")


def test_expansion_and_substitution():
    near = {1: [{"chunk_id": 3, "priority": 0.4, "token_count": 5}, {"chunk_id": 2, "priority": 1.0, "token_count": 50}, {"chunk_id": 4, "priority": 0.8, "token_count": 5}]}
    assert evidence.expand([{"chunk_id": 1, "token_count": 10}], near, 30) == [1, 4, 3]
    with pytest.raises(ValueError):
        evidence.expand([{"chunk_id": 1, "token_count": 31}], near, 30)
    h = lambda i, s, p: {"chunk_id": i, "score": s, "token_count": 10, "parent_id": p, "parent_tokens": 25}
    assert evidence.substitute([h(1, 0.5, 9), h(2, 0.9, 9), h(3, 0.4, None)], 60) == [(9, 0.9, 25), (3, 0.4, 10)]
    assert evidence.substitute([h(1, 0.5, 9)], 20) == [(1, 0.5, 10)]


def test_fusion_ties(spark):
    lists = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1), (1, "b", 10, 2), (1, "b", 12, 3)], "query_id long, retriever string, chunk_id long, rank int")
    got = [(r.chunk_id, r.agreement, r.position) for r in retrieval.fuse(lists).orderBy("position").collect()]
    assert got == [(10, 2, 1), (11, 2, 2), (12, 1, 3)]


def test_vector_filter_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)], "chunk_id long, embedding array<double>")
    q = v.where("chunk_id < 25").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, retrieval.vector(v, q, 4).collect()))
    monkeypatch.setattr(retrieval, "MOST_BROADCAST_QUERIES", 7)
    assert sorted(map(tuple, retrieval.vector(v, q, 4).collect())) == whole
    assert all(r.chunk_id == r.query_id for r in retrieval.vector(v, q, 1).collect())


def test_markdown_chunks():
    drafts = chunking.markdown("intro\n\n# A\n\nfirst\n\n## B\nsecond\nline\n# C\n\n" + "x" * 2500)
    assert [d["path"] for d in drafts if d["level"] == "parent"] == [["document"], ["A"], ["A", "B"], ["C"]]
    assert [len(d["content"]) <= 1200 for d in drafts if d["level"] == "child"] == [True] * 6
    assert drafts[3]["content"] == "# A\nfirst" and all(d["parent"] is not None for d in drafts if d["level"] == "child")
    assert [len(g) for g in chunking.pack(["a" * 5, "b" * 5, "c" * 12], 12)] == [2, 1]
    assert chunking.whole_or_paragraphs("a" * 10) == ["a" * 10] and len(chunking.whole_or_paragraphs("\n\n".join(["p" * 300] * 30), 1000)) == 10
    assert len(chunking.contextual("# T\n\n" + "\n\n".join(["w" * 300] * 5), "doc")) == 3


def test_other_chunkers():
    t = chunking.table("s", ["h", "k"], [["1", "2"], ["3", "4"], ["5", "6"]], 24)
    assert [d["locator"] for d in t] == ["s!1-3", "s!1-1", "s!2-2", "s!3-3"] and chunking.table("s", ["h"], [])[1]["content"] == "h"
    turns = [{"sequence": k, "role": "user", "text": "hello"} for k in (2, 1, 3)]
    assert [d["locator"] for d in chunking.conversation(turns, parent=41)] == ["turns 1-1", "turn 1", "turns 2-2", "turn 2", "turns 3-3", "turn 3"]
    with pytest.raises(ValueError):
        chunking.conversation([turns[0], turns[0]])
    pages = [{"page": 2, "blocks": [{"text": "b"}]}, {"page": 1, "blocks": [{"kind": "heading", "text": "H", "heading_level": 1}, {"text": "a"}]}]
    assert [d["path"] for d in chunking.layout(pages) if d["level"] == "parent"] == [["page 1", "H"], ["page 2", "H"]]
    nodes = [{"root_index": 0, "depth": 0, "kind": "class", "name": "A", "text": "class A", "start_line": 1, "end_line": 9}, {"root_index": 0, "depth": 1, "kind": "method", "name": "m", "text": "m()", "start_line": 2, "end_line": 3}]
    assert [d["path"] for d in chunking.code(nodes)] == [["A"], ["A", "m"]]


def test_positioned_lines():
    item = lambda t, x, y: {"text": t, "x": x, "y": y, "width": 10, "height": 10}
    assert [b["text"] for b in parsers.line_blocks([item("b", 20, 101), item("a", 0, 100), item("c", 0, 80)])] == ["a b", "c"]


def test_workbook_and_archive_limits():
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>h</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert parsers.workbook_tables(data.getvalue()) == [("S", ["h", "k"], [["", "7"]])]
    with pytest.raises(ValueError):
        parsers.safe_archive(data.getvalue(), most=10)


def test_machine_replay(spark):
    rows = [(1, 1, "finding_created", 0, 1), (1, 1, "finding_created", 0, 2), (1, 2, "plan_created", 0, 3), (1, 3, "plan_created", 1, 4), (1, 4, "plan_approved", None, 5), (1, 5, "request_human", None, 6)]
    r = lifecycle.replay(spark.createDataFrame(rows, "entity_id long, event_id long, event string, expected_version long, seq long"), lifecycle.EVOLUTION_RUN, "observed").first()
    assert (r.state, r.version, r.stale, r.illegal, r.repeated) == ("needs_human", 3, 1, 1, 1)


def test_paths_cycles_and_conflicts(spark):
    e = [("A", "B", "none"), ("B", "C", "none"), ("A", "D", "none"), ("C", "A", "none"), ("D", "E", "conflict")]
    edges = spark.createDataFrame(e, "source_node_id string, target_node_id string, conflict_status string")
    pairs = spark.createDataFrame([("A", "C"), ("A", "E"), ("D", "A")], "start string, target string")
    assert {(r.start, r.target): (r.path, r.hops) for r in graph.shortest_paths(edges, pairs).collect()} == {("A", "C"): ("A>B>C", 2), ("A", "E"): (None, None), ("D", "A"): (None, None)}
    assert {(r.start, r.target): r.hops for r in graph.shortest_paths(edges, pairs, both_ways=True).collect()}[("D", "A")] == 1
    plain = edges.select(F.col("source_node_id").alias("parent"), F.col("target_node_id").alias("child"))
    asked = spark.createDataFrame([("B", "A"), ("A", "A"), ("D", "B"), ("A", "E")], "parent string, child string")
    assert {(r.parent, r.child) for r in graph.would_cycle(plain, asked).collect()} == {("B", "A"), ("A", "A"), ("D", "B")}
    nodes = spark.createDataFrame([(x,) for x in "ABCDE"], "node string")
    assert {r.node: r.wave for r in graph.waves(nodes, plain).collect()} == dict.fromkeys("ABCDE")
    assert {r.node: r.wave for r in graph.waves(nodes, plain.where("child <> 'A'")).collect()} == {"A": 0, "B": 1, "D": 1, "C": 2, "E": 2}


def test_visibility_never_leaks(spark):
    rows = [(1, "public", "t2", "system"), (2, "user_private", "t1", "u1"), (3, "user_private", "t1", "u2"), (4, "user_private", "t2", "u1"), (5, "session", "t1", "s1"), (6, "tenant", "t1", "t1")]
    m = spark.createDataFrame([(*r, "active") for r in rows], "memory_id long, scope string, tenant_id string, owner_id string, status string")
    acl = spark.createDataFrame([(3, "role", "r", "read"), (4, "user", "u1", "read")], "memory_id long, principal_type string, principal_id string, permission string")
    got = lambda p: {r.memory_id for r in vis.readable_memories(m, acl, p).collect()}
    assert got(vis.Principal("t1", user_id="u1")) == {1, 2, 6} and got(vis.Principal("t1", role_ids=("r",))) == {1, 3, 6}


def test_storm_blocks_match_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(i, "k%d" % rng.randrange(3), rng.randrange(5000)) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, k string, t long").withColumn("occurred_from", F.timestamp_seconds("t"))
    got = {r.event_id: r.observations for r in governance.storms(df, ["k"], 100, 3).collect()}
    want = {i: n for i, k, t in rows if (n := sum(k2 == k and t - 100 <= t2 <= t for _, k2, t2 in rows)) > 3}
    assert got == want


def test_streams_match_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i % 2, i % 7, 1704067200 + 60 * i) for i in range(40)]
    batch = spark.createDataFrame(rows, "c long, e long, t long").select(F.concat(F.lit("c"), "c").alias("consumer"), F.col("e").alias("event_id"), F.timestamp_seconds("t").alias("received_at"))
    batch.coalesce(1).write.parquet(src)
    got = jobs.run_to_table(jobs.receipts(jobs.parquet_stream(spark, src), "2 hours"), "receipts", str(tmp_path / "c1"))
    assert got.count() == governance.first_receipts(batch).count() == 14
    seen = jobs.run_to_table(jobs.storms(jobs.parquet_stream(spark, src).withColumnRenamed("received_at", "occurred_from"), ["consumer"], "10 minutes", "5 minutes", 4, "1 minute"), "storms", str(tmp_path / "c2"), "complete")
    assert seen.where("observations > 4").count() == seen.count() > 0
    box = str(tmp_path / "box")
    batch.limit(3).select("event_id").withColumn("attempts", F.lit(0)).coalesce(1).write.parquet(box)
    jobs.dispatch(jobs.parquet_stream(spark, box), lambda b, _: b.select("event_id", (F.col("event_id") != 1).alias("ok")), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert {r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"published", "retry"}


def test_artifact_digest(spark, tmp_path):
    import hashlib

    (tmp_path / "a.md").write_text("# x\n")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    url = lambda n: f"file:{tmp_path / n}"
    cited = spark.createDataFrame([(url("a.md"), "sha256:" + hashlib.sha256(b"# x\n").hexdigest()), (url("b.md"), "sha256:" + hashlib.sha256(b"\xff\xfe").hexdigest()), (url("c.md"), "")], "path string, digest string")
    assert {r.path[-4:]: r.error for r in parsers.text_artifacts(spark, str(tmp_path), cited).collect()} == {"a.md": None, "b.md": "encoding", "c.md": "missing"}
    assert parsers.markdown_corpus(spark, str(tmp_path)).count() == 2


def test_evidence_takes_every_query(spark):
    asked = {r.query_id for r in Q.QUERIES["lexical_topk"](spark, SF).collect()}
    planned = {r.query_id for r in Q.QUERIES["plan_table"](spark, SF).select("query_id").collect()}
    assert max(asked) > 10 and asked <= planned
    rows = lambda name: {r.query_id for r in Q.QUERIES[name](spark, SF).collect()}
    assert rows("evidence_selection") - set(range(10))  # a plan may take none of a query's chunks
    assert asked <= rows("parent_substitution")


def test_no_query_or_document_is_left_out(spark, monkeypatch, tmp_path):
    rows = [(1, "a - - b"), (2, "- | x"), (3, "plain a-b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.digest for r in Q.QUERIES["tsquery_sanitise"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in ((1, "a b"), (2, "x"), (3, "plain a-b"))}
    hits = spark.createDataFrame([(1, 10, 0.5, 150_000, 1), (1, 16, 0.4, 150_000, 2), (2, 12, 0.3, 10, 1)], "query_id long, chunk_id long, score double, token_count long, position int")
    monkeypatch.setattr(Q, "_candidates", lambda *_: hits)
    assert {(r.query_id, r.chunk_id) for r in Q.QUERIES["parent_substitution"](spark, SF).collect()} == {(1, 10), (1, 16), (2, 10)}
