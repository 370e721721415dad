"""The pipeline's stages, each against what its operator says of the stage's own input, and the registered SQL."""

import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import decontam, jaccard, packing, pii, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        rows = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
            docs = spark.createDataFrame(list(rows.values()), before.schema)
        kept[name] = (before, rows)
    before, rows = kept["quality"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows) == {r.doc_id for r in quality.score(before, model).collect() if r.predicted}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in rows for d in good) >= 0.97 * len(good)
    before, rows = kept["near_duplicates"]
    assert set(rows) == {r.doc_id for r in jaccard.link_classes(before).collect() if r.doc_id == r.component_id}
    before, rows = kept["decontamination"]
    leaked = {r.doc_id for r in decontam.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and set(rows) == {r.doc_id for r in before.collect()} - leaked
    before, rows = kept["personal_data"]
    old = {r.doc_id: r for r in before.collect()}
    assert set(rows) == set(old)
    for d, r in rows.items():
        assert r.text == pii.redacted(old[d].text) and (r.text == old[d].text or r.n_chars == len(r.text)) and not [s for s in pii.spans(r.text) if s[0] in ("email", "card", "phone")]
    before, pieces = kept["packing"]
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert all(p.doc_tokens == tokens[p.doc_id] for p in pieces) and set(tokens) == {r.doc_id for r in before.collect()}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95
    good, bad = [r.score for r in rows if labels[r.doc_id] == 1], [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_vocabulary_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    assert packing.pack(docs, vocabulary=packing.default_vocabulary()).count() == 2


def test_near_duplicates_of_rows_without_or_with_the_same_doc_id(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(2)), (7, text(3)), (9, text(2)), (5, text(4)), (None, text(4)), (None, ""), (8, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (5, text(4)), (None, ""), (8, None)], key=str)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with the operators' own, and an empty table."""
    words = lambda k, n: " ".join(f"w{k}x{j} and" for j in range(n)) + "."
    rows = [(k, words(k, 40), "en", "s", 9, "clash", k, True) for k in range(60)]
    rows += [(k, "!!! BUY NOW !!! " * 30, "en", "s", 9, "clash", k, True) for k in range(60, 90)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "s", 0, "", 0, False), (None, words(200, 40), "en", "s", 9, "x", 1, True), (None, None, None, None, None, None, None, None), (5, words(5, 40), "en", "s", 9, "clash", 5, True), (102, words(300, 30_000), "en", "s", 9, "x", 1, True), (103, words(400, 40) + " mail a.b@c.de", "en", "s", 9, "x", 1, True)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, part string, block long, shared boolean"
    docs = spark.createDataFrame(rows, kind).repartition(3)
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(7, 40)), (2, None), (None, words(8, 40)), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, kept, str(tmp_path))
            assert after.columns == docs.columns and after.schema == docs.schema, name
            kept = spark.createDataFrame(after.collect(), docs.schema)
        got = kept.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in got} - {None}
        if start is docs:
            ids = [r.doc_id for r in got]
            assert ids.count(5) == 1 and 7 not in ids and 8 in ids and {102, 103} <= set(ids) and not {60, 75} & set(ids)
            assert next(r.text for r in got if r.doc_id == 103).endswith("mail <EMAIL>") and any(r.doc_id is None and r.text for r in got)
        else:
            assert not got and not pieces
