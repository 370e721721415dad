"""VARIANT functions against plain models of JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import variants


def holds(value, wanted, top=True):
    """The containment of JSON values, with types told apart."""
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(holds(e, w, False) for e in value) for w in wanted)
    if top and isinstance(value, list):
        return any(holds(e, wanted, False) for e in value)
    if isinstance(value, dict | list) or isinstance(value, bool) != isinstance(wanted, bool):
        return False
    return value == wanted and (value is None) == (wanted is None) and isinstance(value, str) == isinstance(wanted, str)


def some(rng, depth=3):
    kind = rng.randrange(8 if depth else 6)
    if kind < 6:
        return rng.choice([None, True, False, 7, 7.0, -3, 2.5, 10**12, "7", "", "a b", "é'\""])
    if kind == 6:
        return [some(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "a.b", "x y", "z"]): some(rng, depth - 1) for _ in range(rng.randrange(4))}


def part(rng, v):
    """Something that v holds, more or less."""
    if isinstance(v, dict):
        return {k: part(rng, x) for k, x in v.items() if rng.random() < 0.7}
    if isinstance(v, list):
        return [part(rng, x) for x in v if rng.random() < 0.7]
    return v if rng.random() < 0.8 else some(rng, 0)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    return [some(rng) for _ in range(150)] + [{"k": "7"}, {"k": 7}, {"k": 7.0}, {"k": None}, {}, [], [{"k": [1, {"z": 2}]}], ["a", 7]]


def test_containment(spark, docs):
    rng = random.Random(12)
    wanted = [part(rng, rng.choice(docs)) for _ in range(40)] + [{"k": 7}, {"k": "7"}, {"k": None}, 7, "a", None, [[]], {}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{bad"), (902, '{"k":1,"k":2}')], "i long, j string").select("i", variants.parse(F.col("j")).alias("v"))
    for k in range(0, len(wanted), 12):
        some_ = wanted[k : k + 12]
        for r in rows.select("i", *(variants.contains(F.col("v"), w).alias(f"w{n}") for n, w in enumerate(some_))).collect():
            for n, w in enumerate(some_):
                assert r[f"w{n}"] == (r.i < 900 and holds(docs[r.i], w)), (r.i, w)


def test_text_kinds_and_canonical(spark):
    rows = [
        ('{"b":{"z":1,"a":[3,{"y":2,"x":null}]},"a":"7"}', '{"a":"7","b":{"a":[3,{"x":null,"y":2}],"z":1}}', "object"), (' [ 1 , "a" ] ', '[1,"a"]', "array"), ("null", "null", "null"), ("true", "true", "boolean"), ("1.50", "1.5", "number"), ('"x"', '"x"', "string"), ("{", None, None), (None, None, None), ("", None, None),
    ]
    v = variants.parse(F.col("j"))
    df = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(rows)], "i int, j string")
    got = df.select("i", variants.canonical(F.col("j")).alias("c"), variants.kind(v).alias("k"), variants.text_at(v, "a").alias("a"), variants.text_at(v, "b").alias("b"), variants.text_at(v, "b", "a", 1, "x").alias("x"), variants.text_at(v, 1).alias("one")).collect()
    assert {r.i: (r.c, r.k) for r in got} == {i: (c, k) for i, (_, c, k) in enumerate(rows)}
    first = next(r for r in got if r.i == 0)
    assert (first.a, first.b, first.x, first.one) == ("7", '{"a":[3,{"x":null,"y":2}],"z":1}', None, None) and next(r for r in got if r.i == 1).one == "a"


def test_fields(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[2]}'), (2, '["x",null]'), (3, "5"), (4, None), (5, "{}")], "i int, j string").select("i", variants.parse(F.col("j")).alias("v"))
    got = sorted((r.i, r.pos, r.key, r.kind) for r in variants.fields(df, "v").where("pos is not null").collect())
    assert got == [(1, 0, "a", "number"), (1, 1, "b", "array"), (2, 0, None, "string"), (2, 1, None, "null")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("{}",)], "j string").select(variants.contains(variants.parse(F.col("j")), {"a": [1]}).alias("c"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
