"""Evaluation roll-ups: scenarios, answers, labelled corpora, evaluation sets, admission of model routes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def scenario_rollup(runs: DataFrame) -> DataFrame:
    """runs: scenario, query_id, reciprocal_rank, average_precision, returned, coverage, status, fused, authorized, denied, selected.

    One row per scenario: means, and how many queries were insufficient or empty.
    """
    mean = lambda c: F.round(F.avg(c), 6)
    return runs.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("queries"), mean("reciprocal_rank").alias("mrr"), mean("average_precision").alias("map"), mean("returned").alias("mean_returned"), mean("coverage").alias("mean_coverage"),
        F.count_if(F.col("status") == "insufficient").alias("insufficient_queries"), F.count_if(F.col("returned") == 0).alias("empty_queries"),
        *(mean(c).alias(f"mean_{c}") for c in ("fused", "authorized", "denied", "selected")),
    )


def histogram(rows: DataFrame, key: list[str], value: str, unknown: str = "unknown") -> DataFrame:
    """How often each value comes, a missing one counting as `unknown`."""
    return rows.groupBy(*key, F.coalesce(F.col(value).cast("string"), F.lit(unknown)).alias(value)).agg(F.count(F.lit(1)).alias("n"))


SCORES = ("faithfulness", "relevance", "completeness")


def answer_quality(answers: DataFrame, by: str = "scenario") -> DataFrame:
    """answers: by, query_id, the judge's scores (null: not judged), citation_precision, evidence, answer_chars, input_tokens, output_tokens.

    Means are over judged answers only; tokens are summed over all.
    """
    judged = F.col("faithfulness").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(judged, F.col(c))), 3)
    return answers.groupBy(by).agg(F.count(F.lit(1)).alias("queries"), F.count_if(judged).alias("judged"), *(mean(c).alias(f"mean_{c}") for c in (*SCORES, "citation_precision", "evidence", "answer_chars")), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def score_distribution(answers: DataFrame, by: str = "scenario") -> DataFrame:
    """by, measure, score, n of the judged answers."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("score")) for c in SCORES)))
    return answers.where("faithfulness is not null").select(by, each.alias("x")).groupBy(by, "x.measure", "x.score").agg(F.count(F.lit(1)).alias("n"))


def citation_precision(evidence: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """query_id, citation_precision: the share of a query's evidence whose grade is at least `least`; unlabelled evidence has grade 0."""
    rows = evidence.join(labels.select("query_id", "chunk_id", "grade"), ["query_id", "chunk_id"], "left")
    return rows.groupBy("query_id").agg(F.round(F.count_if(F.coalesce("grade", F.lit(0)) >= least) / F.count(F.lit(1)), 6).alias("citation_precision"))


def relevant_counts(chunks: DataFrame, prefix: str = "topic.") -> DataFrame:
    """topic, relevant: chunks by the first of their entity keys that begins with the prefix; those without one are left out."""
    key = F.get(F.filter("entity_keys", lambda k: k.startswith(prefix)), 0)
    return chunks.select(F.substring(key, len(prefix) + 1, 1 << 20).alias("topic")).where("topic is not null and topic <> ''").groupBy("topic").agg(F.count(F.lit(1)).alias("relevant"))


def labelled_corpus(spark: SparkSession, topics: int = 32, facets: int = 4, depth: int = 3, distractors: int = 8, uneven: tuple[int, ...] = (1, 2, 4), of: DataFrame | None = None) -> DataFrame:
    """doc_id, topic, facet, level, copy, grade, distractor, digest: topic x facet x depth, with relevant sets of uneven size.

    Level 0 is graded 3, the next 2, deeper ones 1; distractor topics are graded 0. Topic t has uneven[t mod n] copies of each.
    of: topic and distractor, the topics themselves, in place of their numbers.
    """
    times = F.element_at(F.array(*map(F.lit, uneven)), (F.col("topic") % len(uneven) + 1).cast("int"))
    named = spark.range(topics + distractors).select(F.col("id").alias("topic"), (F.col("id") >= topics).alias("distractor")) if of is None else of.select("topic", "distractor")
    grid = named.withColumn("facet", F.explode(F.sequence(F.lit(0), F.lit(facets - 1)))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    rows = grid.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in ("topic", "facet", "level", "copy")))
    grade = F.when(F.col("distractor"), 0).when(F.col("level") == 0, 3).when(F.col("level") == 1, 2).otherwise(1)
    return rows.select(name.alias("doc_id"), "topic", F.col("facet").cast("long").alias("facet"), F.col("level").cast("long").alias("level"), F.col("copy").cast("long").alias("copy"), grade.cast("long").alias("grade"), "distractor", F.substring(F.sha2(name, 256), 1, 16).alias("digest"))


# --- canonical JSON and evaluation sets ---


def canonical_json(value: Any) -> str:
    """JSON without blanks, keys of every object in order; what JSON cannot hold (NaN, other types) is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_struct(columns: list[str]) -> Column:
    """The same for columns of a row: a struct with its fields in order; nulls stay."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


MOST_SET_BYTES = 5_000_000
CASE = "case_id string, stage string, query string, purpose string, max_results int, expected_memory_ids array<string>, forbidden_memory_ids array<string>"


def evaluation_set(spark: SparkSession, data: bytes, most: int = MOST_SET_BYTES) -> DataFrame:
    """The cases of an evaluation set, a JSON object {evaluation_set_id, cases, digest}; the digest must be that of the rest, canonical.

    Case ids must be unique, stages known, and every case must expect or forbid something.
    """
    if len(data) > most:
        raise ValueError("the evaluation set is too large")
    doc = json.loads(data.decode("utf-8"))
    if not isinstance(doc, Mapping) or not isinstance(doc.get("cases"), list) or not doc["cases"]:
        raise ValueError("an evaluation set holds cases")
    own = "sha256:" + hashlib.sha256(canonical_json({k: v for k, v in doc.items() if k != "digest"}).encode()).hexdigest()
    if doc.get("digest") != own:
        raise ValueError("the digest does not match the evaluation set")
    rows = []
    for c in doc["cases"]:
        wanted, never = c.get("expected_memory_ids") or [], c.get("forbidden_memory_ids") or []
        if c.get("stage") not in ("lexical", "vector", "hybrid") or not (wanted or never) or not c.get("query"):
            raise ValueError(f"case {c.get('case_id')} is malformed")
        rows.append((c["case_id"], c["stage"], c["query"], c.get("purpose"), int(c.get("max_results", 10)), wanted, never))
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a case id repeats")
    return spark.createDataFrame(rows, CASE)


# --- model routes ---


def admitted_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Per request, the first route by priority that its budget allows: request_id, route, output_tokens, estimated_cost (null: none).

    requests: request_id, system_prompt, user_prompt, max_output_tokens, max_tokens, max_cost; routes: route, priority, context_window,
    max_output, input_cost, output_cost (a million tokens). Routes are a dimension.
    """
    tokens = lambda c: F.greatest(F.lit(1), F.ceil(F.length(c) / 4))
    rows = requests.select("request_id", (tokens("system_prompt") + tokens("user_prompt")).cast("long").alias("_in"), "max_output_tokens", "max_tokens", "max_cost")
    each = rows.withColumn("_on", F.lit(1)).join(F.broadcast(routes.withColumn("_on", F.lit(1))), "_on")
    out = F.least("max_output_tokens", "max_output", F.col("context_window") - F.col("_in"), F.col("max_tokens") - F.col("_in"))
    cost = (F.col("_in") * F.col("input_cost") + out * F.col("output_cost")) / 1_000_000
    fit = each.withColumns({"output_tokens": out, "estimated_cost": F.round(cost, 9)}).where((F.col("output_tokens") > 0) & (cost <= F.col("max_cost")))
    first = fit.withColumn("_n", F.row_number().over(W.Window.partitionBy("request_id").orderBy("priority", "route"))).where("_n = 1").select("request_id", "route", "output_tokens", "estimated_cost")
    return requests.select("request_id").join(first, "request_id", "left")


# --- names and conversations ---

#: Words in a file name, and the domain or type that they stand for; the first that is there counts.
DOMAINS = (("seckill", "seckill"), ("order", "order"), ("pay", "pay"))
TYPES = (("spec", "spec"), ("规范", "spec"), ("case", "defect_case"), ("案例", "defect_case"))


def guess(name: Column, words: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    out = None
    for word, means in words:
        has = F.lower(name).contains(word)
        out = F.when(has, means) if out is None else out.when(has, means)
    return out.otherwise(otherwise)


def evidence_metadata(turns: DataFrame) -> DataFrame:
    """Per conversation: earliest start, latest end, least confidence, and the language where all turns agree.

    turns: memory_id, start_ms, end_ms, confidence, language; what no turn has is null.
    """
    lang = F.when(F.countDistinct("language") == 1, F.max("language"))
    return turns.groupBy("memory_id").agg(F.min("start_ms").alias("media_start_ms"), F.max("end_ms").alias("media_end_ms"), F.min("confidence").alias("confidence"), lang.alias("language"))
