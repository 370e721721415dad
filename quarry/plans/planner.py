"""Retrieval plans for a batch of requests: constants by intent, joined and scaled as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intent, candidate_k, fusion_k, rerank_k, context_k, score_floor, marginal_gain_floor, structured answer, stages.
INTENTS = (
    ("fact_lookup", 24, 36, 18, 11, 0.42, 0.15, False, ["lexical", "vector"]),
    ("count_events", 24, 40, 16, 8, 0.35, 0.25, True, ["lexical", "vector", "temporal"]),
    ("comparison", 24, 48, 18, 10, 0.38, 0.20, True, ["lexical", "vector", "temporal"]),
    ("multi_hop", 28, 56, 20, 12, 0.36, 0.25, True, ["lexical", "vector", "graph"]),
    ("exploratory", 36, 72, 24, 14, 0.30, 0.30, False, ["lexical", "vector"]),
    ("temporal", 24, 48, 18, 10, 0.40, 0.20, True, ["lexical", "vector", "temporal"]),
    ("multimodal", 28, 56, 20, 10, 0.34, 0.25, False, ["lexical", "vector", "multimodal"]),
)
RELATIVE_FLOOR, MAX_CHUNKS_PER_SOURCE = 0.0, 8


def intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTENTS, "intent string, base_candidate long, base_fusion long, base_rerank long, base_context long, score_floor double, marginal_gain_floor double, structured boolean, base_stages array<string>")


def plan(requests: DataFrame, available: tuple[str, ...] = ("lexical", "vector")) -> DataFrame:
    """requests: query_id, intent, agent_id, entity_count, token_budget, chunk_tokens. An unknown intent is an error."""
    c = F.col
    rows = requests.join(F.broadcast(intents(requests.sparkSession)), "intent", "left")
    rows = rows.withColumn("base_candidate", F.coalesce("base_candidate", F.raise_error(F.concat(F.lit("unknown intent "), c("intent"))).cast("long")))
    agent = F.when(c("agent_id") == "learning-scientist", 1.2).when(c("agent_id") == "experience-engineer", 0.85).otherwise(1.0)
    m = agent * F.least(F.lit(1.5), 1 + F.greatest(F.lit(0), c("entity_count") - 1) * 0.12)
    k = lambda base, most: F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.round(c(base) * m, 9)))).cast("long")
    capacity = F.greatest(F.lit(1), F.floor(F.round(c("token_budget") * 0.7 / c("chunk_tokens"), 9)))
    stages = F.filter("base_stages", lambda s: s.isin(*available))
    return rows.select(
        "query_id",
        "intent",
        k("base_candidate", 100).alias("candidate_k"),
        k("base_fusion", 150).alias("fusion_k"),
        k("base_rerank", 50).alias("rerank_k"),
        F.least(F.lit(30), F.greatest(F.lit(1), F.least(F.ceil(F.round(c("base_context") * m, 9)), capacity))).cast("long").alias("context_k"),
        F.least(F.when(c("intent") == "count_events", 3).otherwise(2), capacity).cast("long").alias("min_context_k"),
        F.greatest(c("chunk_tokens"), F.floor(F.round(c("token_budget") * 0.7, 9))).cast("long").alias("max_context_tokens"),
        "score_floor",
        "marginal_gain_floor",
        F.when(c("structured"), 0.95).otherwise(0.8).alias("coverage_target"),
        F.array_join(F.when(F.size(stages) > 0, stages).otherwise(F.slice("base_stages", 1, 1)), ",").alias("stages"),
    )
