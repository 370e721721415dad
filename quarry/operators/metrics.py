"""Retrieval metrics, known-item search, rank correlation, percentiles, quality probes and gates, weighted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELEVANT = 2


def ranking_scores(ranked: DataFrame, totals: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """ranked: query_id, rank (from 1), grade; totals: query_id, relevant (rows of grade 2 or more).

    The ideal list has a quarter of the relevant rows at grade 3, the others at 2, then ones up to the cutoff.
    """
    hit = F.col("grade") >= RELEVANT
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    running = ranked.where(hit).select("query_id", "rank")
    precision = running.alias("a").join(running.alias("b"), (F.col("a.query_id") == F.col("b.query_id")) & (F.col("b.rank") <= F.col("a.rank"))).groupBy("a.query_id", "a.rank").agg(F.count(F.lit(1)).alias("n"))
    ap = precision.groupBy("query_id").agg(F.sum(F.col("n") / F.col("rank")).alias("precision_sum"))
    aggs = [F.max(F.when(hit, 1.0 / F.col("rank"))).alias("rr"), F.count(F.lit(1)).alias("returned")]
    for k in cutoffs:
        inside = F.col("rank") <= k
        aggs += [F.count_if(hit & inside).alias(f"hits{k}"), F.sum(F.when(inside, gain)).alias(f"dcg{k}")]
    rows = totals.join(ranked.groupBy("query_id").agg(*aggs), "query_id", "left").join(ap, "query_id", "left")
    r = F.col("relevant")
    out = ["query_id", F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("precision_sum") / F.least(r, F.greatest("returned", F.lit(1))), F.lit(0.0)), 6).alias("ap")]
    for k in cutoffs:
        three = F.floor(r / 4 + 0.5)
        ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, i: acc + F.when(i <= three, 7.0).when(i <= r, 3.0).otherwise(1.0) / F.log2(i + 1))
        out += [F.round(F.coalesce(F.col(f"hits{k}"), F.lit(0)) / r, 6).alias(f"recall{k}"), F.round(F.coalesce(F.col(f"hits{k}"), F.lit(0)) / F.lit(k), 6).alias(f"precision{k}"), F.round(F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal, 6).alias(f"ndcg{k}")]
    return rows.select(*out)


def facet_coverage(ranked: DataFrame, facets: DataFrame, k: int) -> DataFrame:
    """Share of each query's facets (query_id, facet) that the first k ranks (query_id, rank, facet) show."""
    shown = ranked.where(F.col("rank") <= k).select("query_id", "facet").distinct().withColumn("_in", F.lit(1))
    return facets.select("query_id", "facet").distinct().join(shown, ["query_id", "facet"], "left").groupBy("query_id").agg(F.round(F.count("_in") / F.count(F.lit(1)), 6).alias("coverage"))


def known_item(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: recall at 1, 5, 10 and 20, mean reciprocal rank, median rank (nearest) of those found, and how many were not."""
    own = wanted.join(ranked, ["query_id", "chunk_id"], "left")
    rank = F.col("rank")
    recall = [F.round(F.avg(F.coalesce(rank <= k, F.lit(False)).cast("double")), 6).alias(f"recall{k}") for k in (1, 5, 10, 20)]
    return own.agg(F.count(F.lit(1)).alias("queries"), *recall, F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"), nearest_rank("rank", 0.5).cast("long").alias("median_rank"), F.count_if(rank.isNull()).alias("not_found"))


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spearman's coefficient of two rankings (query_id, chunk_id, rank) over the chunks that both have."""
    from pyspark.sql import window as W

    both = a.select("query_id", "chunk_id", F.col("rank").alias("ra")).join(b.select("query_id", "chunk_id", F.col("rank").alias("rb")), ["query_id", "chunk_id"])
    over = lambda c: F.row_number().over(W.Window.partitionBy("query_id").orderBy(c))
    rows = both.withColumn("xa", over("ra")).withColumn("xb", over("rb"))
    d = F.col("xa") - F.col("xb")
    n = F.count(F.lit(1))
    return rows.groupBy("query_id").agg(n.alias("shared"), F.round(F.when(n > 1, 1 - 6 * F.sum(d * d) / (n * (n * n - 1))).otherwise(F.lit(None)), 6).alias("spearman"))


def index_fidelity(found: DataFrame, exact: DataFrame, vectors: int, k: int = 10) -> DataFrame:
    """Per query: overlap with the exact top-k, recall, whether the first agrees, whether it was found at all, Spearman's coefficient over what both have, and
    the share of the `vectors` that the query was compared with. found: query_id, chunk_id, rank, compared."""
    one = exact.select("query_id", "chunk_id", F.col("rank").alias("_exact"))
    both = one.join(found.select("query_id", "chunk_id", F.col("rank").alias("_found")), ["query_id", "chunk_id"], "left")
    each = both.groupBy("query_id").agg(
        F.count("_found").alias("overlap"), F.round(F.count("_found") / F.count(F.lit(1)), 6).alias("recall"), F.max((F.col("_exact") == 1) & (F.coalesce("_found", F.lit(0)) == 1)).alias("top1_agrees"), F.max((F.col("_exact") == 1) & F.col("_found").isNotNull()).alias("top1_found")
    )
    share = found.groupBy("query_id").agg(F.round(F.max("compared") / vectors, 6).alias("compared_share"))
    return each.join(rank_correlation(exact, found).select("query_id", "spearman"), "query_id", "left").join(share, "query_id", "left")


def nearest_rank(values: str, p: float) -> Column:
    """The value at place ceil(p n) of the sorted values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {values})")


def floor_rank(rows: DataFrame, key: str, values: str, shares: tuple[float, ...]) -> DataFrame:
    """The value at place floor(n q) from 0 of the sorted values, for each key; ranks come from a window, not from a list per key."""
    from pyspark.sql import window as W

    n = F.count(F.lit(1)).over(W.Window.partitionBy(key))
    ranked = rows.select(key, values, F.row_number().over(W.Window.partitionBy(key).orderBy(values)).alias("_r"), n.alias("_n"))
    pick = [F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)) + 1, F.col(values))).alias(f"p{round(q * 100)}") for q in shares]
    return ranked.groupBy(key).agg(*pick)


def summary(rows: DataFrame, key: str, values: str) -> DataFrame:
    n = F.count(F.lit(1))
    at = lambda p: nearest_rank(values, p).cast(rows.schema[values].dataType).alias(f"p{round(100 * p)}")
    return rows.groupBy(key).agg(n.alias("n"), F.round(F.avg(values), 4).alias("mean"), at(0.5), at(0.95), at(0.99), (n >= 100).alias("p99_reliable"), F.max(values).alias("max"))


def probe_scores(expected: DataFrame, hits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """expected: case_id, kind (recall or acl), memory_id; hits: case_id, memory_id. Recall counts hits, acl counts leaks."""
    met = expected.join(hits.select("case_id", "memory_id").distinct().withColumn("_in", F.lit(1)), ["case_id", "memory_id"], "left")
    share = F.count("_in") / F.count(F.lit(1))
    score = F.round(F.when(F.col("kind") == "acl", 1 - share).otherwise(share), 6)
    return met.groupBy("kind").agg(score.alias("score"), F.count(F.lit(1)).alias("expectations")).withColumn("passed", F.col("score") >= threshold)


#: Dimension, metric, baseline, weight, direction.
QUALITY = (
    ("availability", "interface_success_rate", 0.999, 0.30, "ge"),
    ("seckill_p99", "seckill_p99_ms", 200.0, 0.20, "le"),
    ("order_p99", "order_p99_ms", 500.0, 0.10, "le"),
    ("oversell_rate", "oversell_rate", 0.0, 0.20, "le"),
    ("payment_idempotent", "payment_idempotent_rate", 1.0, 0.10, "ge"),
    ("test_coverage", "test_coverage", 0.80, 0.05, "ge"),
    ("test_pass_rate", "test_pass_rate", 1.0, 0.05, "ge"),
)


def quality_scores(metrics: DataFrame) -> DataFrame:
    """metrics: subject_id, metric, actual. Weighted score, trend and priority; a metric that is missing counts as at its baseline."""
    spark = metrics.sparkSession
    dims = F.broadcast(spark.createDataFrame(QUALITY, "dimension string, metric string, baseline double, weight double, direction string"))
    subjects = metrics.select("subject_id").distinct().withColumn("dimension", F.explode(F.array(*(F.lit(d[0]) for d in QUALITY))))
    rows = subjects.join(dims, "dimension").join(metrics, ["subject_id", "metric"], "left").withColumn("actual", F.coalesce("actual", "baseline"))
    a, b = F.col("actual"), F.col("baseline")
    score = F.when(F.col("direction") == "ge", F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(1.0)).otherwise(F.when(a > 0, F.least(b / a, F.lit(1.0))).otherwise(1.0))
    out = rows.groupBy("subject_id").agg(F.round(F.sum(score * F.col("weight")), 4).alias("overall"))
    drop = F.round(0.95 - F.col("overall"), 6)
    return out.select("subject_id", "overall", F.when(F.col("overall") >= 0.95, "up").when(F.col("overall") < 0.85, "down").otherwise("flat").alias("trend"), F.when(drop >= 0.10, "P0").when(drop >= 0.05, "P1").otherwise("P2").alias("priority"))


def weighted_total(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """scores: subject_id, tier, score (may be null); weights: tier, weight. Weights of tiers without a score are left out of the sum."""
    rows = scores.join(F.broadcast(weights), "tier").where("score is not null")
    return rows.groupBy("subject_id").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("total"), F.count(F.lit(1)).alias("tiers"))


def citation_match_rate(expected: DataFrame, hits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """case_id, score, passed: the share of expected citations (case_id, artifact_id, digest) that some hit of the case carries."""
    of = ["case_id", "artifact_id", "digest"]
    met = expected.select(*of).distinct().join(hits.select(*of).distinct().withColumn("_in", F.lit(1)), of, "left")
    score = F.round(F.count("_in") / F.count(F.lit(1)), 6)
    return met.groupBy("case_id").agg(score.alias("score")).withColumn("passed", F.col("score") >= threshold)


def sample_rows(rows: DataFrame, key: str, every: int) -> DataFrame:
    """Every n-th row in the order of the key, whatever the keys are; sampling is the feature.

    Sorted rows are numbered inside their partitions, and each partition's rows before it are added (a row for each partition).
    """
    from pyspark.sql import window as W

    from quarry.session import cut

    done = cut(rows.orderBy(key).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    sizes = done.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    placed = done.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1))
    return placed.where(F.col("_at") % every == 0).drop("_m", "_part", "_before", "_at")


def sample_every(rows: DataFrame, key: str, every: int) -> DataFrame:
    """Every n-th row by the order of a dense integer key; sampling is the feature."""
    return rows.where(F.col(key) % every == 0)
