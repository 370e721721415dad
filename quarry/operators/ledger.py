"""Usage ledger: aggregates by agent and workload, run budgets, audit alerts and timeline, telemetry gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry import session

MICRO = 1_000_000


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and mean latency by the keys; rows without the first key do not count."""
    return (
        calls.where(F.col(keys[0]).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("status") == "failed").alias("failed_calls"),
            F.count_if(F.col("attempt") > 1).alias("retry_calls"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("cost_microusd"), F.lit(0)).alias("total_cost_microusd"),
            F.round(F.avg("latency_ms"), 4).alias("average_latency_ms"),
        )
    )


def budgets(calls: DataFrame) -> DataFrame:
    """Per run: calls, tokens, and cost in micro units, rounded as the ledger does and rounded up as the budget does."""
    return calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("model_calls"),
        F.sum("total_tokens").alias("tokens_used"),
        F.sum(F.round(F.col("cost_usd") * MICRO).cast("long")).alias("ledger_cost"),
        F.sum(F.ceil(F.col("cost_usd") * MICRO).cast("long")).alias("budget_cost"),
    )


def telemetry_gap(model_tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Tasks with model output but no recorded call."""
    return model_tasks.join(calls.select("task_id").distinct(), "task_id", "left_anti")


def alerts(calls: DataFrame, gaps: DataFrame, maximum: int) -> DataFrame:
    """run_id, code, severity, evidence (how many rows speak for it); maximum is the run budget in micro units."""
    per = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("attempt") > 1).alias("retried"), F.sum("cost_microusd").alias("cost"))
    gap = gaps.groupBy("run_id").agg(F.count(F.lit(1)).alias("missing"))
    joined = per.join(gap, "run_id", "full").na.fill(0, ["n", "failed", "retried", "cost", "missing"])
    alert = lambda cond, code, severity, n: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.alias("evidence")))
    c = F.col
    found = F.array(
        alert(c("failed") > 0, "model_failures", "warning", c("failed")),
        alert(c("retried") > 0, "model_retries", "info", c("retried")),
        alert(c("missing") > 0, "telemetry_gap", "critical", c("missing")),
        alert(c("cost") >= maximum * 0.9, "budget_critical", "critical", c("n")),
        alert((c("cost") >= maximum * 0.7) & (c("cost") < maximum * 0.9), "budget_warning", "warning", c("n")),
    )
    return joined.select("run_id", F.explode(F.filter(found, lambda a: a.isNotNull())).alias("a")).select("run_id", "a.*")


def with_missing_agents(agents: DataFrame, tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Every agent of the list, with zeros where it has no tasks or calls."""
    t = tasks.groupBy(F.col("subject").alias("agent_id")).agg(F.count(F.lit(1)).alias("task_count"))
    u = usage(calls, "agent_id").select("agent_id", F.col("calls").alias("model_calls"), "failed_calls", "total_tokens")
    return agents.join(t, "agent_id", "left").join(u, "agent_id", "left").na.fill(0, ["task_count", "model_calls", "failed_calls", "total_tokens"])


def timeline(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Activities of different kinds in one table; order by occurred_at, activity_id to read."""
    a = tasks.select("run_id", F.concat(F.lit("task."), F.col("task_id").cast("string")).alias("activity_id"), F.lit("agent_task").alias("kind"), F.col("subject").alias("agent_id"), "status", F.col("available_at").alias("occurred_at"))
    b = calls.select("run_id", F.concat(F.lit("call."), "invocation_id").alias("activity_id"), F.lit("model_invocation").alias("kind"), "agent_id", "status", F.col("started_at").alias("occurred_at"), "total_tokens")
    return a.unionByName(b, allowMissingColumns=True)


def trace(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per run with its tasks and calls as sorted lists; each table is aggregated before the join."""
    t = tasks.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("task_id").cast("string"))), ",").alias("tasks"))
    c = calls.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("invocation_id")), ",").alias("calls"))
    return t.join(c, "run_id", "left").select("run_id", "tasks", F.coalesce("calls", F.lit("")).alias("calls"))


def merged(streams: dict[str, DataFrame]) -> DataFrame:
    """Streams of different shapes as one: run_id, occurred_at, activity_id and kind (the stream's name), and what else each has as a JSON text.

    Every stream has run_id, occurred_at and activity_id; rows without a run or a time are left out of every run's trace.
    """
    common, out = ("run_id", "occurred_at", "activity_id"), None
    for kind, df in streams.items():
        rest = [c for c in df.columns if c not in common]
        details = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
        part = df.where("run_id is not null and occurred_at is not null").select("run_id", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), F.col("activity_id").cast("string").alias("activity_id"), F.lit(kind).alias("kind"), details.alias("details"))
        out = part if out is None else out.unionByName(part)
    return out


ORDER = ["run_id", "occurred_at", "activity_id", "kind"]


def paged(rows: DataFrame, size: int = 100) -> DataFrame:
    """merged() with place (from 1) and page (from 0) of each row in its run, in the order of time.

    Rows are dealt by ranges of run and time, so that a run with many is in many parts; a part's rows are numbered where they are, and start behind the
    number of the run's rows in earlier parts, of which only counts are gathered.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = session.cut(rows.repartitionByRange(parts, *ORDER).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("run_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.Window.partitionBy("run_id").orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select("run_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.Window.partitionBy("run_id", "_part").orderBy(*ORDER[1:]))
    placed = dealt.withColumn("_local", local).join(starts, ["run_id", "_part"]).withColumn("place", F.col("_start") + F.col("_local"))
    return placed.withColumn("page", F.expr(f"(place - 1) div {int(size)}")).drop("_part", "_local", "_start")


def page_after(rows: DataFrame, run_id: int, after: tuple | None = None, size: int = 100) -> DataFrame:
    """The next rows of a run behind (occurred_at, activity_id, kind), by key, so that no page reads those before it."""
    own = rows.where(F.col("run_id") == run_id)
    if after is not None:
        at = F.struct(F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]), F.lit(after[2]))
        own = own.where((F.col("occurred_at") >= F.lit(after[0]).cast("timestamp_ntz")) & (F.struct("occurred_at", "activity_id", "kind") > at))
    return own.orderBy(*ORDER).limit(size)
