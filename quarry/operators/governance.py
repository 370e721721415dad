"""Governance over task and event tables: claims, reaping, storms, incidents, rule violations, stock, timeouts, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def claimable(tasks: DataFrame, now: str) -> DataFrame:
    """Due, before the deadline, not cancelled, attempts left, and pending or with an expired lease; in claim order."""
    free = (F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("lease_expires_at") <= _at(now)))
    return tasks.where((F.col("available_at") <= _at(now)) & (F.col("deadline") > _at(now)) & ~F.col("cancellation_requested") & (F.col("attempt") < F.col("max_attempts")) & free)


def claim_order(tasks: DataFrame, now: str, limit: int) -> DataFrame:
    """The first `limit` claimable tasks, oldest first (the limit is the feature), with their place."""
    rows = claimable(tasks, now).orderBy("available_at", "task_id").limit(limit)
    return rows.select("task_id", F.row_number().over(W.Window.orderBy("available_at", "task_id")).cast("long").alias("place"))


def reapable(tasks: DataFrame, now: str) -> DataFrame:
    """Leases that ran out with no attempts left, and deadlines that passed, each with what becomes of it."""
    open_ = F.col("status").isin("pending", "leased")
    late = F.col("deadline") <= _at(now)
    lapsed = (F.col("status") == "leased") & (F.col("lease_expires_at") <= _at(now)) & (F.col("attempt") >= F.col("max_attempts"))
    return tasks.where(open_ & (late | lapsed)).withColumn("outcome", F.when(late, "deadline_exceeded").otherwise("attempts_exhausted"))


def storms(events: DataFrame, keys: list[str], window_seconds: int, most: int) -> DataFrame:
    """Each observation with the count of its key in the trailing window, both ends included, where the count exceeds `most`.

    Seconds since the epoch, in micro units, order the window, so a key's rows are sorted once. A hot key is split by blocks of the
    window's length: each row is counted in its own block and replicated into the next, so no task holds all rows of a key.
    """
    micros = F.unix_micros(F.col("occurred_from").cast("timestamp"))
    span = window_seconds * 1_000_000
    rows = events.withColumn("_t", micros).withColumn("_own", F.floor(micros / span))
    both = rows.withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = W.Window.partitionBy(*keys, "_block").orderBy("_t").rangeBetween(-span, 0)
    counted = both.withColumn("observations", F.count(F.lit(1)).over(w)).where("_block = _own")
    return counted.where(F.col("observations") > most).drop("_t", "_own", "_block")


def incidents(found: DataFrame, keys: list[str]) -> DataFrame:
    """One incident per key: first and last seen, occurrences, and a stable id."""
    text = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    return found.groupBy(*keys).agg(F.min("occurred_from").alias("first_seen"), F.max("occurred_from").alias("last_seen"), F.count(F.lit(1)).alias("occurrences")).withColumn("incident_id", F.concat(F.lit("incident."), F.substring(F.sha2(text, 256), 1, 24)))


def merge_incidents(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Incidents after new observations: last_seen and occurrences go on, and a resolved one that is seen again is open again.

    stored: incident_id, status (open, resolved), last_seen, occurrences; found: the same without status, as incidents() gives it.
    """
    new = found.select("incident_id", F.col("last_seen").alias("_seen"), F.col("occurrences").alias("_n"))
    rows = stored.join(new, "incident_id", "full")
    status = F.when(F.col("_n").isNotNull(), "open").otherwise(F.col("status"))
    return rows.select(
        "incident_id", status.alias("status"), F.greatest("last_seen", "_seen").alias("last_seen"), (F.coalesce("occurrences", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("occurrences"),
        F.coalesce((F.col("status") == "resolved") & F.col("_n").isNotNull(), F.lit(False)).alias("reopened"),
    )


#: What follows from each violation.
VIOLATIONS = {"hop_limit": ("high", "needs_human", "run"), "budget_exhausted": ("high", "needs_human", "run"), "task_repetition": ("medium", "reject", None)}
MAX_HOPS, MAX_TASKS = 8, 32


def violations(tasks: DataFrame, max_hops: int = MAX_HOPS, max_tasks: int = MAX_TASKS) -> DataFrame:
    """The first rule that each task breaks: hops, tasks of its run so far, or the same fingerprint earlier in the run."""
    run = W.Window.partitionBy("run_id").orderBy("available_at", "task_id")
    same = W.Window.partitionBy("run_id", "task_fingerprint").orderBy("available_at", "task_id")
    rule = F.when(F.col("hop_count") > max_hops, "hop_limit").when(F.row_number().over(run) > max_tasks, "budget_exhausted").when(F.row_number().over(same) > 1, "task_repetition")
    found = tasks.select("task_id", "run_id", rule.alias("violation")).where("violation is not null")
    of = F.create_map(*(F.lit(x) for k, (severity, action, who) in VIOLATIONS.items() for x in (k, f"{severity}|{action}|{who or ''}")))
    parts = F.split(of[F.col("violation")], "[|]")
    return found.select("task_id", "violation", parts[0].alias("severity"), parts[1].alias("action"), parts[2].alias("quarantine"))


def quarantined(tasks: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Tasks whose run, or whose agent (subject) in that run, is in an active quarantine: run_id, subject_type, subject_id, active."""
    live = quarantine.where("active")
    runs = live.where((F.col("subject_type") == "run") & (F.col("subject_id") == F.col("run_id").cast("string"))).select("run_id").distinct()
    agents = live.where("subject_type = 'agent'").select("run_id", F.col("subject_id").alias("subject")).distinct()
    return tasks.join(runs, "run_id", "left_semi").unionByName(tasks.join(agents, ["run_id", "subject"], "left_semi")).distinct()


def enqueue(stored: DataFrame, incoming: DataFrame, quarantine: DataFrame, max_hops: int = MAX_HOPS, max_tasks: int = MAX_TASKS) -> DataFrame:
    """task_id, run_id, parent_task_id, violation (null: the task is accepted) of a batch of tasks, as if they came one by one in the order of task_id.

    The first rule that is broken counts: hops beyond the limit; a run that has its tasks already; quarantine; a fingerprint that the run has in the same epoch; and of
    delegation, that a parent is stored, of the same run and root run, one hop above and of another agent, or that a task without parent has hop 0. What is refused
    uses up nothing. Both frames: task_id, run_id, root_run_id, parent_task_id, subject, hop_count, task_fingerprint, epoch.
    """
    names = ["task_id", "run_id", "root_run_id", "parent_task_id", "subject", "hop_count", "task_fingerprint", "epoch"]
    above = stored.select(*(F.col(c).alias(f"p_{c}") for c in ("task_id", "run_id", "root_run_id", "subject", "hop_count")), F.lit(True).alias("p_here"))
    rows = incoming.select(*names).join(above, F.col("parent_task_id") == F.col("p_task_id"), "left")
    held = quarantined(incoming.select("task_id", "run_id", "subject"), quarantine).select("task_id", F.lit(True).alias("_held"))
    known = stored.select("run_id", "epoch", "task_fingerprint").distinct().withColumn("_known", F.lit(True))
    used = stored.groupBy("run_id").agg(F.count(F.lit(1)).alias("_stored"))
    rows = rows.join(held, "task_id", "left").join(known, ["run_id", "epoch", "task_fingerprint"], "left").join(used, "run_id", "left")
    c, no = F.col, F.lit(False)
    child = F.coalesce(c("p_here") & (c("p_run_id") == c("run_id")) & (c("p_root_run_id") == c("root_run_id")) & (c("hop_count") == c("p_hop_count") + 1) & (c("p_subject") != c("subject")), no)
    delegated = F.when(c("parent_task_id").isNull(), c("hop_count") == 0).otherwise(child)
    fine = (c("hop_count") <= max_hops) & c("_held").isNull() & c("_known").isNull() & delegated
    first = F.row_number().over(W.Window.partitionBy("run_id", "epoch", "task_fingerprint", "_fine").orderBy("task_id")) == 1
    rows = rows.withColumn("_fine", fine).withColumn("_ok", c("_fine") & first)
    before = F.coalesce(F.sum(c("_ok").cast("int")).over(W.Window.partitionBy("run_id").orderBy("task_id").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    full = F.coalesce("_stored", F.lit(0)) + before >= max_tasks
    repeated = c("_known").isNotNull() | (c("_fine") & ~c("_ok"))
    rule = (
        F.when(c("hop_count") > max_hops, "hop_limit").when(full, "budget_exhausted").when(c("_held").isNotNull(), "delegation_violation").when(repeated, "task_repetition")
        .when(~delegated, "delegation_violation")
    )
    return rows.select("task_id", "run_id", "parent_task_id", rule.alias("violation"))


def backoff_ms(attempt: Column, first: int = 1_000, most: int = 60_000) -> Column:
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def admitted(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """Requests (item, request_id, quantity) accepted in order while the running total fits the item's stock."""
    w = W.Window.partitionBy("item").orderBy("request_id").rowsBetween(W.Window.unboundedPreceding, 0)
    return requests.withColumn("taken", F.sum("quantity").over(w)).join(stock, "item").withColumn("accepted", F.col("taken") <= F.col("stock"))


def stock_tiers(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """Requests for one piece each (item, request_id), accepted in order while there is stock, and what each tier has to touch for it.

    All tiers accept the same requests. The first asks the database about each; the second a counter; the third remembers once an item
    is sold out, and then refuses without asking (`counter_asked` is false).
    """
    w = W.Window.partitionBy("item").orderBy("request_id")
    place = F.row_number().over(w)
    return requests.join(stock, "item").withColumn("_n", place).select("item", "request_id", (F.col("_n") <= F.col("stock")).alias("accepted"), (F.col("_n") <= F.greatest("stock", F.lit(0)) + 1).alias("counter_asked"))


def pay_callbacks(orders: DataFrame, callbacks: DataFrame) -> DataFrame:
    """callback_id, outcome. The first callback of a pending order pays it; more of them, or of a paid or done order, change nothing.

    orders: out_trade_no, status; callbacks: callback_id, out_trade_no. A callback without an order is invalid; other states are illegal.
    """
    first = F.row_number().over(W.Window.partitionBy("out_trade_no").orderBy("callback_id")) == 1
    rows = callbacks.withColumn("_first", first).join(orders.select("out_trade_no", "status"), "out_trade_no", "left")
    outcome = F.when(F.col("status").isNull(), "invalid").when(F.col("status").isin("paid", "done"), "already_paid").when(F.col("status") == "pending", F.when(F.col("_first"), "paid").otherwise("already_paid")).otherwise("illegal")
    return rows.select("callback_id", outcome.alias("outcome"))


def refunds(orders: DataFrame) -> DataFrame:
    """order_id, allowed, status after a request for a refund: only paid and done orders can be refunded."""
    allowed = F.col("status").isin("paid", "done")
    return orders.select("order_id", allowed.alias("allowed"), F.when(allowed, "refunding").otherwise(F.col("status")).alias("status"))


def timed_out(orders: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Unpaid orders older than the limit."""
    return orders.where((F.col("state") == "created") & (F.timestamp_add("MINUTE", F.lit(minutes), F.col("created_at")) <= _at(now)))


def first_receipts(deliveries: DataFrame) -> DataFrame:
    """Exactly-once receipts: the first delivery of each (consumer, event_id), and how many were dropped."""
    return deliveries.groupBy("consumer", "event_id").agg(F.min("received_at").alias("received_at"), (F.count(F.lit(1)) - 1).alias("duplicates"))
