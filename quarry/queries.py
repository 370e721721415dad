"""Registered queries of the engine, each over its whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry import session
from quarry.functions import text as T
from quarry.operators import chunking, evidence, governance, graph, ledger, lifecycle, metrics, postings, retrieval
from quarry.operators import events as ev
from quarry.operators import visibility as vis
from quarry.oracle import sql
from quarry.plans import planner
from quarry.sources import logical as L
from quarry.sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ME = vis.Principal("t1", user_id="u1", agent_id="a1", role_ids=("r1",))
NOW = "1998-01-01"


def query(tables: str = "", body: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body:
            ORACLE_SQL[f.__name__] = sql(tables, body)
        return f

    return add


def _visible(spark: SparkSession, sf: str) -> DataFrame:
    return vis.readable_facts(L.structured_event(spark, sf), ME)


# --- structured answers ---

_REP = "r AS (SELECT * FROM vis {} QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY occurred_from, event_id) = 1)"
_COUNT = """WITH {rep}, c AS (SELECT subject_id, event_type, count(*) FILTER (conflict_status <> 'none') AS excluded_conflict_count FROM vis GROUP BY ALL),
    v AS (SELECT subject_id, event_type, count(*) AS value FROM r GROUP BY ALL)
    SELECT subject_id, event_type, coalesce(value, 0) AS value, excluded_conflict_count FROM c LEFT JOIN v USING (subject_id, event_type)"""
_CLEAN = _REP.format("WHERE conflict_status = 'none'")


@query("vis", _COUNT.format(rep=_CLEAN))
def structured_count(spark, sf):
    return ev.distinct_counts(_visible(spark, sf))


@query("vis", _COUNT.format(rep=_REP.format("")))
def structured_count_with_conflicts(spark, sf):
    return ev.distinct_counts(_visible(spark, sf), include_conflicts=True)


@query("vis", f"WITH w AS (SELECT * FROM vis WHERE occurred_from >= TIMESTAMP '2024-01-05' AND occurred_from < TIMESTAMP '2024-01-12'), {_CLEAN.replace('FROM vis', 'FROM w')} SELECT event_type, count(*) AS value FROM r GROUP BY event_type")
def structured_count_range(spark, sf):
    rows = ev.representatives(ev.in_range(_visible(spark, sf), "2024-01-05", "2024-01-12"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))


@query("vis", f"WITH {_CLEAN} SELECT event_type, count(*) FILTER (subject_id = '4') AS left_count, count(*) FILTER (subject_id = '8') AS right_count, count(*) FILTER (subject_id = '4') - count(*) FILTER (subject_id = '8') AS difference FROM r WHERE subject_id IN ('4', '8') GROUP BY event_type")
def structured_compare_counts(spark, sf):
    return ev.compare(_visible(spark, sf), "4", "8")


@query("vis", f"WITH {_CLEAN} SELECT subject_id, event_type, min(occurred_from) AS first_at, arg_min(event_id, (occurred_from, event_id)) AS first_event_id, max(occurred_from) AS last_at, arg_max(event_id, (occurred_from, event_id)) AS last_event_id FROM r GROUP BY ALL")
def structured_first_last_event(spark, sf):
    return ev.first_and_last(_visible(spark, sf))


@query("vis", "WITH p(subject_id, event_type) AS (VALUES ('4', 'view'), ('4', 'absent'), ('nobody', 'view'), ('nobody', 'absent')) SELECT subject_id, event_type, subject_id IN (SELECT subject_id FROM vis) AS subject_exists, event_type IN (SELECT event_type FROM vis) AS type_exists FROM p")
def structured_vocabulary_probe(spark, sf):
    probes = spark.createDataFrame([("4", "view"), ("4", "absent"), ("nobody", "view"), ("nobody", "absent")], "subject_id string, event_type string")
    return ev.explain_empty(_visible(spark, sf), probes)


@query("vis", "SELECT DISTINCT event_type FROM vis")
def distinct_event_types(spark, sf):
    return _visible(spark, sf).select("event_type").distinct()


@query("vis", "SELECT subject_id, CAST(least(count(*), 50) AS BIGINT) AS returned, count(*) > 50 AS truncated FROM vis GROUP BY subject_id")
def event_truncation_flag(spark, sf):
    return ev.bounded(_visible(spark, sf), 50).withColumn("returned", F.col("returned").cast("long"))


@query("se", "SELECT conflict_status, event_type, count(*) AS n, count(DISTINCT dedupe_key) AS keys FROM se GROUP BY ALL")
def event_conflict_report(spark, sf):
    return L.structured_event(spark, sf).groupBy("conflict_status", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dedupe_key").alias("keys"))


_STORM = """s AS (SELECT event_id, subject_id, event_type, occurred_from, count(*) OVER (PARTITION BY subject_id, event_type ORDER BY occurred_from RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS observations FROM se),
    f AS (SELECT * FROM s WHERE observations > 1)"""


@query("se", f"WITH {_STORM} SELECT event_id, subject_id, event_type, observations FROM f")
def event_storm_sliding_count(spark, sf):
    return governance.storms(L.structured_event(spark, sf), ["subject_id", "event_type"], 6 * 3600, 1).select("event_id", "subject_id", "event_type", "observations")


@query("se", f"WITH {_STORM} SELECT subject_id, event_type, min(occurred_from) AS first_seen, max(occurred_from) AS last_seen, count(*) AS occurrences, 'incident.' || substr(sha256(subject_id || ':' || event_type), 1, 24) AS incident_id FROM f GROUP BY subject_id, event_type")
def incident_rollup(spark, sf):
    keys = ["subject_id", "event_type"]
    return governance.incidents(governance.storms(L.structured_event(spark, sf), keys, 6 * 3600, 1), keys)


# --- visibility and lifecycle ---


@query("readable", "SELECT memory_id, scope, owner_id FROM readable")
def readable_memories(spark, sf):
    return vis.readable_memories(L.memory_record(spark, sf), L.memory_acl(spark, sf), ME).select("memory_id", "scope", "owner_id")


@query("mem acl", "SELECT memory_id, scope FROM mem WHERE status = 'active' AND tenant_id = 't1' AND ((scope = 'tenant' AND owner_id = 't1') OR (scope = 'user_private' AND owner_id = 'u1') OR (scope = 'agent_private' AND owner_id = 'a1') OR memory_id IN (SELECT memory_id FROM acl WHERE permission = 'delete' AND principal_type = 'user' AND principal_id = 'u1'))")
def deletable_memories(spark, sf):
    return vis.deletable_memories(L.memory_record(spark, sf), L.memory_acl(spark, sf), ME).select("memory_id", "scope")


_EDGES = "SELECT * FROM edge WHERE (scope = 'public' OR (tenant_id = 't1' AND scope = 'user_private' AND owner_id = 'u1')) AND valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01')"


@query("edge", f"SELECT source_node_id, predicate, target_node_id, edge_id FROM ({_EDGES})")
def readable_edges_asof(spark, sf):
    return graph.valid_at(vis.readable_facts(L.structured_edge(spark, sf), ME), "1997-06-01").select("source_node_id", "predicate", "target_node_id", "edge_id")


@query("mem", "SELECT tenant_id, count(*) AS documents, min(memory_id) AS first_id, max(memory_id) AS last_id FROM mem WHERE status = 'active' AND scope IN ('public', 'tenant') GROUP BY tenant_id")
def active_memory_scan(spark, sf):
    rows = L.memory_record(spark, sf).where((F.col("status") == "active") & F.col("scope").isin("public", "tenant"))
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("documents"), F.min("memory_id").alias("first_id"), F.max("memory_id").alias("last_id"))


@query("mem", """WITH r AS (SELECT tenant_id, memory_id, sha256('{"updated_at":' || epoch_us(updated_at) || ',"memory_id":' || memory_id || ',"version":' || version || ',"digest":"sha256:' || sha256(text) || '"}') AS h FROM mem WHERE status = 'active'),
    b AS (SELECT tenant_id, memory_id // 4096 AS b, sha256(string_agg(h, '' ORDER BY memory_id)) AS h, count(*) AS n FROM r GROUP BY ALL) SELECT tenant_id, sha256(string_agg(h, '' ORDER BY b)) AS watermark, CAST(sum(n) AS BIGINT) AS documents FROM b GROUP BY tenant_id""")
def source_watermark(spark, sf):
    rows = L.memory_record(spark, sf).where("status = 'active'").select("tenant_id", "updated_at", "memory_id", "version", T.digest(F.col("text")).alias("digest"))
    return parsers.watermark(rows)


_FACT = "fact AS (SELECT event_id AS fact_id, scope, event_id % 900 AS a, event_id % 701 AS b FROM se)"


@query("se mem", f"WITH {_FACT}, e AS (SELECT fact_id, scope, a AS memory_id FROM fact UNION ALL SELECT fact_id, scope, b FROM fact), r AS (SELECT * FROM (VALUES ('session', 0), ('agent_private', 1), ('user_private', 1), ('tenant', 2), ('public', 3)) t(scope, n)) SELECT fact_id, count(*) AS violations FROM e LEFT JOIN (SELECT memory_id, n FROM mem JOIN r USING (scope) WHERE status = 'active') m USING (memory_id) JOIN r ON r.scope = e.scope WHERE m.n IS NULL OR m.n < r.n GROUP BY fact_id")
def source_visibility(spark, sf):
    facts = L.structured_event(spark, sf).select(F.col("event_id").alias("fact_id"), "scope", F.array(F.col("event_id") % 900, F.col("event_id") % 701).alias("source_memory_ids"))
    return vis.broader_than_source(facts, L.memory_record(spark, sf))


@query("mem", "WITH c AS (SELECT memory_id FROM mem WHERE status = 'deleted'), f AS (SELECT event_id % 900 AS memory_id FROM events) SELECT memory_id, CAST((SELECT count(*) FROM range(0, 3) WHERE memory_id % 2 = 0) AS BIGINT) AS chunks, (SELECT count(*) FROM f WHERE f.memory_id = c.memory_id) AS facts FROM c")
def deletion_cascade_counts(spark, sf):
    memories = L.memory_record(spark, sf)
    chunks = memories.where("memory_id % 2 = 0").select("memory_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ordinal"))
    facts = L.structured_event(spark, sf).select(F.array(F.col("event_id") % 900).alias("source_memory_ids"))
    return lifecycle.cascade_counts(memories.where("status = 'deleted'"), chunks, facts)


_ACK = "ack AS (SELECT l_orderkey AS deletion_id, 'target' || (l_partkey % 3) AS target, CASE l_linenumber % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CAST(l_linenumber AS BIGINT) AS attempt, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3, l_linenumber ORDER BY l_extendedprice, l_partkey) = 1)"
_FOLD = f"{_ACK}, d AS (SELECT *, min(CASE WHEN status = 'completed' THEN attempt END) OVER (PARTITION BY deletion_id, target) AS done FROM ack), fold AS (SELECT deletion_id, target, arg_max(status, attempt) AS status, max(attempt) AS attempt FROM d WHERE done IS NULL OR attempt <= done GROUP BY deletion_id, target)"


def _acks(spark, sf):
    li = L.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    rows = li.select(F.col("l_orderkey").alias("deletion_id"), F.concat(F.lit("target"), L.s(F.col("l_partkey") % 3)).alias("target"), F.when(F.col("l_linenumber") % 3 == 0, "completed").when(F.col("l_linenumber") % 3 == 1, "failed").otherwise("pending").alias("status"), F.col("l_linenumber").cast("long").alias("attempt"))
    return rows.distinct()


@query("", f"WITH {_FOLD} SELECT deletion_id, target, status, attempt FROM fold")
def deletion_acknowledgements(spark, sf):
    return lifecycle.fold_acknowledgements(_acks(spark, sf))


@query("", f"WITH {_FOLD} SELECT deletion_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'completed' END AS status, count(*) AS targets FROM fold GROUP BY deletion_id")
def deletion_status_rollup(spark, sf):
    return lifecycle.deletion_status(lifecycle.fold_acknowledgements(_acks(spark, sf)))


def _activations(spark, sf):
    return L.read(spark, sf, "orders").select(F.concat(F.lit("t"), L.s(F.col("o_custkey") % 2)).alias("tenant_id"), F.concat(F.lit("index"), L.s(F.col("o_custkey") % 50)).alias("logical_name"), F.col("o_orderkey").alias("index_version_id"), F.col("o_orderdate").alias("activated_at"))


@query("", "SELECT 't' || (o_custkey % 2) AS tenant_id, 'index' || (o_custkey % 50) AS logical_name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS index_version_id FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY ALL")
def index_active_asof(spark, sf):
    return lifecycle.active_as_of(_activations(spark, sf), NOW)


@query("", "SELECT o_orderkey AS index_version_id, o_orderdate AS retired_at FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '1997-12-25' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey AND c_custkey % 2 = 0) ORDER BY retired_at, index_version_id LIMIT 100")
def index_gc_candidates(spark, sf):
    versions = L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("index_version_id"), F.when(F.col("o_orderkey") % 3 == 0, "retired").otherwise("active").alias("status"), F.col("o_orderdate").alias("retired_at"))
    holds = L.read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("index_version_id"), F.lit(None).cast("timestamp_ntz").alias("released_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    return lifecycle.collectable(versions, holds, NOW).select("index_version_id", "retired_at")


@query("", "WITH h AS (SELECT c_custkey AS index_version_id FROM customer WHERE c_custkey % 2 = 0) SELECT o_orderkey AS index_version_id FROM orders WHERE o_orderkey NOT IN (SELECT index_version_id FROM h)")
def retention_hold_anti_join(spark, sf):
    holds = L.read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("index_version_id"))
    return L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("index_version_id")).join(holds, "index_version_id", "left_anti")


def _orders_machine(spark, sf):
    names = F.array(*map(F.lit, ("pay", "ship", "refund", "refunded", "receive", "cancel")))
    li = L.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return li.select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").cast("long").alias("event_id"), F.element_at(names, ((F.col("l_linenumber") + F.col("l_orderkey")) % 6 + 1).cast("int")).alias("event"), F.lit(None).cast("long").alias("expected_version"), F.col("l_linenumber").cast("long").alias("seq"))


_MACHINE = "('created|pay', 'paid'), ('created|cancel', 'closed'), ('paid|ship', 'shipped'), ('paid|refund', 'refunding'), ('shipped|receive', 'done'), ('shipped|refund', 'refunding'), ('refunding|refunded', 'closed')"


@query("", f"""WITH RECURSIVE m(k, nxt) AS (VALUES {_MACHINE}), e AS (SELECT l_orderkey AS entity_id, l_linenumber AS seq, ['pay', 'ship', 'refund', 'refunded', 'receive', 'cancel'][CAST((l_linenumber + l_orderkey) % 6 + 1 AS BIGINT)] AS event,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
    w AS (SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS n, 'created' AS state, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS illegal FROM e
    UNION ALL SELECT w.entity_id, e.n, coalesce(m.nxt, w.state), w.version + CASE WHEN m.nxt IS NULL THEN 0 ELSE 1 END, w.illegal + CASE WHEN m.nxt IS NULL THEN 1 ELSE 0 END FROM w JOIN e ON e.entity_id = w.entity_id AND e.n = w.n + 1 LEFT JOIN m ON m.k = w.state || '|' || e.event)
    SELECT entity_id, state, version, illegal FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) = 1""")
def state_replay(spark, sf):
    return lifecycle.replay(_orders_machine(spark, sf), lifecycle.ORDER, "created").select("entity_id", "state", "version", "illegal")


@query("", "WITH t AS (SELECT l_orderkey AS entity_id, l_linenumber AS seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), v AS (SELECT entity_id, seq, r - 1 AS a, CASE WHEN seq % 5 = 0 THEN r + 1 ELSE r END AS b FROM t), g AS (SELECT *, lag(b) OVER (PARTITION BY entity_id ORDER BY seq) AS p FROM v) SELECT entity_id, CAST(seq AS BIGINT) AS seq FROM g WHERE b <> a + 1 OR (p IS NOT NULL AND p <> a)")
def transition_chain_breaks(spark, sf):
    li = L.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").cast("long").alias("seq")).distinct()
    r = F.row_number().over(W.Window.partitionBy("entity_id").orderBy("seq")).cast("long")
    rows = li.withColumn("r", r).select("entity_id", "seq", (F.col("r") - 1).alias("from_version"), F.when(F.col("seq") % 5 == 0, F.col("r") + 1).otherwise(F.col("r")).alias("to_version"))
    return lifecycle.chain_breaks(rows).select("entity_id", "seq")


@query("", "SELECT o_orderkey AS order_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 MINUTES <= TIMESTAMP '1998-01-01'")
def order_timeout_sweep(spark, sf):
    rows = L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "O", "created").otherwise("paid").alias("state"), F.col("o_orderdate").alias("created_at"))
    return governance.timed_out(rows, NOW).select("order_id")


# --- governance ---

_CLAIM = "available_at <= TIMESTAMP '1998-01-01' AND deadline > TIMESTAMP '1998-01-01' AND NOT cancellation_requested AND attempt < max_attempts AND (status = 'pending' OR (status = 'leased' AND lease_expires_at <= TIMESTAMP '1998-01-01'))"


@query("task", f"SELECT task_id, status FROM task WHERE {_CLAIM}")
def task_claimable(spark, sf):
    return governance.claimable(L.workflow_task(spark, sf), NOW).select("task_id", "status")


@query("task", f"SELECT task_id, row_number() OVER (ORDER BY available_at, task_id) AS place FROM task WHERE {_CLAIM} QUALIFY place <= 64")
def outbox_claim_order(spark, sf):
    return governance.claim_order(L.workflow_task(spark, sf), NOW, 64)


@query("task", "SELECT task_id, CASE WHEN deadline <= TIMESTAMP '1998-01-01' THEN 'deadline_exceeded' ELSE 'attempts_exhausted' END AS outcome FROM task WHERE status IN ('pending', 'leased') AND (deadline <= TIMESTAMP '1998-01-01' OR (status = 'leased' AND lease_expires_at <= TIMESTAMP '1998-01-01' AND attempt >= max_attempts))")
def task_reapable(spark, sf):
    return governance.reapable(L.workflow_task(spark, sf), NOW).select("task_id", "outcome")


@query("task", "WITH v AS (SELECT task_id, CASE WHEN hop_count > 8 THEN 'hop_limit' WHEN row_number() OVER (PARTITION BY run_id ORDER BY available_at, task_id) > 32 THEN 'budget_exhausted' WHEN row_number() OVER (PARTITION BY run_id, task_fingerprint ORDER BY available_at, task_id) > 1 THEN 'task_repetition' END AS violation FROM task) SELECT task_id, violation, CASE violation WHEN 'task_repetition' THEN 'medium' ELSE 'high' END AS severity, CASE violation WHEN 'task_repetition' THEN 'reject' ELSE 'needs_human' END AS action, CASE violation WHEN 'task_repetition' THEN '' ELSE 'run' END AS quarantine FROM v WHERE violation IS NOT NULL")
def governance_violations(spark, sf):
    return governance.violations(L.workflow_task(spark, sf))


@query("task", "SELECT task_id, CAST(least(60000, 1000 * pow(2, attempt)) AS BIGINT) AS delay_ms FROM task")
def retry_backoff(spark, sf):
    return L.workflow_task(spark, sf).select("task_id", governance.backoff_ms(F.col("attempt") + 1).alias("delay_ms"))


@query("", "WITH r AS (SELECT l_partkey AS item, l_orderkey * 10 + l_linenumber AS request_id, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(quantity) OVER (PARTITION BY item ORDER BY request_id) AS taken FROM r) SELECT item, count(*) FILTER (taken <= p_size * 10) AS accepted, count(*) AS requests FROM t JOIN part ON item = p_partkey GROUP BY item")
def stock_admission(spark, sf):
    li = L.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    requests = li.groupBy(F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    stock = L.read(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") * 10).alias("stock"))
    return governance.admitted(requests, stock).groupBy("item").agg(F.count_if("accepted").alias("accepted"), F.count(F.lit(1)).alias("requests"))


@query("", "SELECT 'consumer' || (user_id % 3) AS consumer, event_type || '.' || (event_id % 2000) AS event_id, min(ts) AS received_at, count(*) - 1 AS duplicates FROM events GROUP BY ALL")
def inbox_dedupe(spark, sf):
    rows = L.read(spark, sf, "events").select(F.concat(F.lit("consumer"), L.s(F.col("user_id") % 3)).alias("consumer"), F.concat_ws(".", "event_type", L.s(F.col("event_id") % 2000)).alias("event_id"), F.col("ts").alias("received_at"))
    return governance.first_receipts(rows)


@query("", "WITH b AS (SELECT o_orderkey AS subject_id, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket FROM orders) SELECT subject_id, bucket, CASE WHEN (subject_id < 100 OR CAST(subject_id AS VARCHAR) LIKE '12%') AND bucket < 50 THEN 'canary' ELSE 'baseline' END AS cohort FROM b")
def canary_buckets(spark, sf):
    key = L.s("o_orderkey")
    allowed = (F.col("o_orderkey") < 100) | F.exists(F.array(F.lit("12")), lambda p: key.startswith(p))
    bucket = T.bucket(key)
    return L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("subject_id"), bucket.alias("bucket"), F.when(allowed & (bucket < 50), "canary").otherwise("baseline").alias("cohort"))


# --- ledger ---

_USAGE = "count(*) AS calls, count(*) FILTER (status = 'failed') AS failed_calls, count(*) FILTER (attempt > 1) AS retry_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_microusd) AS BIGINT) AS total_cost_microusd, round(avg(latency_ms), 4) AS average_latency_ms"


@query("inv", f"SELECT agent_id, {_USAGE} FROM inv WHERE agent_id IS NOT NULL GROUP BY agent_id")
def ledger_by_agent(spark, sf):
    return ledger.usage(L.model_invocation(spark, sf), "agent_id")


@query("inv", f"SELECT workload, provider, status, {_USAGE} FROM inv GROUP BY workload, provider, status")
def ledger_by_workload_status(spark, sf):
    return ledger.usage(L.model_invocation(spark, sf), "workload", "provider", "status")


@query("inv", "SELECT run_id, count(*) AS model_calls, CAST(sum(total_tokens) AS BIGINT) AS tokens_used, CAST(sum(CAST(round(cost_usd * 1000000) AS BIGINT)) AS BIGINT) AS ledger_cost, CAST(sum(CAST(ceil(cost_usd * 1000000) AS BIGINT)) AS BIGINT) AS budget_cost FROM inv GROUP BY run_id")
def run_budget(spark, sf):
    return ledger.budgets(L.model_invocation(spark, sf))


_GAP = "gap AS (SELECT run_id, task_id FROM task WHERE task_id % 3 = 0 AND task_id NOT IN (SELECT task_id FROM inv))"


@query("task inv", f"WITH {_GAP} SELECT run_id, task_id FROM gap")
def telemetry_gap(spark, sf):
    return ledger.telemetry_gap(L.workflow_task(spark, sf).where("task_id % 3 = 0").select("run_id", "task_id"), L.model_invocation(spark, sf)).select("run_id", "task_id")


@query("task inv", f"""WITH {_GAP}, p AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (attempt > 1) AS retried, sum(cost_microusd) AS cost FROM inv GROUP BY run_id),
    g AS (SELECT run_id, count(*) AS missing FROM gap GROUP BY run_id), j AS (SELECT coalesce(p.run_id, g.run_id) AS run_id, coalesce(n, 0) AS n, coalesce(failed, 0) AS failed, coalesce(retried, 0) AS retried, coalesce(cost, 0) AS cost, coalesce(missing, 0) AS missing FROM p FULL JOIN g ON p.run_id = g.run_id)
    SELECT run_id, 'model_failures' AS code, 'warning' AS severity, failed AS evidence FROM j WHERE failed > 0 UNION ALL SELECT run_id, 'model_retries', 'info', retried FROM j WHERE retried > 0
    UNION ALL SELECT run_id, 'telemetry_gap', 'critical', missing FROM j WHERE missing > 0 UNION ALL SELECT run_id, 'budget_critical', 'critical', n FROM j WHERE cost >= 1800000
    UNION ALL SELECT run_id, 'budget_warning', 'warning', n FROM j WHERE cost >= 1400000 AND cost < 1800000""")
def audit_alerts(spark, sf):
    calls = L.model_invocation(spark, sf)
    gaps = ledger.telemetry_gap(L.workflow_task(spark, sf).where("task_id % 3 = 0").select("run_id", "task_id"), calls)
    return ledger.alerts(calls, gaps, 2_000_000)


@query("task inv", "SELECT run_id, 'task.' || task_id AS activity_id, 'agent_task' AS kind, subject AS agent_id, status, available_at AS occurred_at, CAST(NULL AS BIGINT) AS total_tokens FROM task UNION ALL SELECT run_id, 'call.' || invocation_id, 'model_invocation', agent_id, status, started_at, total_tokens FROM inv")
def audit_timeline(spark, sf):
    return ledger.timeline(L.workflow_task(spark, sf), L.model_invocation(spark, sf))


@query("task inv", "WITH a(agent_id) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW'), ('idle')), t AS (SELECT subject AS agent_id, count(*) AS task_count FROM task GROUP BY 1), u AS (SELECT agent_id, count(*) AS model_calls, count(*) FILTER (status = 'failed') AS failed_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM inv GROUP BY 1) SELECT a.agent_id, coalesce(task_count, 0) AS task_count, coalesce(model_calls, 0) AS model_calls, coalesce(failed_calls, 0) AS failed_calls, coalesce(total_tokens, 0) AS total_tokens FROM a LEFT JOIN t USING (agent_id) LEFT JOIN u USING (agent_id)")
def agent_task_left_join(spark, sf):
    agents = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "5-LOW", "idle")], "agent_id string")
    return ledger.with_missing_agents(agents, L.workflow_task(spark, sf), L.model_invocation(spark, sf))


@query("task inv", "WITH t AS (SELECT run_id, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY CAST(task_id AS VARCHAR)) AS tasks FROM task GROUP BY run_id), c AS (SELECT run_id, string_agg(invocation_id, ',' ORDER BY invocation_id) AS calls FROM inv GROUP BY run_id) SELECT t.run_id, tasks, coalesce(calls, '') AS calls FROM t LEFT JOIN c USING (run_id)")
def run_trace_collect(spark, sf):
    return ledger.trace(L.workflow_task(spark, sf), L.model_invocation(spark, sf))


# --- retrieval ---


def _chunks(spark, sf):
    return L.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _text_queries(spark, sf):
    """Every benchmark item is a query."""
    return L.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _lexical_index(spark, sf):
    """The stored index of the texts, built once for these files."""
    build = lambda path: postings.Stored.build(_chunks(spark, sf), path)
    return postings.Stored.open(spark, session.stored(spark, "texts-" + session.stamp(spark, f"{sf}/documents.parquet"), build))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TERMS = f"list_filter(list_distinct(regexp_extract_all(lower(query), '{T.TERM}')), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"
_Q = f"q AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT query_id, {_TERMS} AS ts FROM q)"
_LEX = f"""{_Q}, w AS (SELECT query_id, len(ts) AS n, unnest(ts) AS term FROM qt), tf AS (SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.TERM}')) AS term FROM documents) GROUP BY ALL),
    m AS (SELECT query_id, chunk_id, n, count(*) AS matched, sum(tf) AS occ FROM tf JOIN w USING (term) GROUP BY ALL),
    ua AS (SELECT query_id, u, count(*) FILTER (u = 'or') OVER (PARTITION BY query_id ORDER BY i) AS alt FROM (SELECT query_id, generate_subscripts(us, 1) AS i, unnest(us) AS u FROM (SELECT query_id, regexp_extract_all(lower(query), '[^\\s"]+') AS us FROM q))),
    wt AS (SELECT DISTINCT query_id, alt, term FROM (SELECT query_id, alt, unnest(regexp_extract_all(u, '{T.TERM}')) AS term FROM ua WHERE u <> 'or')),
    hit AS (SELECT query_id, alt, chunk_id FROM tf JOIN wt USING (term) JOIN (SELECT query_id, alt, count(*) AS need FROM wt GROUP BY ALL) USING (query_id, alt) GROUP BY query_id, alt, chunk_id, need HAVING count(*) = need),
    pos AS (SELECT chunk_id, p, term FROM (SELECT doc_id AS chunk_id, generate_subscripts(ts, 1) AS p, unnest(ts) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '{T.TERM}') AS ts FROM documents WHERE doc_id IN (SELECT chunk_id FROM hit)))),
    ent AS (SELECT h.query_id, h.chunk_id, p, term FROM (SELECT DISTINCT query_id, chunk_id FROM hit) h JOIN pos USING (chunk_id) JOIN (SELECT DISTINCT query_id, term FROM wt) USING (query_id, term)),
    seen AS (SELECT e.query_id, e.chunk_id, e.p, wt.alt, max(CASE WHEN e.term = wt.term THEN e.p END) OVER (PARTITION BY e.query_id, e.chunk_id, wt.alt, wt.term ORDER BY e.p) AS l FROM ent e JOIN hit h USING (query_id, chunk_id) JOIN wt ON wt.query_id = e.query_id AND wt.alt = h.alt),
    covers AS (SELECT query_id, chunk_id, s, min(p) AS e FROM (SELECT query_id, chunk_id, p, max(s) AS s FROM (SELECT query_id, chunk_id, alt, p, CASE WHEN count(l) = count(*) THEN min(l) END AS s FROM seen GROUP BY ALL) GROUP BY ALL) WHERE s IS NOT NULL GROUP BY ALL),
    den AS (SELECT query_id, chunk_id, sum(0.1::DOUBLE / (1 + (e - s) - (named - 1))) AS density FROM (SELECT c.query_id, c.chunk_id, c.s, c.e, count(*) AS named FROM covers c JOIN ent ON ent.query_id = c.query_id AND ent.chunk_id = c.chunk_id AND ent.p BETWEEN c.s AND c.e GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, coalesce(density, 0) + 0.5 * 0.1::DOUBLE * coalesce(occ, 0) AS r FROM (SELECT query_id, chunk_id, occ FROM m WHERE matched >= least(2, n)) FULL JOIN den USING (query_id, chunk_id)),
    lex AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(r / (1 + r), 6) AS score FROM s) QUALIFY rank <= 10)"""


@query("", f"WITH {_LEX} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lex")
def lexical_topk(spark, sf):
    """Over the stored index: the texts are not read again."""
    return _lexical_index(spark, sf).search(_text_queries(spark, sf), 10)


@query("", f"WITH {_Q} SELECT query_id, array_to_string(list_sort(ts), ' ') AS terms, CAST(len(ts) AS BIGINT) AS n FROM qt WHERE len(ts) <= 64")
def query_term_extraction(spark, sf):
    ts = T.query_terms(F.col("query"))
    return _text_queries(spark, sf).select("query_id", F.array_join(F.array_sort(ts), " ").alias("terms"), F.size(ts).cast("long").alias("n")).where("n <= 64")


@query("", r"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[-|]{2,}', ' ', 'g'), '[\s\x0B]+'), lambda x: x NOT IN ('-', '|', '')), ' ')) AS digest FROM documents")
def tsquery_sanitise(spark, sf):
    return L.read(spark, sf, "documents").select("doc_id", F.md5(T.sanitise_query(F.col("text"))).alias("digest"))


_HAN = "零一二三四五六七八九"
_RUN = f"translate(CAST({{}} AS VARCHAR), '0123456789', '{_HAN}')"
_GRAMS = "CASE WHEN length({0}) = 1 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) END"


@query("", f"WITH r AS (SELECT doc_id, {_RUN.format('doc_id')} AS a, {_RUN.format('n_chars')} AS b FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({_GRAMS.format('a')}, {_GRAMS.format('b')}))), ',') AS grams FROM r")
def cjk_bigrams(spark, sf):
    """Ids and lengths of documents written in Han numerals, two runs around a Latin word."""
    run = lambda c: F.translate(L.s(c), "0123456789", _HAN)
    text = F.concat(run("doc_id"), F.lit(" and ("), run("n_chars"), F.lit(") x"))
    return L.read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(T.cjk_bigrams(text)), ",").alias("grams"))


def _vectors(spark, sf):
    return L.read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark, sf):
    """Every tenth vector is a query."""
    return L.read(spark, sf, "embeddings").where("vec_id % 10 = 0").select(F.expr("vec_id div 10").alias("query_id"), F.col("embedding").alias("query_vector"))


_SIM = "round(greatest(0, least(1, 0.5 + 0.5 * list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))) * list_dot_product(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))))), 6)"
_VQ = "vq AS (SELECT vec_id // 10 AS query_id, embedding, label AS qlabel FROM embeddings WHERE vec_id % 10 = 0)"
_VEC = _VQ + ", sc AS (SELECT query_id, qlabel, b.vec_id AS chunk_id, b.label, " + _SIM + " AS score FROM vq a, embeddings b {}), vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10)"


@query("", f"WITH {_VEC.format('')} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM vec")
def vector_topk_exact(spark, sf):
    return retrieval.vector(_vectors(spark, sf), _vector_queries(spark, sf), 10)


@query("", f"WITH {_VEC.format('WHERE b.label < 5')} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM vec")
def vector_topk_filtered(spark, sf):
    return retrieval.vector(_vectors(spark, sf), _vector_queries(spark, sf), 10, where=F.col("label") < 5)


#: The nearest number of half precision: eleven significant bits, ties to even, steps of 2**-24 at the least.
_STEP = "pow(2, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10)"
_HALVES = f"vh AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0::DOUBLE ELSE round_even(CAST(x AS DOUBLE) / {_STEP}, 0) * {_STEP} END) AS embedding FROM embeddings)"
_HALF = _VEC.format("").replace("vq AS", "vqh AS").replace("FROM embeddings", "FROM vh").replace("vq a, embeddings b", "vqh a, vh b").replace("sc AS", "sch AS").replace("vec AS", "vech AS").replace("FROM sc", "FROM sch")


@query("", f"WITH {_VEC.format('')}, {_HALVES}, {_HALF} SELECT vec.query_id, count(vech.chunk_id) AS overlap, count(*) AS returned FROM vec LEFT JOIN vech ON vech.query_id = vec.query_id AND vech.chunk_id = vec.chunk_id GROUP BY vec.query_id")
def vector_halfprec_overlap(spark, sf):
    return retrieval.narrowed_overlap(_vectors(spark, sf), _vector_queries(spark, sf))


_TWO = f"{_LEX}, {_VEC.format('')}, lists AS (SELECT query_id, 'lexical' AS retriever, chunk_id, rank, score FROM lex UNION ALL SELECT query_id, 'vector', chunk_id, rank, score FROM vec)"


def _lists(spark, sf):
    """Lexical and vector lists of all queries."""
    a, b = lexical_topk(spark, sf), vector_topk_exact(spark, sf)
    return a.withColumn("retriever", F.lit("lexical")).unionByName(b.withColumn("retriever", F.lit("vector")))


_RRF = f"{_TWO}, e AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, count(*) AS agreement, min(rank) AS best_rank FROM lists GROUP BY ALL), n AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM e), rrf AS (SELECT query_id, chunk_id, score, agreement, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, agreement DESC, best_rank, chunk_id) AS position FROM n)"


@query("", f"WITH {_RRF} SELECT query_id, chunk_id, score, agreement, best_rank, CAST(position AS INTEGER) AS position FROM rrf")
def rrf_fusion(spark, sf):
    return retrieval.fuse(_lists(spark, sf))


@query("", f"WITH {_TWO}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retriever, rank) AS n FROM lists) SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + n)), 9) AS score FROM o GROUP BY ALL")
def rrf_running_rank(spark, sf):
    return retrieval.running_fusion(_lists(spark, sf))


@query("", f"WITH {_TWO} SELECT query_id, chunk_id, round(0.5 * coalesce(max(CASE WHEN retriever = 'lexical' THEN score END), 0) + 0.5 * coalesce(max(CASE WHEN retriever = 'vector' THEN score END), 0), 7) AS score FROM lists GROUP BY ALL")
def hybrid_linear_score(spark, sf):
    both = _lists(spark, sf)
    return retrieval.linear(both.where("retriever = 'lexical'"), both.where("retriever = 'vector'"))


@query("readable", f"WITH {_RRF} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position) AS INTEGER) AS place FROM rrf WHERE chunk_id IN (SELECT memory_id FROM readable)")
def hybrid_pipeline(spark, sf):
    """Lexical and vector lists, fused, and authorised for the batch's principal in one join."""
    fused = retrieval.fuse(_lists(spark, sf))
    readable = vis.readable_memories(L.memory_record(spark, sf), L.memory_acl(spark, sf), ME)
    memory_of = L.memory_record(spark, sf).select("memory_id", F.col("memory_id").alias("chunk_id"))
    kept = retrieval.authorised(fused, readable, memory_of)
    return kept.select("query_id", "chunk_id", "score", F.row_number().over(W.Window.partitionBy("query_id").orderBy("position")).alias("place"))


_AGENTS = ("learning-scientist", "experience-engineer", "learning-director")


def _requests(spark, sf):
    """A request for every query of either list: its id deals intent, agent and budget, its words the number of entities."""
    i = F.col("query_id")
    either = _text_queries(spark, sf).join(_vector_queries(spark, sf).select("query_id"), "query_id", "full").withColumn("n", F.size(F.split(F.coalesce("query", F.lit("")), " ")))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return either.select("query_id", "query", pick([x[0] for x in planner.INTENTS], i).alias("intent"), pick(_AGENTS, i).alias("agent_id"), (1 + F.col("n") % 7).cast("long").alias("entity_count"), (4000 * (1 + i % 5)).alias("token_budget"), F.lit(300).cast("long").alias("chunk_tokens"))


_PLAN = (
    "pr AS (SELECT coalesce(item_id, v) AS query_id, list_extract(" + str([i[0] for i in planner.INTENTS]) + ", 1 + coalesce(item_id, v) % 7) AS intent, list_extract(" + str(list(_AGENTS)) + ", 1 + coalesce(item_id, v) % 3) AS agent_id, "
    + "1 + len(string_split(coalesce(text, ''), ' ')) % 7 AS e, 4000 * (1 + coalesce(item_id, v) % 5) AS b, 300 AS t FROM benchmark FULL JOIN (SELECT vec_id // 10 AS v FROM embeddings WHERE vec_id % 10 = 0) ON v = item_id), pi(intent, ca, fu, re, co, score_floor, marginal_gain_floor, st, stages) AS (VALUES "
    + ", ".join(f"('{i[0]}', {i[1]}, {i[2]}, {i[3]}, {i[4]}, {i[5]}::DOUBLE, {i[6]}::DOUBLE, {i[7]}, '{','.join(s for s in i[8] if s in ('lexical', 'vector'))}')" for i in planner.INTENTS)
    + """), pm AS (SELECT *, (CASE agent_id WHEN 'learning-scientist' THEN 1.2::DOUBLE WHEN 'experience-engineer' THEN 0.85::DOUBLE ELSE 1 END) * least(1.5::DOUBLE, 1 + (e - 1) * 0.12::DOUBLE) AS f, greatest(1, floor(round(b * 0.7::DOUBLE / t, 9))) AS cap FROM pr JOIN pi USING (intent)),
    plan AS (SELECT CAST(query_id AS BIGINT) AS query_id, intent, CAST(least(100, ceil(round(ca * f, 9))) AS BIGINT) AS candidate_k, CAST(least(150, ceil(round(fu * f, 9))) AS BIGINT) AS fusion_k, CAST(least(50, ceil(round(re * f, 9))) AS BIGINT) AS rerank_k,
    CAST(least(30, greatest(1, least(ceil(round(co * f, 9)), cap))) AS BIGINT) AS context_k, CAST(least(CASE intent WHEN 'count_events' THEN 3 ELSE 2 END, cap) AS BIGINT) AS min_context_k, CAST(greatest(t, floor(round(b * 0.7::DOUBLE, 9))) AS BIGINT) AS max_context_tokens,
    score_floor, marginal_gain_floor, CASE WHEN st THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS coverage_target, stages FROM pm)"""
)


@query("", f"WITH {_PLAN} SELECT * FROM plan")
def plan_table(spark, sf):
    """A plan for every query."""
    return planner.plan(_requests(spark, sf).drop("query"))


def _candidates(spark, sf):
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), T.token_estimate(F.col("text")).alias("token_count"), F.col("source").alias("source_type"), F.array("lang").alias("entity_keys"))
    return retrieval.fuse(_lists(spark, sf)).join(docs, "chunk_id")


_CANDIDATES = "cand AS (SELECT query_id, chunk_id, score, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tok, source, lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM rrf JOIN documents ON doc_id = chunk_id)"
#: The greedy scan over `cand` under `plan`, candidate by candidate.
_WALK = """walk AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS tokens, CAST([] AS VARCHAR[]) AS langs, CAST([] AS VARCHAR[]) AS given, 0::DOUBLE AS last, '' AS first_source, FALSE AS took, '' AS why FROM plan
    UNION ALL SELECT query_id, n, chunk_id, taken + CASE WHEN why = '' AND took THEN 1 ELSE 0 END, tokens + CASE WHEN why = '' AND took THEN tok ELSE 0 END, CASE WHEN why = '' AND took THEN list_append(langs, lang) ELSE langs END, CASE WHEN why = '' AND took THEN list_append(given, source) ELSE given END,
        CASE WHEN why = '' AND took THEN score ELSE last END, CASE WHEN why = '' AND took AND taken = 0 THEN source ELSE first_source END, why = '' AND took, why
        FROM (SELECT w.query_id, c.n, c.chunk_id, c.score, c.tok, c.source || '|' || c.lang AS source, c.lang, w.taken, w.tokens, w.langs, w.given, w.last, w.first_source,
            NOT (w.taken > 0 AND list_contains(w.langs, c.lang) AND c.source = string_split(w.first_source, '|')[1] AND len(list_filter(w.given, lambda g: g = c.source || '|' || c.lang)) >= 8) AS took,
            CASE WHEN w.taken >= p.context_k THEN 'context_k' WHEN w.taken >= p.min_context_k AND c.score < p.score_floor THEN 'score_floor' WHEN w.taken >= p.min_context_k AND w.last > 0 AND (w.last - c.score) / w.last >= p.marginal_gain_floor THEN 'marginal_gain' WHEN w.tokens + c.tok > p.max_context_tokens THEN 'token_budget' ELSE '' END AS why
            FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.n = w.n + 1 JOIN plan p ON p.query_id = w.query_id WHERE w.why = '')),
    ended AS (SELECT query_id, arg_max(CASE WHEN why = '' THEN 'exhausted' ELSE why END, n) AS stopped_by, arg_max(tokens, n) AS used_tokens FROM walk GROUP BY query_id)"""
_EVIDENCE = f"""WITH RECURSIVE {_RRF}, {_CANDIDATES}, {_PLAN},
    {_WALK}
    SELECT query_id, chunk_id, taken AS place, used_tokens, stopped_by FROM walk JOIN ended USING (query_id) WHERE took"""


@query("", _EVIDENCE)
def evidence_selection(spark, sf):
    return evidence.select_batch(_candidates(spark, sf), planner.plan(_requests(spark, sf).drop("query")))


def _regions(spark, sf):
    turn = F.col("turn").cast("long")
    return L.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + turn).alias("chunk_id"), F.col("conv_id").alias("memory_id"), turn.alias("ordinal"), F.floor(turn / 3).alias("region"), F.array("role").alias("entity_keys"), (turn % 4).alias("time_key"), T.token_estimate(F.col("text")).alias("token_count"))


_REGION = "c AS (SELECT conv_id * 100 + turn AS chunk_id, conv_id AS memory_id, turn AS ordinal, floor(turn / 3) AS region, role, turn % 4 AS time_key FROM conversations)"


@query("", f"WITH {_REGION}, p AS (SELECT a.chunk_id AS anchor_id, b.chunk_id, CASE WHEN a.region = b.region THEN 1.0 WHEN abs(a.ordinal - b.ordinal) = 1 THEN 0.8 WHEN a.role = b.role THEN 0.6 WHEN a.time_key = b.time_key THEN 0.4 END::DOUBLE AS priority FROM c a JOIN c b ON a.memory_id = b.memory_id AND a.chunk_id <> b.chunk_id) SELECT anchor_id, chunk_id, priority, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY priority DESC, chunk_id) AS INTEGER) AS place FROM p WHERE priority IS NOT NULL QUALIFY place <= 3")
def relation_expansion_candidates(spark, sf):
    chunks = _regions(spark, sf)
    return retrieval.related(chunks, chunks, 3)


_NEAR = "SELECT anchor_id, chunk_id, priority, row_number() OVER (PARTITION BY anchor_id ORDER BY priority DESC, chunk_id) AS place FROM (SELECT a.chunk_id AS anchor_id, b.chunk_id, CASE WHEN a.region = b.region THEN 1.0 WHEN abs(a.ordinal - b.ordinal) = 1 THEN 0.8 WHEN a.role = b.role THEN 0.6 WHEN a.time_key = b.time_key THEN 0.4 END::DOUBLE AS priority FROM c a JOIN c b ON a.memory_id = b.memory_id AND a.chunk_id <> b.chunk_id AND a.ordinal = 0) WHERE priority IS NOT NULL QUALIFY place <= 3"


@query("", f"""WITH RECURSIVE {_REGION}, tok AS (SELECT conv_id * 100 + turn AS chunk_id, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tokens FROM conversations), near AS ({_NEAR}),
    walk AS (SELECT memory_id AS query_id, chunk_id AS anchor, CAST(0 AS BIGINT) AS n, chunk_id, tokens AS used, CAST(1 AS BIGINT) AS place, TRUE AS took FROM c JOIN tok USING (chunk_id) WHERE ordinal = 0
    UNION ALL SELECT query_id, anchor, w.n + 1, near.chunk_id, used + CASE WHEN tokens <= 20000 - used THEN tokens ELSE 0 END, w.place + CASE WHEN tokens <= 20000 - used THEN 1 ELSE 0 END, tokens <= 20000 - used FROM walk w JOIN near ON anchor_id = anchor AND near.place = w.n + 1 JOIN tok ON tok.chunk_id = near.chunk_id)
    SELECT query_id, chunk_id, place FROM walk WHERE took""")
def context_expansion(spark, sf):
    chunks = _regions(spark, sf)
    near = retrieval.related(chunks, chunks, 3).join(chunks.select("chunk_id", "token_count"), "chunk_id").select("anchor_id", "chunk_id", "priority", "token_count")
    hits = chunks.where("ordinal = 0").select(F.col("memory_id").alias("query_id"), "chunk_id", "token_count", F.lit(1).alias("place"))
    return evidence.expand_batch(hits, near, 20_000)


_SUBSTITUTED = f"""WITH RECURSIVE {_RRF}, hits AS (SELECT query_id, chunk_id, score, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tok, chunk_id - chunk_id % 5 AS parent, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM rrf JOIN documents ON doc_id = chunk_id),
    walk AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(sum(tok) AS BIGINT) AS used, CAST([] AS BIGINT[]) AS keys, CAST(NULL AS BIGINT) AS key, 0::DOUBLE AS score, CAST(0 AS BIGINT) AS tokens FROM hits GROUP BY query_id
    UNION ALL SELECT query_id, n, CASE WHEN fits THEN used + grow ELSE used END, list_append(keys, CASE WHEN fits THEN parent ELSE chunk_id END), CASE WHEN fits THEN parent ELSE chunk_id END, score, CASE WHEN fits THEN tok * 2 ELSE tok END
        FROM (SELECT *, used + grow <= 200000 AS fits FROM (SELECT w.query_id, h.n, w.used, w.keys, h.parent, h.chunk_id, h.score, h.tok, CASE WHEN list_contains(w.keys, h.parent) THEN 0 ELSE h.tok * 2 END - h.tok AS grow FROM walk w JOIN hits h ON h.query_id = w.query_id AND h.n = w.n + 1)))
    SELECT query_id, key AS chunk_id, max(score) AS score, arg_min(tokens, n) AS token_count FROM walk WHERE n > 0 GROUP BY query_id, key"""


@query("", _SUBSTITUTED)
def parent_substitution(spark, sf):
    rows = _candidates(spark, sf).select("query_id", "chunk_id", "score", "token_count", (F.col("chunk_id") - F.col("chunk_id") % 5).alias("parent_id"), (F.col("token_count") * 2).alias("parent_tokens"), F.col("position").alias("place"))
    return evidence.substitute_batch(rows, 200_000)


# --- chunking and parsing ---


@query("", "WITH p AS (SELECT doc_id AS memory_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)), c AS (SELECT memory_id, i, k, trim(substr(t, k * 200 + 1, 200)) AS content FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(t) / 200) AS BIGINT)))) AS k FROM p)) SELECT memory_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS characters FROM c WHERE content <> '' GROUP BY memory_id")
def paragraph_chunks(spark, sf):
    """The fixture has one line a paragraph, so line feeds are doubled first."""
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.paragraphs(docs, 200).groupBy("memory_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters"))


@query("", "WITH c AS (SELECT doc_id, unnest(list_filter(list_transform(range(0, greatest(1, CAST(ceil(length(text) / 500) AS BIGINT))), lambda i: trim(substr(text, i * 500 + 1, 500))), lambda p: p <> '')) AS p FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)) SELECT doc_id, count(*) AS pieces, CAST(sum(length(p)) AS BIGINT) AS characters FROM c GROUP BY doc_id")
def fixed_width_split(spark, sf):
    rows = L.read(spark, sf, "documents").select("doc_id", F.explode(T.split_long(F.replace("text", F.lit("\n"), F.lit(" ")), 500)).alias("p"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length(F.trim("p"))).alias("characters"))


@query("", "SELECT doc_id AS memory_id, 'sha256:' || sha256(text) AS chunk_digest, 'chunk.' || sha256('v1' || chr(10) || doc_id || chr(10) || '0' || chr(10) || 'sha256:' || sha256(text)) AS chunk_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS token_count FROM documents")
def chunk_identity(spark, sf):
    rows = L.read(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), T.digest(F.col("text")).alias("chunk_digest"), T.token_estimate(F.col("text")).alias("token_count"))
    return rows.select("memory_id", "chunk_digest", chunking.identity(F.lit("v1"), F.col("memory_id"), F.lit(0), F.col("chunk_digest")).alias("chunk_id"), "token_count")


@query("", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def chunk_digest_check(spark, sf):
    cited = F.when(F.col("doc_id") % 10 == 0, T.digest(F.lit("other"))).otherwise(T.digest(F.col("text")))
    return L.read(spark, sf, "documents").where(T.digest(F.col("text")) != cited).select("doc_id")


_TURNS = """WITH RECURSIVE t AS (SELECT conv_id AS memory_id, turn, '[' || role || '/' || role || ' #' || turn || '] ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    w AS (SELECT memory_id, n, turn, line, CAST(1 AS BIGINT) AS g, length(line) AS size FROM t WHERE n = 1
    UNION ALL SELECT t.memory_id, t.n, t.turn, t.line, w.g + CASE WHEN w.size + 2 + length(t.line) > 4800 THEN 1 ELSE 0 END, CASE WHEN w.size + 2 + length(t.line) > 4800 THEN length(t.line) ELSE w.size + 2 + length(t.line) END FROM w JOIN t ON t.memory_id = w.memory_id AND t.n = w.n + 1),
    p AS (SELECT memory_id, g, min(n) + g - 2 AS head, string_agg(line, chr(10) || chr(10) ORDER BY n) AS content, 'turns ' || min(turn) || '-' || max(turn) AS locator FROM w GROUP BY memory_id, g)
    SELECT memory_id, CAST(head AS BIGINT) AS ordinal, 'parent' AS level, CAST(NULL AS BIGINT) AS parent, content, locator, 'conversation' AS path FROM p
    UNION ALL SELECT w.memory_id, CAST(w.g + w.n - 1 AS BIGINT), 'child', CAST(head AS BIGINT), line, 'turn ' || turn, 'conversation' FROM w JOIN p USING (memory_id, g)"""


@query("", _TURNS)
def conversation_chunks(spark, sf):
    turns = L.read(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct(F.col("turn").alias("sequence"), "role", "text"))).alias("text"))

    def cut(text: str) -> list:
        import json

        return chunking.conversation(json.loads(text))

    return chunking.chunk(turns.select(F.col("conv_id").alias("memory_id"), "text"), cut)


@query()
def markdown_chunks(spark, sf):
    """Documents with their first line as a heading."""
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return chunking.identified(chunking.chunk(docs, chunking.markdown), "v1")


_ROWS = """WITH RECURSIVE t AS (SELECT c_custkey // 100 AS memory_id, 'key=' || c_custkey || ' | name=' || c_name AS line, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS n FROM customer),
    w AS (SELECT memory_id, n, line, CAST(1 AS BIGINT) AS g, 189 - length(line) AS room FROM t WHERE n = 1
    UNION ALL SELECT t.memory_id, t.n, t.line, w.g + CASE WHEN length(t.line) + 1 > w.room THEN 1 ELSE 0 END, CASE WHEN length(t.line) + 1 > w.room THEN 189 - length(t.line) ELSE w.room - length(t.line) - 1 END FROM w JOIN t ON t.memory_id = w.memory_id AND t.n = w.n + 1)
    SELECT memory_id, CAST(0 AS BIGINT) AS ordinal, 'parent' AS level, CAST(NULL AS BIGINT) AS parent, 'key | name' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS content, 'customer!1-' || max(n) AS locator, 'customer' AS path FROM w GROUP BY memory_id
    UNION ALL SELECT memory_id, g, 'child', CAST(0 AS BIGINT), 'key | name' || chr(10) || string_agg(line, chr(10) ORDER BY n), 'customer!' || min(n) || '-' || max(n), 'customer' FROM w GROUP BY memory_id, g"""


@query("", _ROWS)
def table_row_chunks(spark, sf):
    """A table of each hundred customers, in chunks of 200 characters."""
    rows = L.read(spark, sf, "customer").groupBy(F.expr("c_custkey div 100").alias("memory_id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name")))).alias("text"))

    def cut(text: str) -> list:
        import json

        return chunking.table("customer", ["key", "name"], [[str(x["c_custkey"]), x["c_name"]] for x in json.loads(text)], 200)

    return chunking.chunk(rows, cut)


@query("", "SELECT * FROM (VALUES ('childless_parent', CAST(0 AS BIGINT)), ('document_without_chunks', CAST((SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS BIGINT)), ('orphan_child', CAST(0 AS BIGINT)), ('repeated_chunk_id', CAST((SELECT count(*) FROM documents WHERE doc_id % 50 = 7) AS BIGINT))) t(reason, n)")
def ready_gate_reasons(spark, sf):
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"))
    parent = docs.where("memory_id % 50 <> 0").select("memory_id", F.lit(0).alias("ordinal"), F.lit("parent").alias("level"), F.lit(None).cast("int").alias("parent"))
    rows = parent.unionByName(parent.select("memory_id", F.lit(1).alias("ordinal"), F.lit("child").alias("level"), F.lit(0).alias("parent")))
    rows = rows.withColumn("chunk_id", F.concat_ws(".", "memory_id", "ordinal"))
    return chunking.gate(rows.unionByName(rows.where("memory_id % 50 = 7 and level = 'child'")), docs)


@query("", "WITH r AS (SELECT c_custkey // 100 AS memory_id, c_acctbal, 1 + row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS k FROM customer), g AS (SELECT memory_id, count(*) AS n, min(CASE WHEN c_acctbal < -900 THEN k END) AS bad FROM r GROUP BY 1) SELECT memory_id, CAST(CASE WHEN bad IS NULL THEN 3 ELSE 0 END AS BIGINT) AS n_columns, CASE WHEN bad IS NULL THEN n ELSE 0 END AS n_rows, 'row ' || bad || ' has 2 cells, not 3' AS error FROM g")
def csv_validation(spark, sf):
    """A file for each hundred customers; those far in debt have no balance, which makes their row too short."""
    row = F.concat_ws(",", L.s("c_custkey"), F.concat(F.lit('" '), "c_name", F.lit(' ""x""\n"')), F.when(F.col("c_acctbal") >= -900, L.s("c_acctbal")))
    files = L.read(spark, sf, "customer").groupBy(F.expr("c_custkey div 100").alias("memory_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda r: r["row"]), "\n").alias("rows"))
    return parsers.csv_tables(files.select("memory_id", F.concat(F.lit("id, name ,balance\n"), "rows", F.lit("\n\n")).alias("text")))


@query("", "SELECT conv_id AS memory_id, CASE WHEN conv_id % 9 = 1 THEN 'schema_version' WHEN bool_or(role NOT IN ('user', 'assistant', 'tool', 'speaker')) THEN 'role' WHEN conv_id % 7 = 2 THEN 'ends_before_start' END AS error FROM conversations GROUP BY conv_id")
def transcript_validation(spark, sf):
    c = L.read(spark, sf, "conversations")
    turn = F.struct(L.s("turn").alias("turn_id"), F.col("turn").alias("sequence"), F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.lit("2024-01-01T10:00:00Z").alias("started_at"), F.when(F.col("conv_id") % 7 == 2, "2024-01-01T09:00:00Z").otherwise("2024-01-01T10:05:00Z").alias("ended_at"))
    docs = c.groupBy("conv_id").agg(F.collect_list(turn).alias("turns")).select(F.col("conv_id").alias("memory_id"), F.to_json(F.struct(F.when(F.col("conv_id") % 9 == 1, 2).otherwise(1).alias("schema_version"), "turns")).alias("text"))
    return parsers.transcript_errors(docs)


@query("", "WITH r AS (SELECT p_partkey % 100 AS doc, p_size AS page, p_partkey % 7 AS region_id, p_partkey % 90 AS x0, p_partkey % 80 AS y0, p_partkey % 90 + p_size % 30 AS x1, p_partkey % 80 + 10 AS y1, (p_partkey % 103) / 100 AS confidence FROM part), e AS (SELECT doc, CASE WHEN x1 > 100 OR y1 > 85 OR x1 <= x0 THEN 'bbox' WHEN confidence > 1 THEN 'confidence' END AS error FROM r UNION ALL SELECT doc, 'repeated_region' FROM r GROUP BY doc, page, region_id HAVING count(*) > 1) SELECT doc, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL")
def ocr_layout_validation(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    return parsers.layout_errors(L.read(spark, sf, "part").select((k % 100).alias("doc"), size.alias("page"), (k % 7).alias("region_id"), (k % 90).alias("x0"), (k % 80).alias("y0"), (k % 90 + size % 30).alias("x1"), (k % 80 + 10).alias("y1"), F.lit(100).alias("width"), F.lit(85).alias("height"), ((k % 103) / 100).alias("confidence")))


@query("", "WITH t AS (SELECT conv_id, turn + CASE WHEN turn > 4 THEN 2 ELSE 1 END AS seq, turn * 1000 - CASE WHEN turn = 3 THEN 2500 ELSE 0 END AS a, turn * 1000 + 900 AS b FROM conversations), e AS (SELECT conv_id, CASE WHEN seq <> row_number() OVER (PARTITION BY conv_id ORDER BY seq) THEN 'sequence_gap' WHEN a < lag(a) OVER (PARTITION BY conv_id ORDER BY seq) THEN 'start_falls' WHEN b > 6000 THEN 'beyond_duration' END AS error FROM t) SELECT conv_id, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL")
def asr_monotonicity(spark, sf):
    t = F.col("turn")
    rows = L.read(spark, sf, "conversations").select("conv_id", (t + F.when(t > 4, 2).otherwise(1)).alias("seq"), (t * 1000 - F.when(t == 3, 2500).otherwise(0)).alias("a"), (t * 1000 + 900).alias("b"))
    return parsers.sequence_errors(rows, "conv_id", "seq", "a", "b", F.lit(6000))


@query("", "SELECT doc_id, 'chunk_size' AS rule FROM documents WHERE length(text) > 8000 UNION ALL SELECT doc_id, 'n_chars' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'language' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')")
def chunk_validity(spark, sf):
    docs = L.read(spark, sf, "documents")
    rules = {"chunk_size": F.length("text") <= 8000, "n_chars": F.col("n_chars") == F.length("text"), "language": F.col("lang").isin("en", "fr", "de"), "digest": T.digest(F.col("text")).rlike("^sha256:[a-f0-9]{64}$")}
    return lifecycle.broken(docs, "doc_id", rules)


@query("", "SELECT doc_id AS chunk_id, 'new' AS what FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'contradicts' FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 = 0")
def chunk_upsert_conflicts(spark, sf):
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars"))
    incoming = docs.withColumn("n_chars", F.col("n_chars") + F.when((F.col("chunk_id") % 3 == 1) & (F.col("chunk_id") % 4 == 0), 1).otherwise(0))
    new, bad = lifecycle.upsert(docs.where("chunk_id % 3 <> 0"), incoming, "chunk_id", ["n_chars"])
    return new.select("chunk_id", F.lit("new").alias("what")).unionByName(bad.select("chunk_id", F.lit("contradicts").alias("what")))


# --- text functions ---


@query("", r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), 'https?://\S+', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def text_clean(spark, sf):
    return L.read(spark, sf, "pages").select("page_id", F.md5(T.clean(F.col("html"))).alias("digest"))


#: By event type: a message with something secret in it, and what is left of it.
_MESSAGES = {
    "view": ("GET postgres://user:{}@host/db failed", "GET [redacted-uri]@host/db failed"),
    "click": ("Authorization: Bearer {} rejected", "Authorization: Bearer [redacted] rejected"),
    "signup": ("api_key={} is invalid", "[redacted] is invalid"),
    "purchase": ("digest {} missing", "digest [redacted] missing"),
    "error": ("plain \t message {0:.0}", "plain message"),
}


@query("", "SELECT event_id AS id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{b}'" for k, (_, b) in _MESSAGES.items()) + " END || ' for ' || user_id AS message FROM events")
def error_redaction(spark, sf):
    secret, parts = F.md5(L.s("event_id")), []
    for kind, (text, _) in _MESSAGES.items():
        before, _, after = text.replace("{0:.0}", "").partition("{}")
        parts.append((kind, F.concat(F.lit(before), secret if "{}" in text else F.lit(""), F.lit(after))))
    message = F.coalesce(*(F.when(F.col("event_type") == kind, m) for kind, m in parts))
    return L.read(spark, sf, "events").select(F.col("event_id").alias("id"), T.redact_error(F.concat(message, F.lit(" for "), L.s("user_id"))).alias("message"))


@query("", "SELECT page_id AS id, 'see ' || regexp_extract(url, '^https?://([^/]+)', 1) || ' at ' || page_id || ' pic d' AS plain FROM pages")
def markdown_strip(spark, sf):
    """A badge, a link with the page's own address, an image, and marks."""
    u, i = F.col("url"), L.s("page_id")
    text = F.concat(F.lit("[!["), i, F.lit("](x)](y) see ["), F.regexp_extract(u, "^https?://([^/]+)", 1), F.lit("]("), u, F.lit(") at `"), i, F.lit("`\n| ![pic]("), u, F.lit(") *d* |"))
    return L.read(spark, sf, "pages").select(F.col("page_id").alias("id"), T.strip_markdown(text).alias("plain"))


@query("", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._/:-]+', '-', 'g'), '^[^A-Za-z0-9]+', ''), ''), 'key') || '.' || substr(sha256(url), 1, 8) AS key FROM pages")
def safe_key(spark, sf):
    return L.read(spark, sf, "pages").select("page_id", T.safe_key(F.col("url")).alias("key"))


@query("", "SELECT doc_id, substr(text, 1, 100) AS summary, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), 1, 10), ',') AS terms, md5(text) AS content_hash FROM documents")
def metadata_enrich(spark, sf):
    t = F.col("text")
    return L.read(spark, sf, "documents").select("doc_id", F.substring(t, 1, 100).alias("summary"), F.array_join(T.identifiers(t), ",").alias("terms"), F.md5(t).alias("content_hash"))


@query("", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS label FROM pages")
def path_labels(spark, sf):
    u = F.col("url")
    return L.read(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, "^https?://[^/]+/([a-z]+)/", 1).alias("label"))


@query("", "SELECT doc_id AS doc, CAST(c AS BIGINT) AS part, md5(doc_id || ':' || c) AS digest, CAST('0x' || substr(md5(doc_id || ':' || c), 1, 7) AS BIGINT) % 512 AS entity FROM documents, range(0, 5) u(c)")
def synthetic_corpus(spark, sf):
    """Five chunks for each document of the table."""
    rows = L.read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("part")).withColumn("part", F.col("part").cast("long"))
    m = F.md5(F.concat_ws(":", L.s("doc"), L.s("part")))
    return rows.select("doc", "part", m.alias("digest"), (F.conv(F.substring(m, 1, 7), 16, 10).cast("long") % 512).alias("entity"))


# --- metrics ---

_GRADED = _VEC.format("") + ", g AS (SELECT query_id, rank, CASE WHEN label = qlabel THEN CASE WHEN chunk_id % 3 = 0 THEN 3 ELSE 2 END ELSE chunk_id % 2 END AS grade FROM vec), tot AS (SELECT query_id, count(*) AS relevant FROM vq JOIN embeddings ON label = qlabel GROUP BY 1)"


def _query_labels(spark, sf):
    """The label of each query's own vector; vectors of that label are relevant."""
    return L.read(spark, sf, "embeddings").where("vec_id % 10 = 0").select(F.expr("vec_id div 10").alias("query_id"), F.col("label").alias("qlabel"))


def _relevant(spark, sf):
    return _vectors(spark, sf).join(retrieval.small(_query_labels(spark, sf)), F.col("label") == F.col("qlabel")).select("query_id", "chunk_id")


def _graded(spark, sf):
    hits = vector_topk_exact(spark, sf).join(_vectors(spark, sf).select("chunk_id", "label"), "chunk_id").join(retrieval.small(_query_labels(spark, sf)), "query_id")
    grade = F.when(F.col("label") == F.col("qlabel"), F.when(F.col("chunk_id") % 3 == 0, 3).otherwise(2)).otherwise(F.col("chunk_id") % 2)
    return hits.select("query_id", "rank", grade.cast("long").alias("grade"))


_K = ", ".join(f"round(count(*) FILTER (grade >= 2 AND rank <= {k}) / max(relevant), 6) AS recall{k}, round(count(*) FILTER (grade >= 2 AND rank <= {k}) / {k}, 6) AS precision{k}, round(coalesce(sum(CASE WHEN rank <= {k} THEN (pow(2, grade) - 1) / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, {k + 1}), lambda i: (CASE WHEN i <= floor(max(relevant) / 4 + 0.5) THEN 7.0 WHEN i <= max(relevant) THEN 3.0 ELSE 1.0 END)::DOUBLE / log2(i + 1))), 6) AS ndcg{k}" for k in (5, 10))


@query("", f"WITH {_GRADED}, h AS (SELECT *, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM g) SELECT query_id, round(coalesce(max(CASE WHEN grade >= 2 THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr, round(coalesce(sum(CASE WHEN grade >= 2 THEN n::DOUBLE / rank END) / least(max(relevant), count(*)), 0), 6) AS ap, {_K} FROM h JOIN tot USING (query_id) GROUP BY query_id")
def retrieval_metrics(spark, sf):
    totals = _relevant(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return metrics.ranking_scores(_graded(spark, sf), totals)


@query("", f"WITH {_VEC.format('')}, fc AS (SELECT DISTINCT query_id, vec_id % 4 AS facet FROM vq JOIN embeddings ON label = qlabel), sh AS (SELECT DISTINCT query_id, chunk_id % 4 AS facet FROM vec WHERE label = qlabel AND rank <= 5) SELECT query_id, round(count(sh.facet) / count(*), 6) AS coverage FROM fc LEFT JOIN sh USING (query_id, facet) GROUP BY query_id")
def facet_coverage(spark, sf):
    v = _vectors(spark, sf)
    facets = _relevant(spark, sf).select("query_id", (F.col("chunk_id") % 4).alias("facet"))
    ranked = vector_topk_exact(spark, sf).join(v.select("chunk_id", "label"), "chunk_id").join(retrieval.small(_query_labels(spark, sf)), "query_id").where("label = qlabel").select("query_id", "rank", (F.col("chunk_id") % 4).alias("facet"))
    return metrics.facet_coverage(ranked, facets, 5)


_PLACES = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall{k}" for k in (1, 5, 10, 20))


@query("", f"WITH {_VEC.format('').replace('QUALIFY rank <= 10', '')}, w AS (SELECT query_id, query_id * 10 AS chunk_id FROM vq), j AS (SELECT query_id, rank FROM w LEFT JOIN vec USING (query_id, chunk_id)) SELECT count(*) AS queries, {_PLACES}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, quantile_disc(rank, 0.5) AS median_rank, count(*) FILTER (rank IS NULL) AS not_found FROM j")
def known_item(spark, sf):
    """Each query's own vector among all others, at its rank in the whole order and not only in a list of ten."""
    wanted = _vector_queries(spark, sf).withColumn("chunk_id", F.col("query_id") * 10)
    return metrics.known_item(retrieval.places(_vectors(spark, sf), wanted), wanted.select("query_id", "chunk_id"))


@query("inv", "SELECT provider, count(*) AS n, round(avg(latency_ms), 4) AS mean, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, count(*) >= 100 AS p99_reliable, max(latency_ms) AS max FROM inv GROUP BY provider")
def latency_percentiles_nearest_rank(spark, sf):
    return metrics.summary(L.model_invocation(spark, sf), "provider", "latency_ms")


@query("inv", "WITH r AS (SELECT provider, latency_ms, row_number() OVER (PARTITION BY provider ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY provider) AS n FROM inv) SELECT provider, max(CASE WHEN r = least(n - 1, floor(n * 0.5::DOUBLE)) + 1 THEN latency_ms END) AS p50, max(CASE WHEN r = least(n - 1, floor(n * 0.95::DOUBLE)) + 1 THEN latency_ms END) AS p95 FROM r GROUP BY provider")
def latency_percentiles_floor(spark, sf):
    return metrics.floor_rank(L.model_invocation(spark, sf), "provider", "latency_ms", (0.5, 0.95))


@query("", "WITH e AS (SELECT vec_id % 20 AS case_id, CASE WHEN vec_id % 2 = 0 THEN 'recall' ELSE 'acl' END AS kind, vec_id AS memory_id FROM embeddings), h AS (SELECT DISTINCT vec_id % 20 AS case_id, vec_id AS memory_id FROM embeddings WHERE vec_id % 11 <> 3 AND (vec_id % 2 = 0 OR vec_id % 97 = 1)) SELECT kind, round(CASE kind WHEN 'acl' THEN 1 - count(h.memory_id) / count(*) ELSE count(h.memory_id) / count(*) END, 6) AS score, count(*) AS expectations, round(CASE kind WHEN 'acl' THEN 1 - count(h.memory_id) / count(*) ELSE count(h.memory_id) / count(*) END, 6) >= 0.9 AS passed FROM e LEFT JOIN h USING (case_id, memory_id) GROUP BY kind")
def quality_probe_scores(spark, sf):
    v = L.read(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("case_id"), F.when(F.col("vec_id") % 2 == 0, "recall").otherwise("acl").alias("kind"), F.col("vec_id").alias("memory_id"))
    return metrics.probe_scores(v, v.where("memory_id % 11 <> 3 and (memory_id % 2 = 0 or memory_id % 97 = 1)"))


_QV = ", ".join(f"('{d}', '{m}', {b}::DOUBLE, {w}::DOUBLE, '{o}')" for d, m, b, w, o in metrics.QUALITY)


@query("", f"WITH d(dimension, metric, baseline, weight, direction) AS (VALUES {_QV}), m AS (SELECT s_suppkey AS subject_id, 'seckill_p99_ms' AS metric, CAST(s_suppkey * 5 AS DOUBLE) AS actual FROM supplier UNION ALL SELECT s_suppkey, 'interface_success_rate', 1 - s_suppkey / 1000::DOUBLE FROM supplier UNION ALL SELECT s_suppkey, 'test_coverage', (s_suppkey % 10) / 10::DOUBLE FROM supplier), x AS (SELECT s.subject_id, weight, direction, baseline, coalesce(actual, baseline) AS a FROM (SELECT DISTINCT subject_id FROM m) s CROSS JOIN d LEFT JOIN m ON m.subject_id = s.subject_id AND m.metric = d.metric), o AS (SELECT subject_id, round(sum(weight * CASE direction WHEN 'ge' THEN CASE WHEN baseline > 0 THEN least(a / baseline, 1) ELSE 1 END ELSE CASE WHEN a > 0 THEN least(baseline / a, 1) ELSE 1 END END), 4) AS overall FROM x GROUP BY subject_id) SELECT subject_id, overall, CASE WHEN overall >= 0.95 THEN 'up' WHEN overall < 0.85 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN round(0.95::DOUBLE - overall, 6) >= 0.1 THEN 'P0' WHEN round(0.95::DOUBLE - overall, 6) >= 0.05 THEN 'P1' ELSE 'P2' END AS priority FROM o")
def quality_score(spark, sf):
    k = F.col("s_suppkey")
    m = L.read(spark, sf, "supplier").select(k.alias("subject_id"), F.explode(F.create_map(F.lit("seckill_p99_ms"), (k * 5).cast("double"), F.lit("interface_success_rate"), 1 - k / 1000, F.lit("test_coverage"), (k % 10) / 10)).alias("metric", "actual"))
    return metrics.quality_scores(m)


@query("", "WITH s AS (SELECT c_custkey AS subject_id, c_mktsegment AS tier, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS score FROM customer UNION ALL SELECT c_custkey, 'extra', c_acctbal / 2 FROM customer), w(tier, weight) AS (SELECT DISTINCT c_mktsegment, 0.6::DOUBLE FROM customer UNION ALL SELECT 'extra', 0.4::DOUBLE) SELECT subject_id, round(sum(score * weight) / sum(weight), 6) AS total, count(*) AS tiers FROM s JOIN w USING (tier) WHERE score IS NOT NULL GROUP BY subject_id")
def weighted_total(spark, sf):
    c = L.read(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("tier"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("score"))
    b = c.select(F.col("c_custkey").alias("subject_id"), F.lit("extra").alias("tier"), (F.col("c_acctbal") / 2).alias("score"))
    weights = c.select(F.col("c_mktsegment").alias("tier")).distinct().withColumn("weight", F.lit(0.6)).unionByName(spark.createDataFrame([("extra", 0.4)], "tier string, weight double"))
    return metrics.weighted_total(a.unionByName(b), weights)


@query("", "SELECT doc_id FROM documents WHERE doc_id % 25 = 0")
def equidistant_sample(spark, sf):
    return metrics.sample_every(L.read(spark, sf, "documents").select("doc_id"), "doc_id", 25)


# --- graph ---


@query("edge", """WITH RECURSIVE e AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM edge WHERE conflict_status = 'none'), p AS (SELECT 'customer:' || c_custkey AS start_id, 'region:' || (c_custkey % 5) AS target FROM customer),
    w AS (SELECT DISTINCT start_id, start_id AS node, [start_id] AS path, 0 AS hops FROM p UNION ALL SELECT w.start_id, e.b, list_append(w.path, e.b), hops + 1 FROM w JOIN e ON e.a = w.node WHERE hops < 6),
    f AS (SELECT start_id, node, min(path) AS path FROM (SELECT *, min(hops) OVER (PARTITION BY start_id, node) AS least FROM w) WHERE hops = least GROUP BY start_id, node)
    SELECT p.start_id AS start, p.target, array_to_string(f.path, '>') AS path, CAST(len(f.path) - 1 AS BIGINT) AS hops FROM p LEFT JOIN f ON f.start_id = p.start_id AND f.node = p.target""")
def relation_path(spark, sf):
    pairs = L.read(spark, sf, "customer").select(F.concat(F.lit("customer:"), L.s("c_custkey")).alias("start"), F.concat(F.lit("region:"), L.s(F.col("c_custkey") % 5)).alias("target"))
    return graph.shortest_paths(L.structured_edge(spark, sf), pairs, 6)


def _causal(spark, sf):
    """Consecutive events of a user within a day."""
    w = W.Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    rows = L.read(spark, sf, "events").select("event_id", "user_id", "ts").withColumn("parent", F.lag("event_id").over(w))
    return rows.where("parent is not null").select("parent", F.col("event_id").alias("child"))


_CAUSAL = "c AS (SELECT * FROM (SELECT lag(event_id) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS parent, event_id AS child FROM events) WHERE parent IS NOT NULL)"


@query("", f"WITH RECURSIVE {_CAUSAL}, r AS (SELECT event_id AS start_id, child AS node FROM events JOIN c ON parent = event_id WHERE event_type = 'signup' UNION SELECT r.start_id, c.child FROM r JOIN c ON c.parent = r.node) SELECT start_id AS start, node FROM r")
def causal_reachability(spark, sf):
    starts = L.read(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("node"))
    return graph.reachable(_causal(spark, sf), starts)


@query("", f"WITH RECURSIVE {_CAUSAL}, r AS (SELECT event_id AS node, 0 AS wave FROM events WHERE event_id NOT IN (SELECT child FROM c) UNION ALL SELECT c.child, r.wave + 1 FROM r JOIN c ON c.parent = r.node) SELECT node, CAST(max(wave) AS BIGINT) AS wave FROM r GROUP BY node")
def topo_waves(spark, sf):
    return graph.waves(L.read(spark, sf, "events").select(F.col("event_id").alias("node")), _causal(spark, sf))


@query("", "WITH e AS (SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS file FROM lineitem), g AS (SELECT item_id, lag(item_id) OVER (PARTITION BY file ORDER BY item_id) AS parent FROM e) SELECT DISTINCT parent, item_id AS child FROM g WHERE parent IS NOT NULL")
def file_dependency_edges(spark, sf):
    items = L.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set("l_suppkey").alias("files"))
    return graph.dependencies_by_file(items)


from quarry import queries_more  # noqa: E402, F401  registers its queries; it needs the names above
