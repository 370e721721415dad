"""The logical tables again, as DuckDB common table expressions, for the SQL that queries are compared with."""

from __future__ import annotations

CTE: dict[str, str] = {
    "se": """SELECT event_id, CAST(user_id AS VARCHAR) AS subject_id, event_type, ts AS occurred_from,
        user_id || ':' || event_type || ':' || json_extract_string(props, '$.k') AS dedupe_key,
        CASE event_id % 10 WHEN 0 THEN 'conflict' WHEN 1 THEN 'superseded' ELSE 'none' END AS conflict_status,
        CASE user_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'tenant' WHEN 2 THEN 'user_private' ELSE 'agent_private' END AS scope,
        't' || (user_id % 2) AS tenant_id,
        CASE user_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 't' || (user_id % 2) WHEN 2 THEN 'u' || (user_id % 3) ELSE 'a' || (user_id % 3) END AS owner_id, value
        FROM events""",
    "vis": """SELECT * FROM se WHERE (scope = 'public' OR tenant_id = 't1') AND (scope = 'public' OR (scope = 'tenant' AND owner_id = 't1')
        OR (scope = 'user_private' AND owner_id = 'u1') OR (scope = 'agent_private' AND owner_id = 'a1'))""",
    "mem": """SELECT doc_id AS memory_id, 't' || (doc_id % 2) AS tenant_id,
        CASE doc_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'tenant' WHEN 2 THEN 'agent_private' WHEN 3 THEN 'user_private' ELSE 'session' END AS scope,
        CASE doc_id % 5 WHEN 0 THEN 'system' WHEN 1 THEN 't' || (doc_id % 2) WHEN 2 THEN 'a' || (doc_id % 3) WHEN 3 THEN 'u' || (doc_id % 3) ELSE 's' || (doc_id % 3) END AS owner_id,
        source AS source_type, CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status, CAST(doc_id % 4 + 1 AS INTEGER) AS version, text, n_chars, lang AS kind,
        CASE WHEN doc_id % 3 = 0 THEN 'raw' ELSE 'curated' END AS stage, TIMESTAMP '1997-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS updated_at FROM documents""",
    "acl": """SELECT doc_id AS memory_id, 'role' AS principal_type, 'r1' AS principal_id, 'read' AS permission FROM documents WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id, 'user', 'u1', 'delete' FROM documents WHERE doc_id % 11 = 0
        UNION ALL SELECT doc_id, 'user', 'u2', 'read' FROM documents WHERE doc_id % 13 = 0""",
    "readable": """SELECT * FROM mem WHERE status = 'active' AND (scope = 'public' OR tenant_id = 't1') AND (scope = 'public' OR (scope = 'tenant' AND owner_id = 't1')
        OR (scope = 'user_private' AND owner_id = 'u1') OR (scope = 'agent_private' AND owner_id = 'a1')
        OR memory_id IN (SELECT memory_id FROM acl WHERE permission = 'read' AND ((principal_type = 'tenant' AND principal_id = 't1') OR (principal_type = 'user' AND principal_id = 'u1')
        OR (principal_type = 'agent' AND principal_id = 'a1') OR (principal_type = 'role' AND principal_id = 'r1'))))""",
    "ver": """SELECT i AS index_version_id, 't' || (i % 2) AS tenant_id, CASE WHEN i % 3 = 0 THEN 'other' ELSE 'memory.hybrid' END AS logical_name,
        CASE WHEN i = 9 THEN 'building' WHEN i % 4 = 3 THEN 'retired' ELSE 'active' END AS status FROM range(0, 10) t(i)""",
    "chunk": """SELECT doc_id AS chunk_id, doc_id AS memory_id, doc_id % 10 AS index_version_id, CASE WHEN doc_id % 9 = 0 THEN 'parent' ELSE 'child' END AS chunk_level, source AS source_type,
        text AS content, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "edge": """SELECT p || ':' || k AS source_node_id, pr AS predicate, q || ':' || t AS target_node_id, 'e.' || p || '.' || k AS edge_id,
        CAST(DATE '1994-01-01' + to_years(CAST(k % 5 AS INTEGER)) AS TIMESTAMP) AS valid_from, CASE WHEN k % 3 <> 0 THEN TIMESTAMP '1998-01-01' END AS valid_to,
        CASE WHEN k % 29 = 0 THEN 'conflict' ELSE 'none' END AS conflict_status, 't' || (k % 2) AS tenant_id,
        CASE WHEN k % 4 = 3 THEN 'user_private' ELSE 'public' END AS scope, 'u' || (k % 3) AS owner_id
        FROM (SELECT 'supplier' AS p, s_suppkey AS k, 'located_in' AS pr, 'nation' AS q, s_nationkey AS t FROM supplier
        UNION ALL SELECT 'customer', c_custkey, 'located_in', 'nation', c_nationkey FROM customer
        UNION ALL SELECT 'nation', n_nationkey, 'part_of', 'region', n_regionkey FROM nation)""",
    "inv": """SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey AS invocation_id, o_custkey AS run_id, l_orderkey AS task_id,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS agent_id, l_linestatus AS workload, l_returnflag AS provider,
        CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status, CAST(l_linenumber AS BIGINT) AS attempt, CAST(l_quantity AS BIGINT) AS total_tokens,
        CAST(floor(l_quantity / 2) AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS cost_microusd, l_extendedprice / 1000 AS cost_usd,
        CAST(l_partkey % 900 + 100 AS BIGINT) AS latency_ms, o_orderdate AS started_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "task": """SELECT o_orderkey AS task_id, o_custkey AS run_id, o_orderpriority AS subject, CASE o_orderkey % 4 WHEN 1 THEN 'leased' WHEN 2 THEN 'completed' ELSE 'pending' END AS status,
        o_orderdate AS available_at, o_orderdate + to_days(CAST(o_orderkey % 900 AS INTEGER)) AS deadline, o_orderkey % 5 AS attempt, CAST(3 AS BIGINT) AS max_attempts,
        CASE WHEN o_orderkey % 4 = 1 THEN TIMESTAMP '1998-01-01' + to_days(CAST(o_orderkey % 21 - 10 AS INTEGER)) END AS lease_expires_at, o_orderkey % 19 = 0 AS cancellation_requested,
        o_orderkey % 12 AS hop_count, 'f' || (o_orderkey % 40) AS task_fingerprint FROM orders""",
}
_NEEDS = {"vis": ("se",), "readable": ("mem", "acl")}


def sql(tables: str, body: str) -> str:
    """body with the named logical tables before it."""
    names: list[str] = []
    for t in tables.split():
        names += [n for n in (*_NEEDS.get(t, ()), t) if n not in names]
    body = body.strip()
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in names)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
