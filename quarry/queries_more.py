"""More registered queries: index versions, stores, gateway, evaluation, sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry import session
from quarry.functions import text as T
from quarry.functions import variants
from quarry.operators import chunking, evaluation, gateway, governance, index, ivf, ledger, lifecycle, metrics, retrieval, store, writes
from quarry.operators import visibility as vis
from quarry.plans import planner
from quarry.queries import _FOLD, _GRADED, _LEX, _PLAN, _RRF, _VEC, _WALK, ME, NOW, _acks, _chunks, _graded, _lexical_index, _lists, _requests, _text_queries, _vector_queries, _vectors, lexical_topk, query
from quarry.sources import documents, sink
from quarry.sources import logical as L
from quarry.streaming import jobs, leases

NAME = "memory.hybrid"
_VISIBLE = "SELECT c.* FROM chunk c JOIN ver v ON v.index_version_id = c.index_version_id JOIN readable r ON r.memory_id = c.memory_id WHERE c.chunk_level = 'child' AND v.status = 'active' AND v.logical_name = 'memory.hybrid' AND (r.scope = 'public' OR v.tenant_id = 't1')"


def _searchable(spark, sf, filters=None):
    return index.searchable(L.memory_chunk(spark, sf), L.memory_record(spark, sf), L.memory_acl(spark, sf), L.index_version(spark), ME, NAME, filters)


# --- index versions ---


@query("chunk readable ver", f"SELECT chunk_id, index_version_id FROM ({_VISIBLE})")
def index_searchable(spark, sf):
    return _searchable(spark, sf).select("chunk_id", "index_version_id")


@query("chunk readable ver", f"SELECT chunk_id FROM ({_VISIBLE} AND c.source_type = 'src1' AND r.kind = 'en' AND r.stage = 'curated')")
def index_filtered(spark, sf):
    return _searchable(spark, sf, {"source_type": "src1", "kind": "en", "stage": "curated"}).select("chunk_id")


@query("chunk readable ver", f"WITH dsub AS (SELECT chunk_id AS doc_id, content AS text FROM ({_VISIBLE})), {_LEX.replace('FROM documents', 'FROM dsub')} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lex")
def index_lexical(spark, sf):
    return _lexical_index(spark, sf).search(_text_queries(spark, sf), 10, allowed=_searchable(spark, sf).select("chunk_id"))


_OVER = f"""WITH {_VEC.format('').replace('QUALIFY rank <= 10', '')}, f AS (SELECT *, chunk_id IN (SELECT memory_id FROM readable) AS ok FROM vec),
    a(attempt, lim) AS (VALUES (1, 64), (2, 128), (3, 256), (4, 512)),
    s AS (SELECT query_id, attempt, lim, count(*) FILTER (rank <= lim AND ok) AS have, count(*) FILTER (rank <= lim) AS offered FROM f, a GROUP BY ALL),
    d AS (SELECT query_id, min(CASE WHEN attempt = 4 OR have >= 10 OR offered < lim THEN attempt END) AS attempt FROM s GROUP BY query_id)
    SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, CAST(d.attempt AS INTEGER) AS attempts FROM f JOIN d USING (query_id) JOIN a ON a.attempt = d.attempt WHERE ok AND f.rank <= lim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10"""


def _allowed(spark, sf):
    return vis.readable_memories(L.memory_record(spark, sf), L.memory_acl(spark, sf), ME).select(F.col("memory_id").alias("chunk_id"))


def _vector_index(spark, sf):
    """The stored index of the vectors, built once for these files."""
    build = lambda path: ivf.Stored.build(_vectors(spark, sf), path)
    return ivf.Stored.open(spark, session.stored(spark, "vectors-" + session.stamp(spark, f"{sf}/embeddings.parquet"), build))


@query("readable", _OVER)
def vector_topk_overfetch(spark, sf):
    """Over-fetch over the stored index, which goes on until no cell can hold a better vector."""
    stored = _vector_index(spark, sf)
    return index.overfetched(lambda q, limit, attempt: stored.search(q, limit, exact=True, half=False), _vector_queries(spark, sf), _allowed(spark, sf), 10)


@query()
def vector_topk_approximate(spark, sf):
    """The stored index over half-precision vectors; it widens its probes as the over-fetch widens its windows."""
    stored = _vector_index(spark, sf)
    return index.overfetched(lambda q, limit, attempt: stored.search(q, limit, ivf.PROBES * 2**attempt), _vector_queries(spark, sf), _allowed(spark, sf), 10)


@query()
def ann_fidelity(spark, sf):
    """Of each query: the stored index against the exact search, and the share of the vectors that it was compared with."""
    queries, vectors = _vector_queries(spark, sf), _vectors(spark, sf)
    return metrics.index_fidelity(_vector_index(spark, sf).search(queries, 10), retrieval.vector(vectors, queries, 10), vectors.count())


@query()
def ann_spearman(spark, sf):
    """The order that the stored index gives what it shares with the exact search."""
    queries = _vector_queries(spark, sf)
    return metrics.rank_correlation(retrieval.vector(_vectors(spark, sf), queries, 10), _vector_index(spark, sf).search(queries, 10))


@query("", "SELECT vec_id AS chunk_id, CAST(1 AS BIGINT) AS copies, TRUE AS away_holds FROM embeddings")
def index_layout(spark, sf):
    """Every vector lies once in the index, as far from its cell's centre as is written beside it."""
    stored = _vector_index(spark, sf)
    centres = spark.read.parquet(f"{stored.path}/centres").select("cell", "centre")
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * T.cosine(F.col("embedding"), F.col("centre"))))
    return stored.table(spark).join(F.broadcast(centres), "cell").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies"), F.bool_and(F.abs(apart - F.col("away")) < 1e-6).alias("away_holds"))


_BUILT = "b.vec_id % 10 = 9 AND b.vec_id IN (SELECT memory_id FROM readable) AND b.vec_id IN (SELECT chunk_id FROM chunk WHERE chunk_level = 'child')"


def _building(spark, sf, stage):
    cases = _text_queries(spark, sf).join(_vector_queries(spark, sf), "query_id")
    return index.evaluate(L.memory_chunk(spark, sf), L.memory_record(spark, sf), L.memory_acl(spark, sf), L.index_version(spark).where("status = 'building'"), ME, cases, stage)


@query("chunk readable", f"WITH {_VEC.format(f'WHERE {_BUILT} AND a.query_id IN (SELECT item_id FROM benchmark)')} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM vec")
def building_vector_evaluation(spark, sf):
    return _building(spark, sf, "vector")


@query("chunk readable", f"WITH dsub AS (SELECT chunk_id AS doc_id, content AS text FROM chunk WHERE index_version_id = 9 AND chunk_level = 'child' AND embedding IS NOT NULL AND memory_id IN (SELECT memory_id FROM readable)), {_LEX.replace('FROM documents', 'FROM dsub').replace('QUALIFY rank <= 10', '')}, {_VEC.format(f'WHERE {_BUILT} AND a.query_id IN (SELECT item_id FROM benchmark)').replace('QUALIFY rank <= 10', '')}, h AS (SELECT query_id, chunk_id, round(0.5 * sc.score + 0.5 * coalesce(lex.score, 0), 7) AS score FROM sc LEFT JOIN lex USING (query_id, chunk_id)) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 10")
def building_hybrid_evaluation(spark, sf):
    return _building(spark, sf, "hybrid")


@query("chunk", "SELECT index_version_id, count(DISTINCT memory_id) AS document_count, count(*) AS chunk_count FROM chunk GROUP BY 1")
def index_document_counts(spark, sf):
    return index.counts(L.memory_chunk(spark, sf))


@query("chunk", "SELECT index_version_id, count(*) FILTER (chunk_id % 15 = 0) AS degraded, CASE WHEN count(*) FILTER (chunk_id % 15 = 0) = 0 THEN 'allowed' ELSE 'activation_not_allowed' END AS verdict FROM chunk GROUP BY 1")
def degraded_index_policy(spark, sf):
    rows = L.memory_chunk(spark, sf).select("index_version_id", F.when(F.col("chunk_id") % 15 == 0, "degraded").alias("parser_mode"))
    return index.degraded_policy(rows, allow_build=True, auto_activate=True)


@query("", "SELECT c_custkey AS index_version_id, CASE c_custkey % 8 WHEN 0 THEN 'no_report' WHEN 1 THEN 'not_passed' WHEN 2 THEN 'identity' WHEN 3 THEN 'checks' WHEN 4 THEN 'checks' WHEN 5 THEN CASE WHEN c_acctbal < 0 THEN 'check_failed' END END AS reason FROM customer")
def index_activation_guard(spark, sf):
    """Reports with each fault by rule; a customer in debt stands for a check below its threshold."""
    k = F.col("c_custkey")
    names = F.when(k % 8 == 3, F.array(*map(F.lit, index.CHECKS[:-1]))).when(k % 8 == 4, F.array(*map(F.lit, (*index.CHECKS[:-1], index.CHECKS[0])))).otherwise(F.array(*map(F.lit, index.CHECKS)))
    low = (k % 8 == 5) & (F.col("c_acctbal") < 0)
    checks = F.transform(names, lambda n: F.struct(n.alias("name"), F.when(low & (n == "recall"), 0.1).otherwise(0.9).alias("score"), F.lit(0.5).alias("threshold"), F.lit(True).alias("passed")))
    report = F.struct((k % 8 != 1).alias("passed"), L.s(k).alias("build_id"), F.when(k % 8 == 2, k + 1).otherwise(k).alias("index_version_id"), F.lit("w").alias("source_watermark"), F.lit("c").alias("configuration_digest"), checks.alias("checks"))
    rows = L.read(spark, sf, "customer").select(k.alias("index_version_id"), L.s(k).alias("build_id"), F.lit("w").alias("source_watermark"), F.lit("c").alias("configuration_digest"), F.when(k % 8 != 0, report).alias("report"))
    return index.activation_guard(rows)


@query("", "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 25 = 1 THEN 'empty' WHEN vec_id % 25 = 2 THEN 'not_finite' ELSE 'norm' END AS error FROM embeddings WHERE vec_id % 25 IN (1, 2, 3)")
def vector_validity(spark, sf):
    k, v = F.col("vec_id") % 25, F.col("embedding")
    odd = F.when(k == 1, F.slice(v, 1, 0)).when(k == 2, F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float"))).when(k == 3, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v)
    return index.vector_errors(L.read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), odd.alias("embedding")))


_RULES = ("content", "source_type", "ordinal", "token_count", "chunk_digest", "citation_digest", "digest_of_content", "citation", "entity_keys", "parent", "own_parent", "structure_path", "model", "vector", "identity")


@query("", "WITH r(n, rule) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(_RULES)) + ") SELECT doc_id AS chunk_id, rule FROM documents JOIN r ON doc_id % 20 = n WHERE rule <> 'identity' UNION ALL SELECT NULL, 'identity' FROM documents WHERE doc_id % 20 = 14 UNION ALL SELECT doc_id, 'digest_of_content' FROM documents WHERE doc_id % 20 IN (0, 4) UNION ALL SELECT doc_id, 'vector' FROM documents WHERE FALSE")
def chunk_validity_all(spark, sf):
    """Chunks that break one rule each, by doc_id; a lost content or a malformed digest is no digest of the content either."""
    bad = lambda name, broken, fine: F.when(F.col("doc_id") % 20 == _RULES.index(name), broken).otherwise(fine)
    t, sha, vec = F.col("text"), T.digest(F.lit("x")), F.array(F.lit(1.0), F.lit(2.0))
    rows = L.read(spark, sf, "documents").select(
        "doc_id", bad("identity", F.lit(None), F.col("doc_id")).alias("chunk_id"), F.col("doc_id").alias("memory_id"), F.lit("v").alias("index_version_id"), bad("content", F.lit(" "), t).alias("content"), bad("source_type", F.lit(""), F.col("source")).alias("source_type"),
        bad("ordinal", F.lit(-1), F.lit(0)).alias("ordinal"), bad("token_count", F.lit(0), F.lit(5)).alias("token_count"), F.when(F.col("doc_id") % 20 == 4, "sha256:odd").when(F.col("doc_id") % 20 == 6, T.digest(F.lit("other"))).otherwise(T.digest(t)).alias("chunk_digest"),
        bad("citation_digest", F.lit("md5:1"), sha).alias("citation_digest"), F.lit("a").alias("citation_artifact_id"), bad("citation", F.lit("no uri"), F.lit("file:/x")).alias("citation_uri"), bad("entity_keys", F.array(F.lit("k"), F.lit("k")), F.array(F.lit("k"))).alias("entity_keys"),
        bad("parent", F.lit("parent"), F.lit("child")).alias("chunk_level"), F.when(F.col("doc_id") % 20 == 9, F.lit(-1)).when(F.col("doc_id") % 20 == 10, F.col("doc_id")).alias("parent_chunk_id"), bad("structure_path", F.array(F.lit("a"), F.lit(" ")), F.array(F.lit("a"))).alias("structure_path"),
        F.when(F.col("doc_id") % 20 == 13, F.array(F.lit(0.0), F.lit(0.0))).when(F.col("doc_id") % 20 != 9, vec).alias("embedding"), F.when((F.col("doc_id") % 20 != 12) & (F.col("doc_id") % 20 != 9), "m").alias("embedding_model"),
    )
    return lifecycle.broken(rows, "chunk_id", index.chunk_rules())


@query("", "SELECT doc_id AS chunk_id, CASE doc_id % 10 WHEN 1 THEN 'content' WHEN 2 THEN 'score' WHEN 3 THEN 'score' WHEN 4 THEN 'token_count' ELSE 'digest' END AS error FROM documents WHERE doc_id % 10 IN (1, 2, 3, 4, 5)")
def hit_validity(spark, sf):
    k = F.col("doc_id") % 10
    rows = L.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(k != 1, F.col("text")).alias("content"), F.when(k == 2, float("nan")).when(k == 3, -0.5).otherwise(0.5).alias("score"), F.when(k == 4, 0).otherwise(7).alias("token_count"), F.when(k == 5, "sha256:x").otherwise(T.digest(F.col("text"))).alias("digest"))
    return index.hit_errors(rows)


# --- stores ---


@query("mem", "SELECT memory_id, 'new' AS what FROM mem WHERE memory_id % 3 = 0 UNION ALL SELECT memory_id, 'conflict' FROM mem WHERE memory_id % 3 <> 0 AND (memory_id % 4 = 0 OR memory_id % 10 = 1)")
def memory_capture(spark, sf):
    rows = L.memory_record(spark, sf).select("memory_id", "tenant_id", "scope", "owner_id", F.md5("text").alias("content_digest"))
    k = F.col("memory_id")
    incoming = rows.withColumns({"content_digest": F.when(k % 4 == 0, "other").otherwise(F.col("content_digest")), "owner_id": F.when(k % 10 == 1, "nobody").otherwise(F.col("owner_id"))})
    new, conflicts = store.capture(rows.where("memory_id % 3 <> 0"), incoming)
    return new.select("memory_id", F.lit("new").alias("what")).unionByName(conflicts.select("memory_id", F.lit("conflict").alias("what")))


def _chunk_rows(spark, sf):
    """A chunk for each document; four in five have the first of their five as parent, all of one memory."""
    d = F.col("doc_id")
    return L.read(spark, sf, "documents").select(d.alias("chunk_id"), F.expr("doc_id div 5").alias("memory_id"), F.lit(1).cast("long").alias("index_version_id"), F.when(d % 5 > 0, d - d % 5).alias("parent_chunk_id"), F.col("text").alias("content"), T.digest(F.coalesce("text", F.lit(""))).alias("chunk_digest"))


def _facts(spark, sf):
    return L.read(spark, sf, "events").select(F.array(F.col("event_id") % 300, F.col("user_id")).alias("source_memory_ids"))


def _store(spark, sf):
    """A store with two batches of chunks, one of them written again, one refused, one lost on the way, and a deletion."""

    def build(path):
        rows, gone = _chunk_rows(spark, sf), L.read(spark, sf, "labels").where("quality = 0").select(F.expr("doc_id div 5").alias("memory_id"))
        writes.put_chunks(path, "even", rows.where("memory_id % 2 = 0"))
        writes.put_chunks(path, "even", rows)
        for batch in (rows.withColumn("chunk_digest", F.lit("other")), rows.where("chunk_id % 5 > 0 and memory_id % 2 = 1")):
            try:
                writes.put_chunks(path, "odd", batch)
            except writes.Refused:
                pass  # that is what is to happen
        writes.put_chunks(path, "odd", rows)
        writes.delete_memories(path, "deletion", gone, _facts(spark, sf), "d")

    return session.stored(spark, "chunks-" + session.stamp(spark, *(f"{sf}/{t}.parquet" for t in ("documents", "labels", "events"))), build)


_GONE = "gone AS (SELECT DISTINCT doc_id // 5 AS memory_id FROM labels WHERE quality = 0)"


@query("", f"WITH {_GONE} SELECT doc_id AS chunk_id, doc_id // 5 AS memory_id, CASE WHEN doc_id % 5 > 0 THEN doc_id - doc_id % 5 END AS parent_chunk_id, 'sha256:' || sha256(coalesce(text, '')) AS chunk_digest FROM documents WHERE doc_id // 5 NOT IN (FROM gone)")
def chunk_store(spark, sf):
    """What is read of the store: each chunk once, those of deleted memories not."""
    return writes.chunks(spark, _store(spark, sf)).select("chunk_id", "memory_id", "parent_chunk_id", "chunk_digest")


@query("", f"WITH {_GONE}, c AS (SELECT doc_id // 5 AS memory_id, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT memory_id, count(*) AS n FROM (SELECT event_id % 300 AS memory_id FROM events UNION ALL SELECT user_id FROM events WHERE user_id <> event_id % 300) GROUP BY 1) SELECT 'd.' || memory_id AS deletion_id, memory_id, coalesce(c.n, 0) AS chunks, coalesce(f.n, 0) AS facts, CAST(3 AS BIGINT) AS pending FROM gone LEFT JOIN c USING (memory_id) LEFT JOIN f USING (memory_id)")
def deletion_store(spark, sf):
    """Receipts of the deletion, with the targets that it has still to reach."""
    path = _store(spark, sf)
    pending = sink.read(spark, path, "deletion_targets").where("status = 'pending'").groupBy("deletion_id").agg(F.count(F.lit(1)).alias("pending"))
    return sink.read(spark, path, "receipts").drop("_batch").join(pending, "deletion_id", "left")


@query("inv", "SELECT run_id, count(*) AS model_calls, CAST(sum(total_tokens) AS BIGINT) AS tokens_used, CAST(sum(CAST(round(cost_usd * 1000000) AS BIGINT)) AS BIGINT) AS ledger_cost, CAST(sum(CAST(ceil(cost_usd * 1000000) AS BIGINT)) AS BIGINT) AS budget_cost FROM (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY invocation_id, provider, total_tokens, cost_usd) = 1) GROUP BY run_id")
def budget_store(spark, sf):
    """Budgets as the ledger's batches added to them, one batch for each kind of call, one of them twice."""

    def build(path):
        calls = L.model_invocation(spark, sf).withColumn("invocation_id", F.concat_ws("/", "invocation_id", "provider", L.s("total_tokens"), L.s("cost_usd")))
        with session.sparing(spark):
            for provider in ("A", "N", "R", "N"):
                writes.put_invocations(path, provider, calls.where(F.col("provider") == provider))
            writes.put_invocations(path, "again", calls)

    path = session.stored(spark, "ledger-" + session.stamp(spark, *(f"{sf}/{t}.parquet" for t in ("lineitem", "orders"))), build)
    return writes.budgets(spark, path)


@query("", f"WITH {_LEX} SELECT query_id, '{{\"query_id\":' || query_id || ',\"returned\":' || count(*) || ',\"hits\":[' || string_agg('{{\"rank\":' || rank || ',\"chunk_id\":' || chunk_id || ',\"score\":' || CAST(round(score * 1000000) AS BIGINT) || '}}', ',' ORDER BY rank) || '],\"trace\":{{\"retriever\":\"lexical\"}}}}' AS body FROM lex GROUP BY query_id")
def response_store(spark, sf):
    """The answers of a batch of requests, written as documents and read back; scores in millionths."""

    def build(path):
        writes.put_responses(path, "lexical", lexical_topk(spark, sf).withColumn("score", F.round(F.col("score") * 1_000_000).cast("long")), {"retriever": "lexical"})

    path = session.stored(spark, "responses-" + session.stamp(spark, *(f"{sf}/{t}.parquet" for t in ("documents", "benchmark"))), build)
    return sink.read(spark, path, "responses").drop("_batch")


@query("acl", "SELECT memory_id, principal_type, principal_id, permission FROM acl WHERE memory_id % 2 = 0")
def acl_grants(spark, sf):
    """Every grant comes twice; those of odd memories are there already."""
    acl = L.memory_acl(spark, sf)
    return store.grant(acl.where("memory_id % 2 = 1"), acl.unionByName(acl))


_ART = "a AS (SELECT CAST(p_partkey AS BIGINT) AS artifact_id, p_partkey // 2 AS pair FROM part)"


def _artifacts(spark, sf):
    """Two of a pair hold the same content."""
    k = F.col("p_partkey").cast("long")
    pair = F.expr("p_partkey div 2")
    return L.read(spark, sf, "part").select(k.alias("artifact_id"), F.md5(L.s(pair)).alias("digest"), F.concat(F.lit("part:"), L.s(k)).alias("uri"), F.when(pair % 3 == 0, "public").otherwise("private").alias("scope"), F.concat(F.lit("u"), L.s(pair % 5)).alias("owner_id"), F.when(k > 1, F.array(k - 1, F.expr("p_partkey div 10").cast("long"), k - 1)).otherwise(F.array().cast("array<long>")).alias("lineage_ids"))


_STORED = f"{_ART}, st AS (SELECT * FROM a WHERE artifact_id % 7 = 0), n AS (SELECT a.artifact_id, min(st.artifact_id) AS known, (SELECT min(b.artifact_id) FROM a b WHERE b.pair = a.pair AND b.artifact_id % 7 <> 0) AS first FROM a LEFT JOIN st ON st.pair = a.pair WHERE a.artifact_id % 7 <> 0 GROUP BY a.artifact_id, a.pair)"


@query("", f"WITH {_STORED} SELECT artifact_id, 'new' AS reason, artifact_id AS existing_id FROM n WHERE known IS NULL AND first = artifact_id UNION ALL SELECT artifact_id, 'digest', coalesce(known, first) FROM n WHERE known IS NOT NULL OR first <> artifact_id UNION ALL SELECT artifact_id, 'identity', artifact_id FROM st WHERE artifact_id % 21 = 0")
def artifact_store(spark, sf):
    rows = _artifacts(spark, sf)
    incoming = rows.withColumn("uri", F.when(F.col("artifact_id") % 21 == 0, "moved").otherwise(F.col("uri")))
    new, _, conflicts = store.store_artifacts(rows.where("artifact_id % 7 = 0"), incoming)
    return new.select("artifact_id", F.lit("new").alias("reason"), F.col("artifact_id").alias("existing_id")).unionByName(conflicts)


@query("", f"WITH {_STORED} SELECT DISTINCT artifact_id, unnest([artifact_id - 1, artifact_id // 10]) AS source_artifact_id, 'derived_from' AS relation FROM n WHERE known IS NULL AND first = artifact_id AND artifact_id > 1")
def artifact_lineage(spark, sf):
    rows = _artifacts(spark, sf)
    return store.store_artifacts(rows.where("artifact_id % 7 = 0"), rows)[1]


@query("", f"WITH {_ART} SELECT artifact_id FROM a WHERE pair % 3 = 0 OR pair % 5 = 1 OR artifact_id % 11 = 0")
def readable_artifacts(spark, sf):
    rows = _artifacts(spark, sf)
    acl = rows.where("artifact_id % 11 = 0").select("artifact_id", F.lit("user").alias("principal_type"), F.lit("u1").alias("principal_id"), F.lit("read").alias("permission"))
    return store.readable_artifacts(rows, acl, "user", "u1").select("artifact_id")


@query("readable", "SELECT memory_id, updated_at FROM readable ORDER BY updated_at DESC, memory_id LIMIT 100")
def list_readable_memories(spark, sf):
    return store.list_readable(L.memory_record(spark, sf), L.memory_acl(spark, sf), ME).select("memory_id", "updated_at")


@query("edge", "SELECT edge_id, source_node_id, predicate, target_node_id FROM edge WHERE scope = 'public' OR (tenant_id = 't1' AND scope = 'user_private' AND owner_id = 'u1') ORDER BY source_node_id, predicate, target_node_id, edge_id LIMIT 20001")
def list_readable_edges(spark, sf):
    return store.list_edges(L.structured_edge(spark, sf), ME).select("edge_id", "source_node_id", "predicate", "target_node_id")


@query("", "SELECT o_orderkey AS cycle_id, o_orderdate AS recorded_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def maintenance_cycles(spark, sf):
    rows = L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("cycle_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("recorded_at"))
    return store.newest(rows, "recorded_at", "cycle_id", 50, F.col("kind") == "1-URGENT").select("cycle_id", "recorded_at")


@query("task", "SELECT task_id, 'w1' AS lease_owner, TIMESTAMP '1998-01-01 00:05:00' AS lease_expires_at, attempt + 1 AS attempt FROM task WHERE available_at <= TIMESTAMP '1998-01-01' AND deadline > TIMESTAMP '1998-01-01' AND NOT cancellation_requested AND attempt < max_attempts AND (status = 'pending' OR (status = 'leased' AND lease_expires_at <= TIMESTAMP '1998-01-01')) ORDER BY available_at, task_id LIMIT 50")
def lease_claim(spark, sf):
    from quarry.operators import governance

    return store.claim(governance.claimable(L.workflow_task(spark, sf), NOW), "task_id", F.lit(True), ["available_at"], "w1", NOW, 300, 50)


_LEASES = """WITH RECURSIVE e AS (SELECT user_id AS task_id, event_id AS seq, epoch_us(ts) AS t, event_type AS ev, 'w' || (event_id % 2) AS worker, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, '' AS owner, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS attempt, CAST(NULL AS VARCHAR) AS checkpoint, FALSE AS ok FROM e
    UNION ALL SELECT task_id, n, CASE WHEN NOT ok THEN now_ WHEN ev = 'view' THEN 'leased' WHEN ev = 'purchase' THEN 'completed' WHEN ev = 'error' THEN CASE WHEN attempt >= 3 THEN 'failed' ELSE 'pending' END ELSE now_ END,
        CASE WHEN ok AND ev = 'view' THEN worker ELSE owner END, CASE WHEN ok AND ev IN ('view', 'click') THEN t + 43200000000 ELSE until END, attempt + CASE WHEN ok AND ev = 'view' THEN 1 ELSE 0 END, CASE WHEN ok AND ev = 'signup' THEN props ELSE checkpoint END, ok
        FROM (SELECT *, CASE WHEN ev = 'view' THEN now_ = 'pending' AND attempt < 3 ELSE now_ = 'leased' AND owner = worker END AS ok
            FROM (SELECT w.task_id, e.n, e.t, e.ev, e.worker, e.props, w.owner, w.until, w.attempt, w.checkpoint, CASE WHEN w.status = 'leased' AND w.until <= e.t THEN CASE WHEN w.attempt >= 3 THEN 'failed' ELSE 'pending' END ELSE w.status END AS now_ FROM w JOIN e ON e.task_id = w.task_id AND e.n = w.n + 1)))
    SELECT task_id, arg_max(status, n) AS status, max(attempt) AS attempt, arg_max(coalesce(checkpoint, ''), n) AS checkpoint, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused FROM w WHERE n > 0 GROUP BY task_id"""


@query("", _LEASES)
def lease_states(spark, sf):
    """Every user's events, read as one task's, as a stream over keyed state; each task as its last event left it."""
    kind = F.create_map(*(F.lit(x) for pair in (("view", "claim"), ("click", "heartbeat"), ("signup", "checkpoint"), ("purchase", "complete"), ("error", "fail")) for x in pair))

    def build(path):
        events = jobs.parquet_stream(spark, f"{sf}/events.parquet", files=1 << 20)
        rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind[F.col("event_type")].alias("event"), F.concat(F.lit("w"), L.s(F.col("event_id") % 2)).alias("worker"), F.lit(12 * 3600).alias("lease_seconds"), F.col("props").alias("payload"))
        leases.run(leases.transitions(rows), f"{path}/rows", f"{path}/state").awaitTermination()

    told = leases.table(spark, session.stored(spark, "leases-" + session.stamp(spark, f"{sf}/events.parquet"), build) + "/rows").where("seq is not null")
    last = lambda c: F.max_by(c, F.struct("at", "seq")).alias(c)
    return told.groupBy(F.col("key").alias("task_id")).agg(last("status"), F.max("attempt").alias("attempt"), F.coalesce(F.max_by("checkpoint", F.struct("at", "seq")), F.lit("")).alias("checkpoint"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


_STALE = f"{_FOLD}, t AS (SELECT deletion_id, target, status, attempt, TIMESTAMP '1997-01-01' + to_days(CAST(deletion_id % 700 AS INTEGER)) AS updated_at FROM fold), s AS (SELECT * FROM t WHERE status = 'failed' AND updated_at <= TIMESTAMP '1998-01-01' ORDER BY updated_at, deletion_id, target LIMIT 100)"


def _reconciled(spark, sf):
    rows = lifecycle.fold_acknowledgements(_acks(spark, sf)).withColumn("updated_at", F.timestamp_add("DAY", (F.col("deletion_id") % 700).cast("int"), F.lit("1997-01-01").cast("timestamp_ntz")))
    receipts = rows.select("deletion_id").distinct().select("deletion_id", (F.col("deletion_id") % 200).alias("memory_id"), F.lit("t1").alias("tenant_id"))
    memories = spark.range(200).select(F.col("id").alias("memory_id"), F.md5(L.s("id")).alias("content_digest"))
    return store.reconcile(rows, receipts, memories, NOW)


@query("", f"WITH {_STALE} SELECT 'event.memory-deletion-retry.' || deletion_id || '.' || target || '.' || (attempt + 1) AS event_id, deletion_id % 200 AS memory_id, md5(CAST(deletion_id % 200 AS VARCHAR)) AS content_digest FROM s")
def deletion_reconciliation(spark, sf):
    return _reconciled(spark, sf)[0].select("event_id", "memory_id", "content_digest")


@query("", f"WITH {_STALE} SELECT deletion_id, CASE WHEN bool_or(t.status = 'failed' AND s.target IS NULL) THEN 'failed' ELSE 'pending' END AS propagation_status FROM t LEFT JOIN s USING (deletion_id, target) WHERE deletion_id IN (SELECT deletion_id FROM s) GROUP BY deletion_id")
def deletion_reconciled_status(spark, sf):
    return _reconciled(spark, sf)[1]


# --- gateway ---


def _readable(spark, sf):
    return vis.readable_memories(L.memory_record(spark, sf), L.memory_acl(spark, sf), ME)


def _memory_of(spark, sf):
    return L.memory_record(spark, sf).select("memory_id", F.col("memory_id").alias("chunk_id"))


def _lookup_plans(spark, sf):
    """Every benchmark item is a fact lookup; its plan gives the windows."""
    asked = _text_queries(spark, sf).select("query_id", F.lit("fact_lookup").alias("intent"), F.lit("learning-director").alias("agent_id"), F.lit(1).cast("long").alias("entity_count"), F.lit(4000).cast("long").alias("token_budget"), F.lit(300).cast("long").alias("chunk_tokens"))
    return planner.plan(asked)


_FUNNEL = f"{_RRF}, fz AS (SELECT * FROM rrf WHERE position <= 12 AND query_id IN (SELECT item_id FROM benchmark)), au AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM fz WHERE chunk_id IN (SELECT memory_id FROM readable))"


def _funnel(spark, sf):
    """Fused lists cut to 12, authorised, cut to each plan's context_k."""
    fused = retrieval.fuse(_lists(spark, sf)).join(retrieval.small(_text_queries(spark, sf).select("query_id")), "query_id", "left_semi").where("position <= 12")
    kept, counts = gateway.authorise(fused, _readable(spark, sf), _memory_of(spark, sf))
    return gateway.windows(kept, _lookup_plans(spark, sf), "context_k"), counts


@query("readable", f"WITH {_FUNNEL} SELECT query_id, (SELECT count(*) FROM fz WHERE fz.query_id = b.item_id) AS fused, (SELECT count(*) FROM au WHERE au.query_id = b.item_id) AS authorized, (SELECT count(*) FROM fz WHERE fz.query_id = b.item_id) - (SELECT count(*) FROM au WHERE au.query_id = b.item_id) AS denied FROM benchmark b JOIN (SELECT DISTINCT query_id FROM fz) ON query_id = item_id")
def gateway_funnel(spark, sf):
    return _funnel(spark, sf)[1]


@query("readable", f"WITH {_FUNNEL}, picked AS (SELECT item_id AS query_id, least(9, (SELECT count(*) FROM au WHERE au.query_id = item_id)) AS selected FROM benchmark) SELECT query_id, selected, round(least(1.0, selected / 2), 6) AS coverage, CASE WHEN selected >= 2 THEN 'sufficient' ELSE 'insufficient' END AS status, selected >= 2 AS generation_allowed FROM picked")
def gateway_sufficiency(spark, sf):
    plans = _lookup_plans(spark, sf).withColumn("structured_required", F.lit(False))
    return gateway.sufficiency(_funnel(spark, sf)[0], plans)


_ANSWERS = f"""WITH RECURSIVE {_PLAN}, {_LEX.replace('QUALIFY rank <= 10', 'QUALIFY rank <= 100')}, {_VEC.format('').replace('QUALIFY rank <= 10', 'QUALIFY rank <= 100')},
    lists AS (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM vec), fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, count(*) AS agreement, min(rank) AS best_rank FROM lists JOIN plan USING (query_id) WHERE rank <= candidate_k GROUP BY ALL),
    rrf AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, agreement DESC, best_rank, chunk_id) AS position FROM (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM fu)),
    fz AS (SELECT rrf.* FROM rrf JOIN plan USING (query_id) WHERE position <= fusion_k), au AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM fz WHERE chunk_id IN (SELECT memory_id FROM readable)),
    cand AS (SELECT query_id, chunk_id, score, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tok, source, lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM au JOIN plan USING (query_id) JOIN documents ON doc_id = chunk_id WHERE place <= rerank_k),
    {_WALK}
    SELECT query_id, (SELECT count(*) FROM fz WHERE fz.query_id = plan.query_id) AS fused, (SELECT count(*) FROM au WHERE au.query_id = plan.query_id) AS authorized, (SELECT count(*) FROM fz WHERE fz.query_id = plan.query_id) - (SELECT count(*) FROM au WHERE au.query_id = plan.query_id) AS denied,
        (SELECT count(*) FROM walk WHERE walk.query_id = plan.query_id AND took) AS selected, CASE WHEN EXISTS (SELECT 1 FROM walk WHERE walk.query_id = plan.query_id AND took) THEN stopped_by END AS stopped_by FROM plan LEFT JOIN ended USING (query_id)"""


@query("readable", _ANSWERS)
def gateway_answers(spark, sf):
    """Every query through the whole gateway: both retrievers, each to its plan's windows, fusion, authorisation and evidence. If one of the two fails, so does the query."""
    from quarry import ports

    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), T.token_estimate(F.col("text")).alias("token_count"), F.col("source").alias("source_type"), F.array("lang").alias("entity_keys"))
    near = lambda q: retrieval.vector(_vectors(spark, sf), q.join(_vector_queries(spark, sf), "query_id"), "candidate_k")
    words = lambda q: _lexical_index(spark, sf).search(q, "candidate_k")
    allowed = lambda hits: retrieval.authorised(hits, _readable(spark, sf), _memory_of(spark, sf)).drop("memory_id")
    packs = ports.Gateway({"lexical": words, "vector": near}, allowed, docs, strict_retrieval=True).answer(_requests(spark, sf))[1]
    return packs.select("query_id", "fused", "authorized", "denied", "selected", "stopped_by")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"


@query("", f"WITH {_LEX}, o AS (SELECT query_id, chunk_id, round(len(list_intersect({_WORDS.format('b.text')}, {_WORDS.format('d.text')})) / len({_WORDS.format('b.text')}), 9) AS score FROM lex JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS position FROM o")
def reranked_window(spark, sf):
    """Lexical lists in the order of the words they share with the query."""
    rows = lexical_topk(spark, sf).withColumnRenamed("rank", "position").join(_chunks(spark, sf), "chunk_id").join(retrieval.small(_text_queries(spark, sf)), "query_id")
    return gateway.rerank(rows, gateway.word_overlap).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "position")


@query("", f"WITH {_LEX}, r(retriever, failed) AS (VALUES ('lexical', FALSE), ('broken', TRUE)) SELECT item_id AS query_id, retriever, (SELECT count(*) FROM lex WHERE lex.query_id = item_id AND rank <= 5 AND NOT failed) AS returned, failed FROM benchmark, r")
def retriever_trace(spark, sf):
    """One retriever of two fails: the other's lists, from the stored index, stand, and the trace says so."""
    def broken(_):
        raise RuntimeError("no such index")

    return gateway.fan_out(_text_queries(spark, sf), {"lexical": lambda q: _lexical_index(spark, sf).search(q, 10), "broken": broken}, 5).trace


# --- evaluation ---

_RUNS = "runs AS (SELECT o_orderpriority AS scenario, o_orderkey AS query_id, 1.0::DOUBLE / (1 + o_orderkey % 7) AS reciprocal_rank, (o_orderkey % 11) / 11.0::DOUBLE AS average_precision, o_orderkey % 9 AS returned, (o_orderkey % 5) / 4.0::DOUBLE AS coverage, CASE WHEN o_orderkey % 3 = 0 THEN 'insufficient' ELSE 'sufficient' END AS status, o_orderkey % 30 AS fused, o_orderkey % 20 AS authorized, o_orderkey % 10 AS denied, o_orderkey % 9 AS selected, CASE o_orderkey % 4 WHEN 0 THEN 'score_floor' WHEN 1 THEN 'context_k' WHEN 2 THEN 'token_budget' END AS stop_reason FROM orders)"


def _runs(spark, sf):
    k = F.col("o_orderkey")
    stop = F.when(k % 4 == 0, "score_floor").when(k % 4 == 1, "context_k").when(k % 4 == 2, "token_budget")
    return L.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), k.alias("query_id"), (1 / (1 + k % 7)).alias("reciprocal_rank"), (k % 11 / 11).alias("average_precision"), (k % 9).alias("returned"), (k % 5 / 4).alias("coverage"), F.when(k % 3 == 0, "insufficient").otherwise("sufficient").alias("status"), (k % 30).alias("fused"), (k % 20).alias("authorized"), (k % 10).alias("denied"), (k % 9).alias("selected"), stop.alias("stop_reason"))


@query("", f"WITH {_RUNS} SELECT scenario, count(*) AS queries, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, round(avg(returned), 6) AS mean_returned, round(avg(coverage), 6) AS mean_coverage, count(*) FILTER (status = 'insufficient') AS insufficient_queries, count(*) FILTER (returned = 0) AS empty_queries, round(avg(fused), 6) AS mean_fused, round(avg(authorized), 6) AS mean_authorized, round(avg(denied), 6) AS mean_denied, round(avg(selected), 6) AS mean_selected FROM runs GROUP BY scenario")
def scenario_rollup(spark, sf):
    return evaluation.scenario_rollup(_runs(spark, sf))


@query("", f"WITH {_RUNS} SELECT scenario, coalesce(stop_reason, 'unknown') AS stop_reason, count(*) AS n FROM runs GROUP BY ALL")
def stop_reason_histogram(spark, sf):
    return evaluation.histogram(_runs(spark, sf), ["scenario"], "stop_reason")


_ANSWERS = "answers AS (SELECT o_orderpriority AS scenario, o_orderkey AS query_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 5 + 1 END AS faithfulness, o_orderkey % 4 + 1 AS relevance, o_orderkey % 3 + 2 AS completeness, (o_orderkey % 8) / 8.0::DOUBLE AS citation_precision, o_orderkey % 12 AS evidence, o_orderkey % 900 AS answer_chars, o_orderkey % 2000 AS input_tokens, o_orderkey % 300 AS output_tokens FROM orders)"


def _answers(spark, sf):
    k = F.col("o_orderkey")
    return L.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), k.alias("query_id"), F.when(k % 6 != 0, k % 5 + 1).alias("faithfulness"), (k % 4 + 1).alias("relevance"), (k % 3 + 2).alias("completeness"), (k % 8 / 8).alias("citation_precision"), (k % 12).alias("evidence"), (k % 900).alias("answer_chars"), (k % 2000).alias("input_tokens"), (k % 300).alias("output_tokens"))


@query("", f"WITH {_ANSWERS} SELECT scenario, count(*) AS queries, count(faithfulness) AS judged, {', '.join(f'round(avg({c}) FILTER (faithfulness IS NOT NULL), 3) AS mean_{c}' for c in (*evaluation.SCORES, 'citation_precision', 'evidence', 'answer_chars'))}, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM answers GROUP BY scenario")
def answer_quality(spark, sf):
    return evaluation.answer_quality(_answers(spark, sf))


@query("", f"WITH {_ANSWERS} SELECT scenario, measure, score, count(*) AS n FROM (SELECT scenario, unnest(['faithfulness', 'relevance', 'completeness']) AS measure, unnest([faithfulness, relevance, completeness]) AS score FROM answers WHERE faithfulness IS NOT NULL) GROUP BY ALL")
def judge_score_distribution(spark, sf):
    return evaluation.score_distribution(_answers(spark, sf))


@query("", f"WITH {_GRADED}, k AS (SELECT query_id, rank, CASE WHEN rank % 4 <> 0 THEN grade END AS grade FROM g) SELECT query_id, round(count(*) FILTER (coalesce(grade, 0) >= 2) / count(*), 6) AS citation_precision FROM k GROUP BY query_id")
def citation_precision(spark, sf):
    rows = _graded(spark, sf).withColumnRenamed("rank", "chunk_id")
    return evaluation.citation_precision(rows.select("query_id", "chunk_id"), rows.where("chunk_id % 4 <> 0"))


@query("", "SELECT source AS topic, count(*) AS relevant FROM documents WHERE lang <> 'fr' GROUP BY source")
def relevant_counts(spark, sf):
    keys = F.when(F.col("lang") != "fr", F.array(F.concat(F.lit("lang."), "lang"), F.concat(F.lit("topic."), "source"), F.lit("topic.second"))).otherwise(F.array(F.lit("lang.fr")))
    return evaluation.relevant_counts(L.read(spark, sf, "documents").select(keys.alias("entity_keys")))


@query("", "SELECT *, substr(sha256(doc_id), 1, 16) AS digest FROM (SELECT topic || ':' || facet || ':' || level || ':' || copy AS doc_id, topic, facet, level, copy, CAST(CASE WHEN p_size > 40 THEN 0 WHEN level = 0 THEN 3 WHEN level = 1 THEN 2 ELSE 1 END AS BIGINT) AS grade, p_size > 40 AS distractor FROM (SELECT p_partkey AS topic, p_size FROM part) a, range(0, 4) b(facet), range(0, 3) c(level), range(0, 4) d(copy) WHERE copy < [1, 2, 4][topic % 3 + 1])")
def labelled_corpus(spark, sf):
    """Parts are the topics, the large ones distractors."""
    return evaluation.labelled_corpus(spark, of=L.read(spark, sf, "part").select(F.col("p_partkey").alias("topic"), (F.col("p_size") > 40).alias("distractor")))


@query("", "SELECT n_nationkey AS id, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS digest FROM nation")
def canonical_json_digest(spark, sf):
    return L.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.sha2(evaluation.canonical_struct(["n_regionkey", "n_name", "n_nationkey"]), 256).alias("digest"))


_ROUTES = (("cheap", 1, 400, 64, 0.1, 0.4), ("middle", 2, 4000, 512, 1.0, 4.0), ("large", 3, 64000, 4096, 10.0, 40.0))


@query("", "WITH r(route, priority, w, o, ic, oc) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d}, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in _ROUTES) + "), q AS (SELECT doc_id AS request_id, 1 + greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS i, 100 + doc_id % 700 AS mo, 200 + doc_id % 5000 AS mt, (doc_id % 100) / 2000.0::DOUBLE AS mc FROM documents), f AS (SELECT request_id, route, priority, least(mo, o, w - i, mt - i) AS ot, (i * ic + least(mo, o, w - i, mt - i) * oc) / 1000000 AS cost, mc FROM q, r), b AS (SELECT * FROM f WHERE ot > 0 AND cost <= mc QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY priority) = 1) SELECT doc_id AS request_id, route, CAST(ot AS BIGINT) AS output_tokens, round(cost, 9) AS estimated_cost FROM documents LEFT JOIN b ON request_id = doc_id")
def route_admission(spark, sf):
    k = F.col("doc_id")
    requests = L.read(spark, sf, "documents").select(k.alias("request_id"), F.lit("sys").alias("system_prompt"), F.col("text").alias("user_prompt"), (100 + k % 700).alias("max_output_tokens"), (200 + k % 5000).alias("max_tokens"), (k % 100 / 2000).alias("max_cost"))
    routes = spark.createDataFrame(_ROUTES, "route string, priority int, context_window long, max_output long, input_cost double, output_cost double")
    return evaluation.admitted_routes(requests, routes)


@query("", "SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'seckill') THEN 'seckill' WHEN contains(lower(p_name), 'order') THEN 'order' WHEN contains(lower(p_name), 'pay') THEN 'pay' ELSE 'general' END AS domain, CASE WHEN p_partkey % 5 = 0 THEN 'spec' WHEN p_partkey % 7 = 0 THEN 'defect_case' ELSE 'implementation' END AS type FROM part")
def name_guess(spark, sf):
    k = F.col("p_partkey")
    name = F.concat_ws("_", F.regexp_replace("p_name", "(?i)spec|case", ""), F.when(k % 5 == 0, "Spec"), F.when(k % 7 == 0, "案例"))
    return L.read(spark, sf, "part").select(k.alias("id"), evaluation.guess(F.col("p_name"), evaluation.DOMAINS, "general").alias("domain"), evaluation.guess(name, evaluation.TYPES, "implementation").alias("type"))


@query("", "SELECT conv_id AS memory_id, CAST(min(turn * 1000) FILTER (turn > 0) AS BIGINT) AS media_start_ms, CAST(max(turn * 1000 + 900) AS BIGINT) AS media_end_ms, min((turn % 5) / 5.0::DOUBLE) AS confidence, CASE WHEN count(DISTINCT role) = 1 THEN max(role) END AS language FROM conversations GROUP BY conv_id")
def conversation_metadata(spark, sf):
    t = F.col("turn").cast("long")
    return evaluation.evidence_metadata(L.read(spark, sf, "conversations").select(F.col("conv_id").alias("memory_id"), F.when(t > 0, t * 1000).alias("start_ms"), (t * 1000 + 900).alias("end_ms"), (t % 5 / 5).alias("confidence"), F.col("role").alias("language")))


# --- sources ---

_ITEMS = "i AS (SELECT p_partkey % 50 AS doc, p_size AS page, p_brand AS text, p_partkey % 90 AS x, (p_partkey * 7) % 100 AS y, p_partkey AS k FROM part)"


@query("", f"WITH {_ITEMS}, n AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR lag(y) OVER w - y > 3 THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY doc, page ORDER BY y DESC, x, text)), l AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY y DESC, x, text ROWS UNBOUNDED PRECEDING) AS line FROM n), g AS (SELECT doc, page, line, string_agg(text, ' ' ORDER BY x, text) AS text, min(x) AS x0, min(y) AS y0, max(x + 5) AS x1, max(y + 8) AS y1 FROM l GROUP BY ALL), f AS (SELECT *, CASE WHEN lag(y0) OVER (PARTITION BY doc, page ORDER BY line) IS NULL OR lag(y0) OVER (PARTITION BY doc, page ORDER BY line) - y0 > 1.8::DOUBLE * 8 THEN 1 ELSE 0 END AS far FROM g), b AS (SELECT *, sum(far) OVER (PARTITION BY doc, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS block FROM f) SELECT doc, page, CAST(block AS BIGINT) AS block, string_agg(text, chr(10) ORDER BY line) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY doc, page, block")
def pdf_line_blocks(spark, sf):
    k = F.col("p_partkey")
    items = L.read(spark, sf, "part").select((k % 50).alias("doc"), F.col("p_size").alias("page"), F.col("p_brand").alias("text"), (k % 90).alias("x"), (k * 7 % 100).alias("y"), F.lit(5).alias("width"), F.lit(8).alias("height"))
    return documents.line_blocks(items)


@query("", "SELECT doc_id AS doc, CASE doc_id % 5 WHEN 0 THEN 'read: ' || text WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 5 IN (0, 2) THEN 'recognised' ELSE 'native' END AS parser, CASE doc_id % 5 WHEN 1 THEN 'encrypted' WHEN 2 THEN 'no_extractable_text' END AS error FROM documents")
def native_or_recognised(spark, sf):
    """Recognition stands for an injected reader that knows every document but those with doc_id mod 5 = 2."""
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    k = F.col("doc") % 5
    native = docs.select("doc", F.when(k > 2, F.col("text")).alias("text"), F.when((k == 0) | (k == 2), "no_extractable_text").when(k == 1, "encrypted").alias("error"))
    return documents.native_or_recognised(native, lambda d: d.where("doc % 5 = 0").join(docs, "doc").select("doc", F.concat(F.lit("read: "), "text").alias("text")))


@query("", "SELECT memory_id, count(*) AS chunks, 'table' AS expected FROM (SELECT doc_id AS memory_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS p FROM documents) GROUP BY memory_id")
def degraded_chunks(spark, sf):
    docs = L.read(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = documents.degraded_chunks(chunking.paragraphs(docs, 1 << 20), "table", F.lit("E1"))
    return rows.where("locator['parser_mode'] = 'degraded' and locator['parser_diagnostic'] = 'E1'").groupBy("memory_id", F.col("locator")["expected_structure"].alias("expected")).agg(F.count(F.lit(1)).alias("chunks"))


# --- machines, plans, releases ---


def _replay(name: str, machine: dict, start: str):
    """Registers the replay of a machine over events made by rule: each order's lines, an event of the machine each."""
    events = sorted({e for out in machine.values() for e in out})
    table = ", ".join(f"('{a}|{e}', '{b}')" for a, out in machine.items() for e, b in out.items())
    body = f"""WITH RECURSIVE m(k, nxt) AS (VALUES {table}), e AS (SELECT l_orderkey AS entity_id, {events}[CAST((l_linenumber * 5 + l_orderkey) % {len(events)} + 1 AS BIGINT)] AS event,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
        w AS (SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS n, '{start}' AS state, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS illegal FROM e
        UNION ALL SELECT w.entity_id, e.n, coalesce(m.nxt, w.state), w.version + CASE WHEN m.nxt IS NULL THEN 0 ELSE 1 END, w.illegal + CASE WHEN m.nxt IS NULL THEN 1 ELSE 0 END FROM w JOIN e ON e.entity_id = w.entity_id AND e.n = w.n + 1 LEFT JOIN m ON m.k = w.state || '|' || e.event)
        SELECT entity_id, state, version, illegal FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) = 1"""

    def run(spark, sf):
        li = L.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
        at = ((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % len(events) + 1).cast("int")
        rows = li.select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").cast("long").alias("event_id"), F.element_at(F.array(*map(F.lit, events)), at).alias("event"), F.lit(None).cast("long").alias("expected_version"), F.col("l_linenumber").cast("long").alias("seq"))
        return lifecycle.replay(rows, machine, start).select("entity_id", "state", "version", "illegal")

    run.__name__ = name
    query("", body)(run)


_replay("evolution_replay", lifecycle.EVOLUTION_RUN, "observed")
_replay("journey_replay", lifecycle.JOURNEY, "onboarding")
_replay("mission_replay", lifecycle.MISSION, "draft")
_replay("release_replay", lifecycle.PLUGIN_RELEASE, "proposed")


@query("", "WITH p AS (SELECT o_orderkey AS plan_id, o_orderpriority = '1-URGENT' AS e, CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'scheduled' ELSE 'done' END AS status, o_orderdate AS t FROM orders), d AS (SELECT plan_id, t, e AND status IN ('draft', 'scheduled') AS emergency, status = 'scheduled' AND t <= TIMESTAMP '1998-01-01' AS due FROM p) SELECT plan_id, emergency, row_number() OVER (PARTITION BY emergency ORDER BY t, plan_id) AS place FROM d WHERE emergency OR due")
def upgrade_plan_schedule(spark, sf):
    k = F.col("o_orderkey") % 4
    rows = L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "emergency").otherwise("batch").alias("mode"), F.when(k == 0, "draft").when(k < 3, "scheduled").otherwise("done").alias("status"), F.col("o_orderdate").alias("scheduled_at"))
    return lifecycle.due_plans(rows, NOW)


@query("", "WITH o AS (SELECT c_custkey AS subject_id, s AS share, c_custkey % (s + 2) <> 1 AS ok FROM customer, (VALUES (5), (50), (100)) t(s) WHERE NOT (s = 100 AND c_custkey % 4 = 0)), b AS (SELECT subject_id, min(share) FILTER (NOT ok) AS bad, count(*) FILTER (share = 100) AS full_ FROM o GROUP BY subject_id) SELECT subject_id, coalesce(bad, 100) AS share, CASE WHEN bad IS NOT NULL THEN 'rolled_back' WHEN full_ = 0 THEN 'observing' ELSE 'released' END AS outcome FROM b")
def canary_rollouts(spark, sf):
    s = F.col("share")
    rows = L.read(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.explode(F.array(*map(F.lit, lifecycle.CANARY_STAGES))).alias("share")).where(~((s == 100) & (F.col("subject_id") % 4 == 0)))
    return lifecycle.rollouts(rows.withColumn("ok", F.col("subject_id") % (s + 2) != 1))


@query("", "WITH c AS (SELECT p_partkey AS release_id, p_size % 3 AS version, ['sandbox_passed', 'verification_passed', 'canary_succeeded', 'canary_degraded', 'retire'][CAST(p_partkey % 5 + 1 AS BIGINT)] AS event FROM part), d AS (SELECT l_partkey AS release_id, arg_max(CASE WHEN l_linestatus = 'O' THEN 'promote' ELSE 'rollback' END, l_shipdate::VARCHAR || l_orderkey || '.' || l_linenumber) AS decision FROM lineitem GROUP BY 1) SELECT c.release_id, event, CASE event WHEN 'sandbox_passed' THEN c.release_id % 3 = 0 WHEN 'verification_passed' THEN c.release_id % 4 = 0 AND version = 1 WHEN 'canary_succeeded' THEN coalesce(decision = 'promote', FALSE) WHEN 'canary_degraded' THEN coalesce(decision = 'rollback', FALSE) ELSE TRUE END AS allowed FROM c LEFT JOIN d USING (release_id)")
def release_evidence(spark, sf):
    k = F.col("p_partkey")
    part = L.read(spark, sf, "part")
    names = ("sandbox_passed", "verification_passed", "canary_succeeded", "canary_degraded", "retire")
    commands = part.select(k.alias("release_id"), (F.col("p_size") % 3).alias("version"), F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int")).alias("event"))
    runs = part.select(k.alias("release_id"), (k % 3 == 0).alias("passed"))
    proofs = part.select(k.alias("release_id"), F.lit(1).alias("version"), (k % 4 == 0).alias("passed"))
    at = F.concat(L.s("l_shipdate"), L.s("l_orderkey"), F.lit("."), L.s("l_linenumber"))
    decisions = L.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("release_id"), at.alias("decided_at"), F.when(F.col("l_linestatus") == "O", "promote").otherwise("rollback").alias("decision"))
    return lifecycle.release_evidence(commands, runs, proofs, decisions)


@query("", "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 7}')")
def json_containment(spark, sf):
    return L.read(spark, sf, "events").where(variants.contains(variants.parse(F.col("props")), {"k": 7})).select("event_id")


def _streams(spark, sf):
    """What happens in a run: tasks, their deadlines and leases, model calls, shipments of outbox events, and violations."""
    tasks, calls = L.workflow_task(spark, sf), L.model_invocation(spark, sf)
    task = F.col("task_id").cast("string")
    lines = L.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag").join(L.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    broken = governance.violations(tasks).join(tasks.select("task_id", "run_id", "available_at"), "task_id")
    return {
        "agent_task": tasks.select("run_id", F.col("available_at").alias("occurred_at"), task.alias("activity_id"), "subject", "status"),
        "deadline": tasks.where("status <> 'completed'").select("run_id", F.col("deadline").alias("occurred_at"), task.alias("activity_id"), "attempt"),
        "lease": tasks.where("lease_expires_at is not null").select("run_id", F.col("lease_expires_at").alias("occurred_at"), task.alias("activity_id")),
        "model_invocation": calls.select("run_id", F.col("started_at").alias("occurred_at"), F.col("invocation_id").alias("activity_id"), "agent_id", "status", "total_tokens", "cost_usd"),
        "outbox_event": lines.select(F.col("o_custkey").alias("run_id"), F.col("l_shipdate").alias("occurred_at"), F.concat_ws(".", L.s("l_orderkey"), L.s("l_linenumber")).alias("activity_id"), F.col("l_returnflag").alias("provider")),
        "violation": broken.select("run_id", F.col("available_at").alias("occurred_at"), F.concat_ws(".", task, "violation").alias("activity_id"), "severity", "action"),
    }


_TRACE = """v AS (SELECT task_id, run_id, available_at, CASE WHEN hop_count > 8 THEN 'hop_limit' WHEN row_number() OVER (PARTITION BY run_id ORDER BY available_at, task_id) > 32 THEN 'budget_exhausted' WHEN row_number() OVER (PARTITION BY run_id, task_fingerprint ORDER BY available_at, task_id) > 1 THEN 'task_repetition' END AS violation FROM task),
    tr AS (SELECT run_id, available_at AS t, CAST(task_id AS VARCHAR) AS id, 'agent_task' AS kind FROM task UNION ALL SELECT run_id, deadline, CAST(task_id AS VARCHAR), 'deadline' FROM task WHERE status <> 'completed' UNION ALL SELECT run_id, lease_expires_at, CAST(task_id AS VARCHAR), 'lease' FROM task WHERE lease_expires_at IS NOT NULL
    UNION ALL SELECT run_id, started_at, invocation_id, 'model_invocation' FROM inv UNION ALL SELECT o_custkey, l_shipdate, l_orderkey || '.' || l_linenumber, 'outbox_event' FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT run_id, available_at, task_id || '.' || violation, 'violation' FROM v WHERE violation IS NOT NULL)"""


@query("task inv", f"WITH {_TRACE}, o AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY t, id, kind) - 1) // 25 AS page FROM tr) SELECT run_id, page, count(*) AS activities, min(t) AS first_at, max(t) AS last_at, arg_min(kind || ':' || id, (t, id, kind)) AS first_activity, arg_max(kind || ':' || id, (t, id, kind)) AS last_activity, count(DISTINCT kind) AS kinds FROM o GROUP BY run_id, page")
def run_trace_pages(spark, sf):
    """Every run's trace over all its streams, in pages of 25."""
    rows = ledger.paged(ledger.merged(_streams(spark, sf)), 25)
    name, order = F.concat_ws(":", "kind", "activity_id"), F.struct("occurred_at", "activity_id", "kind")
    return rows.groupBy("run_id", "page").agg(F.count(F.lit(1)).alias("activities"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.min_by(name, order).alias("first_activity"), F.max_by(name, order).alias("last_activity"), F.count_distinct("kind").alias("kinds"))


@query("task inv", f"WITH {_TRACE} SELECT run_id, kind, count(*) AS n, count(DISTINCT id) AS ids FROM tr GROUP BY ALL")
def run_trace_streams(spark, sf):
    """How much each stream gives to each run."""
    return ledger.merged(_streams(spark, sf)).groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("activity_id").alias("ids"))


@query("edge", """WITH f AS (SELECT source_node_id AS a, target_node_id AS b, edge_id, conflict_status <> 'none' AS bad FROM edge), p AS (SELECT 'customer:' || c_custkey AS start, 'region:' || (c_custkey % 5) AS target FROM customer),
    h1 AS (SELECT p.start, p.target, f.b, f.edge_id, f.bad FROM p JOIN f ON f.a = p.start), h2 AS (SELECT h1.start, h1.target, h1.b AS mid, f.b, h1.edge_id AS e1, f.edge_id, f.bad FROM h1 JOIN f ON f.a = h1.b WHERE NOT h1.bad AND h1.b <> h1.target),
    hit AS (SELECT start, target, start || '>' || mid || '>' || b AS path, e1 || '>' || edge_id AS edges FROM h2 WHERE b = target AND NOT bad), c AS (SELECT start, target, edge_id FROM h1 WHERE bad UNION SELECT start, target, edge_id FROM h2 WHERE bad)
    SELECT p.start, p.target, path IS NOT NULL AS found, coalesce(path, '') AS path, coalesce(edges, '') AS edges, coalesce((SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM c WHERE c.start = p.start), '') AS conflicts, (SELECT count(*) FROM c WHERE c.start = p.start) AS excluded FROM p LEFT JOIN hit USING (start, target)""")
def relation_path_conflicts(spark, sf):
    """From each customer to a region over edges that do not conflict, and the conflicting ones that were met."""
    from quarry.operators import graph

    pairs = L.read(spark, sf, "customer").select(F.concat(F.lit("customer:"), L.s("c_custkey")).alias("start"), F.concat(F.lit("region:"), L.s(F.col("c_custkey") % 5)).alias("target"))
    rows = graph.relation_paths(L.structured_edge(spark, sf), pairs, 3)
    return rows.select("start", "target", "found", F.array_join("nodes", ">").alias("path"), F.array_join("edge_ids", ">").alias("edges"), F.array_join("conflicts", ",").alias("conflicts"), "excluded")


@query("", "WITH e AS (SELECT DISTINCT o_orderkey // 2 AS parent, o_orderkey AS child FROM orders), a AS (SELECT o_orderkey AS parent, o_orderkey // 4 AS child FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 3 FROM orders UNION ALL SELECT o_orderkey // 5, o_orderkey FROM orders UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 7 = 0), r AS (SELECT DISTINCT parent, child FROM a) SELECT parent, child FROM r WHERE parent = child OR (EXISTS (SELECT 1 FROM range(0, 40) t(k) WHERE k > 0 AND parent // CAST(pow(2, k) AS BIGINT) = child) AND child < parent AND parent IN (SELECT child FROM e))")
def cycle_check(spark, sf):
    """Edges that would close a cycle where each order depends on the one of half its number."""
    from quarry.operators import graph

    k = F.col("o_orderkey").cast("long")
    orders = L.read(spark, sf, "orders")
    asks = (("o_orderkey", "o_orderkey div 4"), ("o_orderkey", "o_orderkey div 3"), ("o_orderkey div 5", "o_orderkey"))
    asked = orders.where(k % 7 == 0).select(k.alias("parent"), k.alias("child"))
    for parent, child in asks:
        asked = asked.unionByName(orders.select(F.expr(parent).cast("long").alias("parent"), F.expr(child).cast("long").alias("child")))
    return graph.would_cycle(orders.select(F.expr("o_orderkey div 2").alias("parent"), k.alias("child")), asked)


@query("", """SELECT event_id AS query_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'purpose' END, CASE WHEN floor(value) < 1 THEN 'token_budget' END,
    CASE WHEN event_type IN ('view', 'click') AND (user_id % 9 = 0 OR CAST(json_extract(props, '$.k') AS BIGINT) < 50) THEN 'structured_query' END, CASE WHEN event_type = 'signup' AND user_id % 4 = 0 THEN 'note' END], lambda x: x IS NOT NULL), ',') AS faults FROM events""")
def request_validation(spark, sf):
    """A request for each event: errors have no purpose, small values no budget, and ranges may end before they begin."""
    c, k = F.col, F.get_json_object("props", "$.k").cast("int")
    timed = c("event_type").isin("view", "click")
    time = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    asked = F.struct(F.lit("select_event_time").alias("kind"), c("event_type"), L.s("user_id").alias("subject_id"), F.when(c("user_id") % 9 == 0, "middle").otherwise("first").alias("selector"), time(c("ts")).alias("from"), time(F.timestamp_add("DAY", k - 50, c("ts"))).alias("to"))
    body = F.struct(
        L.s("event_id").alias("query_id"), F.lit("when was it").alias("original_query"), F.when(c("event_type") == "error", " ").otherwise("answer").alias("purpose"), F.when(timed, "temporal").otherwise("fact_lookup").alias("intent"), F.lit("learning-director").alias("agent_id"),
        F.struct(F.lit("t1").alias("tenant_id"), F.array(F.lit("r1")).alias("role_ids")).alias("principal"), F.floor("value").alias("token_budget"), F.lit(300).alias("estimated_chunk_tokens"), F.lit(True).alias("require_citations"), F.when(timed, asked).alias("structured_query"),
        F.when((c("event_type") == "signup") & (c("user_id") % 4 == 0), "x").alias("note"),
    )
    faults = gateway.request_faults(L.read(spark, sf, "events").select(c("event_id").alias("query_id"), F.to_json(body).alias("body")))
    return faults.select("query_id", F.array_join("faults", ",").alias("faults"))


@query("se", """WITH e AS (SELECT event_id, conflict_status <> 'none' AS bad, event_type, row_number() OVER (ORDER BY event_id) AS n, CAST(subject_id AS BIGINT) // 2 AS pair, CAST(subject_id AS BIGINT) % 2 AS side FROM se WHERE conflict_status <> 'none'),
    d AS (SELECT pair, event_type, min((side, event_id)) AS first FROM e GROUP BY ALL) SELECT pair, string_agg(event_type, ',' ORDER BY first) AS types FROM d GROUP BY pair""")
def ordered_conflict_union(spark, sf):
    """Of each pair of subjects, the kinds of event that are in conflict: those of the first as they come, then those of the second."""
    rows = L.structured_event(spark, sf).where("conflict_status <> 'none'")
    subject = F.col("subject_id").cast("long")
    first = rows.groupBy(subject.alias("subject"), "event_type").agg(F.min("event_id").alias("at"))
    each = first.groupBy(F.expr("subject div 2").alias("pair")).agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.col("subject") % 2 == side, F.struct("at", "event_type")))), lambda x: x["event_type"]).alias(f"s{side}") for side in (0, 1)))
    return each.select("pair", F.array_join(T.ordered_union(F.col("s0"), F.col("s1")), ",").alias("types"))


_BATCH = """b AS (SELECT *, task_id % 3 <> 0 AS stored, task_id % 6 AS epoch FROM task), c AS (SELECT *, CASE WHEN NOT stored THEN max(CASE WHEN stored THEN task_id END) OVER (PARTITION BY run_id ORDER BY task_id) END AS parent FROM b),
    d AS (SELECT c.task_id, c.run_id, c.subject, c.stored, c.parent AS parent_task_id, 'f' || (c.task_id % 4) AS fp, c.epoch, CASE WHEN c.stored THEN c.task_id % 9 WHEN p.task_id IS NULL THEN CASE WHEN c.task_id % 5 = 0 THEN 1 ELSE 0 END ELSE p.task_id % 9 + 1 + CASE WHEN c.task_id % 5 = 0 THEN 1 ELSE 0 END END AS hops, p.subject AS p_subject, p.task_id % 9 AS p_hops FROM c LEFT JOIN b p ON p.task_id = c.parent),
    q AS (SELECT c_custkey AS run_id, c_custkey % 2 = 0 AS whole FROM customer WHERE c_acctbal < -800), s AS (SELECT run_id, count(*) AS n FROM d WHERE stored GROUP BY 1),
    i AS (SELECT d.*, coalesce(s.n, 0) AS n, EXISTS (SELECT 1 FROM q WHERE q.run_id = d.run_id AND (whole OR subject = '1-URGENT')) AS held, EXISTS (SELECT 1 FROM d k WHERE k.stored AND k.run_id = d.run_id AND k.epoch = d.epoch AND k.fp = d.fp) AS known,
        CASE WHEN parent_task_id IS NULL THEN hops = 0 ELSE hops = p_hops + 1 AND p_subject <> subject END AS delegated FROM d LEFT JOIN s USING (run_id) WHERE NOT d.stored),
    f AS (SELECT *, hops <= 8 AND NOT held AND NOT known AND delegated AS fine FROM i), o AS (SELECT *, fine AND row_number() OVER (PARTITION BY run_id, epoch, fp, fine ORDER BY task_id) = 1 AS ok FROM f),
    u AS (SELECT *, n + coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 8 AS full_ FROM o)"""


@query("task", f"WITH {_BATCH} SELECT task_id, CASE WHEN hops > 8 THEN 'hop_limit' WHEN full_ THEN 'budget_exhausted' WHEN held THEN 'delegation_violation' WHEN known OR (fine AND NOT ok) THEN 'task_repetition' WHEN NOT delegated THEN 'delegation_violation' END AS violation FROM u")
def governed_enqueue(spark, sf):
    """A third of the tasks come as a batch to runs that have the others, at most eight a run; runs or agents of customers far in debt are in quarantine."""
    k = F.col("task_id")
    rows = L.workflow_task(spark, sf).select("task_id", "run_id", F.col("run_id").alias("root_run_id"), "subject", F.concat(F.lit("f"), L.s(k % 4)).alias("task_fingerprint"), (k % 6).alias("epoch"), (k % 3 != 0).alias("stored"))
    up = F.max(F.when(F.col("stored"), k)).over(W.Window.partitionBy("run_id").orderBy("task_id"))
    rows = rows.withColumn("parent_task_id", F.when(~F.col("stored"), up))
    wrong = F.when(k % 5 == 0, 1).otherwise(0)
    rows = rows.withColumn("hop_count", F.when(F.col("stored"), k % 9).when(F.col("parent_task_id").isNull(), wrong).otherwise(F.col("parent_task_id") % 9 + 1 + wrong))
    far = L.read(spark, sf, "customer").where("c_acctbal < -800").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 2 == 0, "run").otherwise("agent").alias("subject_type"), F.when(F.col("c_custkey") % 2 == 0, L.s("c_custkey")).otherwise("1-URGENT").alias("subject_id"), F.lit(True).alias("active"))
    return governance.enqueue(rows.where("stored"), rows.where("not stored"), far, max_tasks=8).select("task_id", "violation")


@query("mem", "SELECT tenant_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at, memory_id) AS BIGINT) AS place, memory_id FROM mem WHERE status = 'active' AND scope IN ('public', 'tenant')")
def active_source(spark, sf):
    """What the indexes of both tenants are built from, in order."""
    memories, out = L.memory_record(spark, sf), None
    for tenant in ("t0", "t1"):
        rows = store.active_source(memories, tenant, 1 << 30)
        part = rows.select("tenant_id", F.row_number().over(W.Window.partitionBy("tenant_id").orderBy("updated_at", "memory_id")).cast("long").alias("place"), "memory_id")
        out = part if out is None else out.unionByName(part)
    return out


def _payloads(spark, sf):
    """Orders with their lines as JSON: nested objects and arrays, keys out of order, numbers, strings, booleans and nulls."""
    line = F.struct(F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"), F.array(F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long") + 1).alias("at"))
    lines = L.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("x")))).alias("l"))
    order = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 2 == 0).alias("even"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).alias("code"))
    rows = L.read(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(order.alias("order"), F.transform("l", lambda x: x["x"]).alias("lines"), F.lit("v1").alias("kind")), {"ignoreNullFields": "false"}).alias("payload"))


_NESTED = "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {} GROUP BY o_orderkey"


@query("", "WITH x AS (" + _NESTED.format("l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) = 17") + "), y AS (" + _NESTED.format("l_linenumber = 4 OR l_linenumber = 3") + ") SELECT o_orderkey AS id, o_orderstatus = 'F' AND o_orderkey IN (FROM x) AS returned, o_orderkey % 2 = 0 AND o_custkey = 7 AS by_number, FALSE AS by_text, o_custkey % 3 = 0 AS no_code, o_orderkey IN (FROM y) AS at_four FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def json_nested_containment(spark, sf):
    v = variants.parse(F.col("payload"))
    has = lambda wanted, name: variants.contains(F.col("v"), wanted).alias(name)
    rows = _payloads(spark, sf).select("id", v.alias("v"))
    return rows.select("id", has({"order": {"status": "F"}, "lines": [{"flag": "R", "qty": 17}]}, "returned"), has({"order": {"customer": 7, "even": True}}, "by_number"), has({"order": {"customer": "7"}}, "by_text"), has({"order": {"code": None}}, "no_code"), has({"lines": [{"at": [4]}]}, "at_four"))


@query("", "WITH l AS (SELECT l_orderkey, min_by(l_returnflag, (l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), l_returnflag)) AS flag, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, flag AS first_flag, CAST(NULL AS VARCHAR) AS absent FROM orders JOIN l ON l_orderkey = o_orderkey")
def json_text_extract(spark, sf):
    """Text at paths: keys, array places, typed scalars, nulls and absent fields."""
    rows = _payloads(spark, sf).select("id", variants.parse(F.col("payload")).alias("v"))
    at = lambda name, *steps: variants.text_at(F.col("v"), *steps).alias(name)
    return rows.select("id", at("status", "order", "status"), at("customer", "order", "customer"), at("code", "order", "code"), at("even", "order", "even"), at("first_flag", "lines", 0, "flag"), at("absent", "lines", 99, "flag"))


@query("", """WITH l AS (SELECT l_orderkey, '[' || string_agg('{"at":[' || l_linenumber || ',' || (l_linenumber + 1) || '],"flag":"' || l_returnflag || '","qty":' || CAST(l_quantity AS BIGINT) || '}', ',' ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), l_returnflag) || ']' AS ls FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, sha256('{"kind":"v1","lines":' || ls || ',"order":{"code":' || CASE WHEN o_custkey % 3 > 0 THEN '"' || o_custkey || '"' ELSE 'null' END || ',"customer":' || o_custkey || ',"even":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"status":"' || o_orderstatus || '"}}') AS digest FROM orders JOIN l ON l_orderkey = o_orderkey""")
def canonical_json_nested(spark, sf):
    return _payloads(spark, sf).select("id", F.sha2(variants.canonical(F.col("payload")), 256).alias("digest"))


@query("", "WITH o AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT 'status' AS key, 'string' AS kind, count(*) AS n FROM o UNION ALL SELECT 'customer', 'number', count(*) FROM o UNION ALL SELECT 'even', 'boolean', count(*) FROM o UNION ALL SELECT 'code', CASE WHEN o_custkey % 3 > 0 THEN 'string' ELSE 'null' END, count(*) FROM o GROUP BY 2")
def json_field_profile(spark, sf):
    """Which fields the orders' objects have, and of which kinds."""
    rows = _payloads(spark, sf).select(variants.at(variants.parse(F.col("payload")), "order").alias("v"))
    return variants.fields(rows, "v").groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- further rules ---


@query("se", "WITH f AS (SELECT subject_id, event_type, max(occurred_from) AS seen, count(*) AS n FROM se GROUP BY ALL), i AS (SELECT 'incident.' || substr(sha256(subject_id || ':' || event_type), 1, 24) AS incident_id, * FROM f), st AS (SELECT incident_id, CASE WHEN CAST(subject_id AS BIGINT) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, TIMESTAMP '2024-01-01' AS last_seen, CAST(5 AS BIGINT) AS occurrences FROM i WHERE CAST(subject_id AS BIGINT) % 2 = 0), nw AS (SELECT * FROM i WHERE CAST(subject_id AS BIGINT) % 5 <> 0) SELECT coalesce(st.incident_id, nw.incident_id) AS incident_id, CASE WHEN nw.n IS NOT NULL THEN 'open' ELSE status END AS status, greatest(st.last_seen, nw.seen) AS last_seen, coalesce(occurrences, 0) + coalesce(nw.n, 0) AS occurrences, coalesce(status = 'resolved' AND nw.n IS NOT NULL, FALSE) AS reopened FROM st FULL JOIN nw ON st.incident_id = nw.incident_id")
def incident_merge(spark, sf):
    from quarry.operators import governance

    found = governance.incidents(L.structured_event(spark, sf), ["subject_id", "event_type"])
    k = F.col("subject_id").cast("long")
    stored = found.where(k % 2 == 0).select("incident_id", F.when(k % 3 == 0, "resolved").otherwise("open").alias("status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("last_seen"), F.lit(5).cast("long").alias("occurrences"))
    return governance.merge_incidents(stored, found.where(k % 5 != 0))


@query("vis", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY occurred_from, event_id) AS n FROM vis), t AS (SELECT subject_id, max(n) > 40 AS truncated FROM n GROUP BY subject_id), r AS (SELECT * FROM n WHERE n <= 40 AND conflict_status = 'none' QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY occurred_from, event_id) = 1) SELECT subject_id, event_type, min(occurred_from) AS first_at, arg_min(event_id, (occurred_from, event_id)) AS first_event_id, CASE WHEN NOT truncated THEN max(occurred_from) END AS last_at, CASE WHEN NOT truncated THEN arg_max(event_id, (occurred_from, event_id)) END AS last_event_id, truncated FROM r JOIN t USING (subject_id) GROUP BY subject_id, event_type, truncated")
def bounded_first_last(spark, sf):
    from quarry.operators import events

    return events.first_and_last_of_bounded(vis.readable_facts(L.structured_event(spark, sf), ME), 40)


@query("vis", "SELECT DISTINCT event_type FROM vis ORDER BY event_type LIMIT 3")
def event_type_list(spark, sf):
    from quarry.operators import events

    return events.event_types(vis.readable_facts(L.structured_event(spark, sf), ME), 3)


@query("", "WITH RECURSIVE d AS (SELECT CAST(o_orderkey AS BIGINT) AS child, CAST(o_orderkey // 2 AS BIGINT) AS parent FROM orders), b AS (SELECT child AS node FROM d WHERE child % 97 = 5), s AS (SELECT DISTINCT d.child AS node FROM d JOIN b ON d.parent = b.node UNION SELECT d.child FROM d JOIN s ON d.parent = s.node) SELECT child AS node, CASE WHEN child IN (SELECT node FROM s) THEN 'skipped' WHEN child % 97 = 5 THEN 'failed' ELSE 'done' END AS state FROM d")
def execution_states(spark, sf):
    """Each order depends on the one of half its number."""
    from quarry.operators import graph

    k = F.col("o_orderkey").cast("long")
    orders = L.read(spark, sf, "orders")
    return graph.run_states(orders.select(k.alias("node")), orders.select(F.expr("o_orderkey div 2").alias("parent"), k.alias("child")), orders.where(k % 97 == 5).select(k.alias("node")))


@query("", "WITH e AS (SELECT doc_id % 40 AS case_id, doc_id AS artifact_id, md5(text) AS digest FROM documents), h AS (SELECT case_id, artifact_id, CASE WHEN artifact_id % 7 = 0 THEN 'changed' ELSE digest END AS digest FROM e WHERE artifact_id % 5 <> 0) SELECT case_id, round(count(h.case_id) / count(*), 6) AS score, round(count(h.case_id) / count(*), 6) >= 0.9 AS passed FROM e LEFT JOIN h USING (case_id, artifact_id, digest) GROUP BY case_id")
def citation_probe(spark, sf):
    from quarry.operators import metrics

    k = F.col("artifact_id")
    rows = L.read(spark, sf, "documents").select((F.col("doc_id") % 40).alias("case_id"), F.col("doc_id").alias("artifact_id"), F.md5("text").alias("digest"))
    return metrics.citation_match_rate(rows, rows.where(k % 5 != 0).withColumn("digest", F.when(k % 7 == 0, "changed").otherwise(F.col("digest"))))


@query("", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 0")
def row_sampling(spark, sf):
    from quarry.operators import metrics

    return metrics.sample_rows(L.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("", "WITH p AS (SELECT DISTINCT c_custkey % 40 AS doc, c_nationkey % 6 + 1 AS page FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM p) SELECT doc, min(n) AS first_missing FROM n WHERE page <> n GROUP BY doc UNION ALL SELECT 1000, 1 FROM region WHERE r_regionkey = 0")
def page_gaps(spark, sf):
    from quarry.sources import parsers

    k = F.col("c_custkey")
    rows = L.read(spark, sf, "customer").select((k % 40).alias("doc"), (F.col("c_nationkey") % 6 + 1).alias("page"))
    return parsers.page_gaps(rows.unionByName(L.read(spark, sf, "region").where("r_regionkey = 0").select(F.lit(1000).alias("doc"), F.lit(3).alias("page"))))


@query("", "SELECT doc_id AS memory_id, CAST(CASE WHEN doc_id % 5 IN (0, 3) THEN 3 WHEN doc_id % 5 = 4 THEN 3 ELSE 0 END AS BIGINT) AS n_columns, CAST(CASE doc_id % 5 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 0 END AS BIGINT) AS n_rows, CASE doc_id % 5 WHEN 1 THEN 'headers must be unique and not empty' WHEN 2 THEN 'row 2 has 2 cells, not 3' END AS error FROM documents")
def csv_documents(spark, sf):
    """Every document's whole text as a quoted cell, line ends and quotes and all; a text may be as long as its source file may be."""
    from quarry.sources import parsers

    limits = parsers.LIMITS | {"chars": 1 << 31, "cell": 1 << 31}

    k = F.col("doc_id") % 5
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", L.s("doc_id"), cell, F.col("lang"))
    text = F.when(k == 0, F.concat(F.lit("\ufeffid,text,lang\n"), row, F.lit("\n\n"))).when(k == 1, F.concat(F.lit("id,Text,text\n"), row)).when(k == 2, F.concat(F.lit("id,text,lang\n1,2\n"))).when(k == 3, F.concat(F.lit("id,text,lang\r\n"), row, F.lit("\r\n"), row)).otherwise(F.lit("id,text,lang\n"))
    return parsers.csv_tables(L.read(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), text.alias("text")), limits)


@query("", "WITH r AS (SELECT l_suppkey AS item, l_orderkey * 10 + l_linenumber AS request_id, l_partkey FROM lineitem), d AS (SELECT DISTINCT item, request_id FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY request_id) AS n FROM d) SELECT item, request_id, n <= item % 50 AS accepted, n <= item % 50 + 1 AS counter_asked FROM n")
def stock_tiers(spark, sf):
    from quarry.operators import governance

    requests = L.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id")).distinct()
    stock = requests.select("item").distinct().withColumn("stock", F.col("item") % 50)
    return governance.stock_tiers(requests, stock)


def _paid_orders(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "paid").when(k % 4 == 2, "done").otherwise("cancelled")
    return L.read(spark, sf, "orders").select(k.alias("order_id"), F.concat(F.lit("n"), L.s(k)).alias("out_trade_no"), status.alias("status"))


@query("", "WITH c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS callback_id, l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS k FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY callback_id) = 1 AS first_ FROM c) SELECT callback_id, CASE WHEN o_orderkey IS NULL THEN 'invalid' WHEN k % 4 IN (1, 2) THEN 'already_paid' WHEN k % 4 = 0 THEN CASE WHEN first_ THEN 'paid' ELSE 'already_paid' END ELSE 'illegal' END AS outcome FROM f LEFT JOIN orders ON o_orderkey = k")
def pay_callbacks(spark, sf):
    from quarry.operators import governance

    k = F.col("l_orderkey")
    calls = L.read(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("callback_id"), F.concat(F.lit("n"), L.s(k + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0))).alias("out_trade_no")).distinct()
    return governance.pay_callbacks(_paid_orders(spark, sf), calls)


@query("", "SELECT o_orderkey AS order_id, o_orderkey % 4 IN (1, 2) AS allowed, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 3 THEN 'cancelled' ELSE 'refunding' END AS status FROM orders")
def refund_guard(spark, sf):
    from quarry.operators import governance

    return governance.refunds(_paid_orders(spark, sf))


@query("edge", "WITH e AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM edge WHERE conflict_status = 'none'), p AS (SELECT 'region:' || r_regionkey AS start, 'supplier:' || s_suppkey AS target FROM region, supplier WHERE s_suppkey % 10 = r_regionkey), h1 AS (SELECT start, target, a AS m FROM p JOIN e ON e.b = p.start), f AS (SELECT start, target, min(start || '>' || m || '>' || target) AS path FROM h1 JOIN e ON e.b = h1.m AND e.a = h1.target GROUP BY ALL) SELECT p.start, p.target, path, CAST(CASE WHEN path IS NOT NULL THEN 2 END AS BIGINT) AS hops FROM p LEFT JOIN f USING (start, target)")
def relation_path_inbound(spark, sf):
    """From a region to a supplier, against the edges."""
    from quarry.operators import graph

    regions, suppliers = L.read(spark, sf, "region"), L.read(spark, sf, "supplier")
    pairs = suppliers.join(F.broadcast(regions), F.col("s_suppkey") % 10 == F.col("r_regionkey")).select(F.concat(F.lit("region:"), L.s("r_regionkey")).alias("start"), F.concat(F.lit("supplier:"), L.s("s_suppkey")).alias("target"))
    return graph.shortest_paths(L.structured_edge(spark, sf), pairs, 2, inbound=True)
