"""The registered queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, html_main, jaccard, licenses, packing, pii, quality, rules, secrets, substring, topk, whitening
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are the documents, in the directories source/language."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_pii, op3_substring_dedup, op4_html_extraction, op5_packing, op6_secret_scan, op7_ngram_jaccard_join, op8_decontamination, op9_quality_classifier, op10_exact_topk, op11_embedding_whitening, op12_quality_rules, op13_vector_codes)}

#: Where DuckDB can express a query. The others are tested against brute force, an exact round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        least AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
        hit AS (SELECT doc_id, i FROM g JOIN least USING (gram) WHERE doc_id > first_doc),
        gone AS (SELECT DISTINCT doc_id, i + j AS k FROM hit, range(0, 13) r(j)),
        removed AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
        kept AS (SELECT doc_id, len(ws) AS n_words, CASE WHEN ks IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN list_contains(ks, k) THEN NULL ELSE ws[k] END), lambda x: x IS NOT NULL) END AS left_words FROM w LEFT JOIN removed USING (doc_id))
        SELECT doc_id, n_words, n_words - len(left_words) AS n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept""",
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT DISTINCT x AS node, x AS label FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.node WHERE r.label < e.y)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(label) AS c FROM r GROUP BY node) USING (doc_id)""",
    "op10_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_quality_rules": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
        g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM a WHERE len(ws) >= 8)),
        twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
        r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j FROM twice, range(0, 8) k(j)) GROUP BY doc_id),
        c AS (SELECT doc_id, len(ws) AS n_words, array_to_string(ws, '') AS j, len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
              len(list_filter(ws, lambda w: list_contains({stop}, lower(rtrim(w, '.,;:!?'))))) AS stop FROM a LEFT JOIN r USING (doc_id)),
        d AS (SELECT *, length(j) AS word_chars, length(j) - length(regexp_replace(j, '[#*$%&|<>]+', '', 'g')) AS n_symbols, length(j) - length(replace(j, '!', '')) AS bangs,
              length(j) - length(regexp_replace(j, '\p{L}+', '', 'g')) AS letters, length(j) - length(regexp_replace(j, '\p{Lu}+', '', 'g')) AS capitals FROM c),
        e AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM d)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 30 AND n_symbols / n_words <= 0.3 AND bangs / n_words <= 0.5 AND letters / word_chars BETWEEN 0.5 AND 1 AND (letters = 0 OR capitals / letters <= 0.6)
            AND (n_words < 100 OR stop / n_words BETWEEN 0.02 AND 1) AND n_dup_lines / lines <= 0.5 AND (n_words < 100 OR word_chars / lines >= 8) AS kept FROM e""".replace("{stop}", str(list(rules.STOP_WORDS))),
    "op13_vector_codes": """
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, len(embedding) // 16 AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT vec_id, label, p, list_slice(q, p * w + 1, (p + 1) * w) AS x FROM v, range(0, 16) r(p)),
        b0 AS (SELECT p, (SELECT count(*) FROM v u WHERE u.vec_id < t.vec_id) AS k, x AS e FROM p t WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
        {rounds}
        code AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
        sha AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN v USING (vec_id), sha""".replace("{rounds}", "".join(f"""
        d{i} AS (SELECT vec_id, p.p, k, x, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away FROM p JOIN b{i} USING (p)),
        a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY away, k) = 1),"""
        + (f"""
        m{i} AS (SELECT p, k, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS c FROM a{i}, range(1, (SELECT max(w) FROM v) + 1) r(j) GROUP BY ALL),
        b{i + 1} AS (SELECT p, k, coalesce(c, e) AS e FROM b{i} LEFT JOIN (SELECT p, k, list(c ORDER BY j) AS c FROM m{i} GROUP BY ALL) USING (p, k)),""" if i < 2 else "") for i in range(3))),
}
