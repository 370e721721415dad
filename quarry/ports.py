"""Extension points: what a retriever, an authoriser, a parser or any other part has to offer to take another's place.

All of them work on batches, as DataFrames; a plain function of the same signature is one. `Gateway` puts those of retrieval together.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.operators import evidence, gateway, retrieval
from quarry.plans import planner
from quarry.session import cut


@runtime_checkable
class Retriever(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id, query, ... -> query_id, chunk_id, score (finite, from 0)."""


@runtime_checkable
class Authoriser(Protocol):
    def __call__(self, hits: DataFrame) -> DataFrame:
        """query_id, chunk_id, ... -> the rows of them that may be read."""


@runtime_checkable
class Rewriter(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id, query -> query_id, rewritten."""


@runtime_checkable
class Reranker(Protocol):
    def __call__(self, query: str, contents: list[str]) -> list[float]:
        """One score from 0 to 1 for each content."""


@runtime_checkable
class Expander(Protocol):
    def __call__(self, evidence: DataFrame) -> DataFrame:
        """query_id, chunk_id, place -> query_id, chunk_id of what belongs to them as well."""


@runtime_checkable
class Aggregator(Protocol):
    def __call__(self, requests: DataFrame) -> DataFrame:
        """query_id, intent, ... -> query_id, conflicts, for the requests that have a structured answer."""


@runtime_checkable
class SourceParser(Protocol):
    def __call__(self, sources: DataFrame) -> DataFrame:
        """memory_id, content -> memory_id, text, error."""


@runtime_checkable
class Chunker(Protocol):
    def __call__(self, text: str) -> list[dict]:
        """Drafts of one text: level, ordinal, parent, path, content, locator."""


@runtime_checkable
class QualityProbe(Protocol):
    def __call__(self, expected: DataFrame, hits: DataFrame) -> DataFrame:
        """case_id, score, passed."""


@runtime_checkable
class Embedder(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame:
        """chunk_id, content -> chunk_id, embedding."""


@runtime_checkable
class DeletionConsumer(Protocol):
    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """event_id, ... -> event_id, ok; see streaming.jobs.dispatch."""


@dataclass(frozen=True)
class Gateway:
    """Requests in, evidence and packs out.

    chunks: chunk_id, content, token_count, source_type, entity_keys. A plan's numbers bound each window: candidate_k of each list, fusion_k of
    the fused ones, rerank_k of the authorised ones, context_k of the evidence. What an expander adds is authorised again.

    A retriever that fails is named in the packs, and the others' answer stands; with strict_retrieval, it ends the batch (gateway.Incomplete), so that no
    answer comes from fewer lists than it should.
    """

    retrievers: Mapping[str, Retriever]
    authoriser: Authoriser
    chunks: DataFrame
    rewriter: Rewriter | None = None
    reranker: Reranker | None = None
    strict_rerank: bool = False
    strict_retrieval: bool = False
    expander: Expander | None = None
    aggregator: Aggregator | None = None

    def answer(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """requests: query_id, query, and what planner.plan() takes.

        Evidence (query_id, chunk_id, place), and packs (query_id, fused, authorized, denied, selected, stopped_by, coverage, status, generation_allowed,
        and failed: the retrievers that failed, of the batch or of its rewritten queries).
        """
        spark = requests.sparkSession
        structured = planner.intents(spark).select("intent", F.col("structured").alias("structured_required"))
        plans = cut(planner.plan(requests.drop("query")).join(F.broadcast(structured), "intent"))
        queries = requests.select("query_id", "query").join(plans.select("query_id", "candidate_k"), "query_id")
        failed: set[str] = set()

        def ask(q: DataFrame) -> gateway.FanOut:
            try:
                out = gateway.fan_out(q, self.retrievers, "candidate_k", self.strict_retrieval)
            except gateway.Unavailable:
                failed.update(self.retrievers)
                raise
            failed.update(out.failed)
            return out

        first = ask(queries)
        lists = first.lists if self.rewriter is None else gateway.rewrite_empty(first, queries, self.rewriter, ask).drop("rewritten")
        fused = gateway.windows(retrieval.fuse(lists), plans, "fusion_k")
        try:
            allowed = cut(self.authoriser(fused))
        except Exception as e:  # nobody may read anything, and could not be checked, are different answers
            raise gateway.Unavailable(f"authorisation failed: {str(e)[:200]}") from e
        counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused")).join(allowed.groupBy("query_id").agg(F.count(F.lit(1)).alias("authorized")), "query_id", "left").na.fill(0, ["authorized"])
        window = gateway.windows(allowed.withColumn("position", F.row_number().over(W.Window.partitionBy("query_id").orderBy("position"))), plans, "rerank_k").select("query_id", "chunk_id", "score", "position")
        if self.reranker is not None:
            asked = window.join(self.chunks.select("chunk_id", "content"), "chunk_id").join(retrieval.small(queries.select("query_id", "query")), "query_id")
            window = gateway.rerank(asked, self.reranker, self.strict_rerank).drop("reranked")
        chosen = cut(evidence.select_batch(window.join(self.chunks.select("chunk_id", "token_count", "source_type", "entity_keys"), "chunk_id"), plans))
        found = chosen.select("query_id", "chunk_id", "place")
        if self.expander is not None:
            more = self.authoriser(self.expander(found).select("query_id", "chunk_id").distinct().join(found, ["query_id", "chunk_id"], "left_anti"))
            after = found.groupBy("query_id").agg(F.max("place").alias("_last"))
            placed = more.join(after, "query_id").withColumn("place", (F.col("_last") + F.row_number().over(W.Window.partitionBy("query_id").orderBy("chunk_id"))).cast("int"))
            found = found.unionByName(placed.select("query_id", "chunk_id", "place"))
        packs = gateway.sufficiency(found, plans, self.aggregator(requests) if self.aggregator else None)
        why = chosen.groupBy("query_id").agg(F.max("stopped_by").alias("stopped_by"))
        packs = packs.join(counts, "query_id", "left").na.fill(0, ["fused", "authorized"]).join(why, "query_id", "left")
        return found, packs.select("query_id", "fused", "authorized", (F.col("fused") - F.col("authorized")).alias("denied"), "selected", "stopped_by", "coverage", "status", "generation_allowed", F.array(*map(F.lit, sorted(failed))).cast("array<string>").alias("failed"))


