"""Batched retrieval: lexical and vector top-k, fusion, relation candidates. Queries are a dimension, never a loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.functions import text as T
from quarry.functions import websearch
from quarry.session import cut

#: Rows of queries that one broadcast may hold; larger batches are joined by shuffles.
MOST_BROADCAST_QUERIES = 10_000
RRF = 60


def small(df: DataFrame, most: int = MOST_BROADCAST_QUERIES) -> DataFrame:
    """A broadcast hint where at most `most` rows are there, else the frame as it is; the check reads no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top(hits: DataFrame, k: int | Column, score: str = "score", of: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The k best per query, ties by key; partial limits keep the shuffle to k rows per query and task."""
    w = W.Window.partitionBy(of).orderBy(F.desc(score), F.col(key))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of(hits: DataFrame, queries: DataFrame, k: int | str) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best; k is a number, or the column of queries that has each query's own."""
    if isinstance(k, str):
        ranked = top(hits.join(small(queries.select("query_id", F.col(k).alias("_k"))), "query_id"), F.col("_k"))
    else:
        ranked = top(hits, k)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def lexical(chunks: DataFrame, queries: DataFrame, k: int | str | None = 10, least: int = 2) -> DataFrame:
    """chunks: chunk_id, content; queries: query_id, query. Web search semantics, and beyond them partial matches. k: None for all matches, without rank.

    This reads the texts; postings.Stored answers the same from a stored index.

    A chunk matches where it holds what an alternative of the query asks for, or at least min(least, n) of the n words that are no
    function words, or of the n Han bigrams. Its rank is the cover density of the web search plus half of that of each partial match,
    which for separate words is 0.1 an occurrence; the score is r / (1 + r).

    Terms meet chunks by an equi-join on the term, after counting each chunk's tokens, so no chunk is compared with a query that
    shares nothing with it. Positions are only taken of chunks that hold all words of an alternative.
    """
    text = T.sanitise_query(F.col("query"))
    asked = queries.select("query_id", T.query_terms(text).alias("latin"), websearch.parse(text).alias("units"), T.cjk_bigrams(text).alias("han"))
    need = F.filter("units", lambda u: ~u["excluded"])
    alternatives = F.array_distinct(F.transform(need, lambda u: u["alternative"]))
    #: By alternative, the distinct words that it cannot do without.
    required = F.transform(alternatives, lambda a: F.struct(a.alias("alternative"), F.array_distinct(F.flatten(F.transform(F.filter(need, lambda u: u["alternative"] == a), lambda u: u["terms"]))).alias("terms")))
    asked = asked.withColumn("required", required).withColumn("web", F.array_distinct(F.flatten(F.transform("units", lambda u: u["terms"]))))
    sole = F.when(F.size("required") == 1, F.element_at("required", 1)["terms"]).otherwise(F.array().cast("array<string>"))
    wanted = asked.select("query_id", "latin", sole.alias("sole"), F.explode(F.array_union("latin", "web")).alias("term")).select("query_id", "term", F.array_contains("latin", F.col("term")).alias("is_latin"), F.array_contains("sole", F.col("term")).alias("is_sole"), F.size("latin").alias("n_latin"), F.size("sole").alias("n_sole"))
    counts = chunks.select("chunk_id", F.explode(T.tokens(F.col("content"))).alias("term"))
    counts = counts.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    met = counts.join(small(wanted), "term").groupBy("query_id", "chunk_id").agg(
        F.count_if("is_latin").alias("matched"), F.sum(F.when(F.col("is_latin"), F.col("tf")).otherwise(0)).alias("occurrences"), F.max("n_latin").alias("n_latin"), ((F.count_if("is_sole") == F.max("n_sole")) & (F.max("n_sole") > 0)).alias("whole")
    )
    several = asked.where(F.size("required") > 1).select("query_id", F.explode("required").alias("r")).select("query_id", "r.alternative", F.size("r.terms").alias("n"), F.explode("r.terms").alias("term"))
    some = counts.join(small(several), "term").groupBy("query_id", "chunk_id", "alternative", "n").agg(F.count(F.lit(1)).alias("have")).where("have = n").select("query_id", "chunk_id")
    whole = met.where("whole").select("query_id", "chunk_id").unionByName(some).distinct()
    density = _density(chunks, asked.select("query_id", "units", "web"), whole)
    partial = met.where((F.col("matched") >= F.least(F.lit(least), "n_latin")) & (F.col("n_latin") > 0)).select("query_id", "chunk_id", (F.col("occurrences") * websearch.WEIGHT).alias("partial"))
    out = partial.join(density, ["query_id", "chunk_id"], "full")
    han = asked.select("query_id", F.size("han").alias("n"), F.explode("han").alias("term"))
    if not han.isEmpty():
        grams = chunks.select("chunk_id", F.explode(T.cjk_occurrences(F.col("content"))).alias("term")).join(small(han), "term").groupBy("query_id", "chunk_id").agg(F.countDistinct("term").alias("matched"), F.count(F.lit(1)).alias("occurrences"), F.max("n").alias("n"))
        out = out.join(grams.where(F.col("matched") >= F.least(F.lit(least), "n")).select("query_id", "chunk_id", (F.col("occurrences") * websearch.WEIGHT).alias("grams")), ["query_id", "chunk_id"], "full")
    else:
        out = out.withColumn("grams", F.lit(0.0))
    part = lambda c: F.coalesce(c, F.lit(0.0))
    raw = part("density") + 0.5 * part("partial") + 0.5 * part("grams")
    scored = out.withColumn("score", F.round(T.normalised_score(raw), 6))
    return scored.select("query_id", "chunk_id", "score") if k is None else best_of(scored, queries, k)


def _density(chunks: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, chunk_id, density of the pairs that match; a text's positions of the query's terms are one row."""
    at = F.filter(F.transform(T.tokens(F.col("content")), lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: F.array_contains("web", x["term"]))
    rows = pairs.join(small(asked), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", "chunk_id", "units", at.alias("found"))

    def run(batches):
        for pdf in batches:
            out = []
            for units, found in zip(pdf["units"], pdf["found"], strict=True):
                at: dict[str, list[int]] = {}
                for x in found:
                    at.setdefault(x["term"], []).append(x["at"])
                out.append(websearch.cover_density([(u["alternative"], u["excluded"], list(u["terms"])) for u in units], at))
            yield pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "density": pd.Series(out, dtype=float)})

    return rows.mapInPandas(run, "query_id long, chunk_id long, density double").where("density is not null and not isnan(density)")


#: Bytes of queries, with what is kept of them, that one task takes at once, and how many passes of broadcast blocks there may be before blocks are shuffled.
BLOCK_BYTES, MOST_PASSES = 32 << 20, 4
#: Queries and vectors of one matrix product; up to EAGER queries are answered where the vectors are read.
TILE, EAGER = (512, 1024), 1024
_SCORED = "query_id long, chunk_id long, score double"


def vector(chunks: DataFrame, queries: DataFrame, k: int | str = 10, where: Column | None = None, half: bool = False) -> DataFrame:
    """Exact top-k by cosine; chunks: chunk_id, embedding; queries: query_id, query_vector. Filters come before any distance.

    Queries are packed into blocks of bounded bytes. A few blocks are broadcast, one pass of block matrix products over the chunks
    each; of more, each is sent to parts of the chunks, fewer the more blocks there are. A task goes through its chunks batch by batch and keeps the k best of each
    query of its block, which it gives once. half: vectors are narrowed to half precision (fp16) before distances.
    """
    rows = (chunks if where is None else chunks.where(where)).select("chunk_id", "embedding").where("embedding is not null")
    n, dim, most = queries.agg(F.count(F.lit(1)), F.max(F.size("query_vector")), F.max(k) if isinstance(k, str) else F.lit(k)).first()
    out = _in_blocks(rows, queries.select("query_id", "query_vector"), n, max(dim or 1, 1) * 8 + (most or 0) * 40, _SCORED, most, half)
    return best_of(out, queries, k)


def places(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank of each query's own item among all chunks, by cosine as vector() has it, however far down; wanted: query_id, query_vector, chunk_id.

    Those without a vector, or without a score, have no rank and no row. What comes before an item is counted by blocks of matrix products; no list is kept.
    """
    rows = chunks.select("chunk_id", "embedding").where("embedding is not null")
    both = wanted.where("query_vector is not null").join(rows, "chunk_id").select("query_id", "query_vector", "chunk_id", "embedding")

    def own(batches):
        for pdf in batches:
            if len(pdf):
                s = (_unit(pdf["query_vector"], False) * _unit(pdf["embedding"], False)).sum(axis=1)
                yield pdf[["query_id", "query_vector", "chunk_id"]].assign(score=np.round(np.clip(0.5 + 0.5 * s, 0, 1), 6))

    kind = wanted.schema["query_vector"].dataType.simpleString()
    asked = cut(both.mapInPandas(own, f"query_id long, query_vector {kind}, chunk_id long, score double").where("score is not null and not isnan(score)"))
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).first()
    ahead = _in_blocks(rows, asked, n, max(dim or 1, 1) * 8 + 40, "query_id long, ahead long", keep=Ahead, more=("chunk_id", "score")).groupBy("query_id").agg(F.sum("ahead").alias("ahead"))
    return asked.select("query_id", "chunk_id").join(ahead, "query_id").select("query_id", "chunk_id", (F.col("ahead") + 1).alias("rank"))


def _in_blocks(rows: DataFrame, queries: DataFrame, n: int, size: int, schema: str, k: int | None = None, half: bool = False, keep: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """What keep(ids, vectors, k, *more columns), Best if unset, of each block of queries says after it has met all rows, a part of it from each task; n queries of `size` bytes."""
    spark = rows.sparkSession
    blocks = max(1, -(-n * size // BLOCK_BYTES))
    dealt = queries.select("query_id", "query_vector", *more, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not n:
        return spark.createDataFrame([], schema)
    if blocks <= MOST_PASSES:
        out = None
        spread = rows if n <= EAGER else rows.repartition(parts, "chunk_id")
        for b in range(blocks):
            got = dealt.where(F.col("block") == b).orderBy("query_id").toPandas()
            held = spark.sparkContext.broadcast((got["query_id"].to_numpy(), np.array(got["query_vector"].tolist(), float), *(got[c].to_numpy() for c in more)))
            part = spread.mapInPandas(_scan(held, k, half, keep), schema)
            out = part if out is None else out.unionByName(part)
        return out
    shares = -(-2 * parts // blocks)
    names = [f"more{i}" for i in range(len(more))]
    left = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(shares)).alias("share"), F.lit(True).alias("held"), F.col("chunk_id").alias("id"), F.col("embedding").alias("v"), *(F.lit(0).cast(queries.schema[c].dataType).alias(a) for c, a in zip(more, names, strict=True)))
    right = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("held"), F.col("query_id").alias("id"), F.col("query_vector").alias("v"), *(F.col(c).alias(a) for c, a in zip(more, names, strict=True)))
    cells = right.unionByName(left).repartitionById(blocks * shares, (F.col("block") * shares + F.col("share")).cast("int"))
    return cells.select("held", "id", "v", *names).sortWithinPartitions("held").mapInPandas(_meet(k, half, keep, names), schema)


def _unit(vectors, half: bool) -> np.ndarray:
    x = np.array(list(vectors), float)
    x = x.astype(np.float16).astype(float) if half else x
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(chunk: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    s = np.round(np.clip(0.5 + 0.5 * (q @ x.T), 0, 1), 6)
    pick = np.lexsort((np.broadcast_to(chunk, s.shape), -s), axis=1)[:, :k]
    return pd.DataFrame({"query_id": np.repeat(ids, pick.shape[1]), "chunk_id": chunk[pick].ravel(), "score": np.take_along_axis(s, pick, 1).ravel()})


class Best:
    """The k best of each of some queries while vectors come by, best first, ties by chunk_id; its memory depends on the queries and k alone.

    Products are taken in tiles. A tile's scores are only rounded and sorted in where they reach what a query's kth had when its candidates were last sorted in.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score, self.chunk = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, chunk: np.ndarray, x: np.ndarray) -> None:
        fine = np.isfinite(x).all(axis=1)
        chunk, x = (chunk, x) if fine.all() else (chunk[fine], x[fine])
        for a in range(0, len(self.ids) if self.k else 0, TILE[0]):
            for b in range(0, len(x), TILE[1]):
                self._tile(a, chunk[b : b + TILE[1]], x[b : b + TILE[1]])

    def _tile(self, a: int, chunk: np.ndarray, x: np.ndarray) -> None:
        s = self.q[a : a + TILE[0]] @ x.T
        end = a + len(s)
        least = 2 * self.score[a:end, -1] - 1
        if s.shape[1] > self.k and np.isinf(least).any():
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(s >= (least - 2e-6)[:, None])  # a step of the sixth digit is 2e-6 of a cosine
        score, found, last = np.round(np.clip(0.5 + 0.5 * s[row, col], 0, 1), 6), chunk[col], self.score[a:end, -1][row]
        better = (score > last) | ((score == last) & (found < self.chunk[a:end, -1][row]))
        if better.any():
            own = self.waiting.setdefault(a, [])
            own.append((row[better], score[better], found[better]))
            if np.isinf(least).any() or sum(len(w[0]) for w in own) >= len(s) * self.k:
                self._settle(a)

    def _settle(self, a: int) -> None:
        row, score, chunk = map(np.concatenate, zip(*self.waiting.pop(a), strict=True))
        which, of = np.unique(row, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(which)), self.k), of])
        score, chunk = np.concatenate([self.score[a + which].ravel(), score]), np.concatenate([self.chunk[a + which].ravel(), chunk])
        order = np.lexsort((chunk, -score, of))
        place = np.arange(len(of)) - np.searchsorted(of[order], np.arange(len(which)))[of[order]]
        kept = order[place < self.k]
        self.score[a + which], self.chunk[a + which] = score[kept].reshape(-1, self.k), chunk[kept].reshape(-1, self.k)

    def rows(self) -> Iterator[pd.DataFrame]:
        """query_id, chunk_id, score, some queries at a time."""
        for a in list(self.waiting):
            self._settle(a)
        step = max(1, (1 << 16) // max(1, self.k))
        for a in range(0, len(self.ids), step):
            score = self.score[a : a + step]
            i, j = np.nonzero(score > -np.inf)
            if len(i):
                yield pd.DataFrame({"query_id": self.ids[a + i], "chunk_id": self.chunk[a + i, j], "score": score[i, j]})


class Ahead:
    """How many vectors come before the own item of each of some queries, by score and then by chunk_id, while vectors come by; its memory depends on the queries alone."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: None, chunk: np.ndarray, score: np.ndarray):
        self.ids, self.q, self.chunk, self.score = ids, q, chunk.astype(np.int64), score
        self.n = np.zeros(len(ids), np.int64)

    def add(self, chunk: np.ndarray, x: np.ndarray) -> None:
        fine = np.isfinite(x).all(axis=1)
        chunk, x = (chunk, x) if fine.all() else (chunk[fine], x[fine])
        for a in range(0, len(self.ids), TILE[0]):
            own, mine = self.score[a : a + TILE[0]], self.chunk[a : a + TILE[0]]
            for b in range(0, len(x), TILE[1]):
                s = self.q[a : a + TILE[0]] @ x[b : b + TILE[1]].T
                row, col = np.nonzero(s >= (2 * own - 1 - 2e-6)[:, None])
                score, found = np.round(np.clip(0.5 + 0.5 * s[row, col], 0, 1), 6), chunk[b + col]
                before = ((score > own[row]) | ((score == own[row]) & (found < mine[row]))) & (found != mine[row])
                self.n[a : a + TILE[0]] += np.bincount(row[before], minlength=len(own))

    def rows(self) -> Iterator[pd.DataFrame]:
        """query_id, ahead."""
        yield pd.DataFrame({"query_id": self.ids, "ahead": self.n})


def _scan(queries, k: int | None, half: bool, keep: Callable | None = None):
    def run(batches):
        ids, q, *more = queries.value
        best = (keep or Best)(ids, _unit(q, half), k, *more) if len(ids) else None
        for pdf in batches:
            if len(pdf) and best:
                best.add(pdf["chunk_id"].to_numpy(), _unit(pdf["embedding"], half))
        if best:
            yield from best.rows()

    return run


def _meet(k: int | None, half: bool, keep: Callable | None, more: list[str]):
    """A block's queries, and after them the chunks of a share."""

    def run(batches):
        asked, best = [], None
        for pdf in batches:
            own = pdf[~pdf["held"]]
            if len(own):
                asked.append((own["id"].to_numpy(), _unit(own["v"], half), *(own[c].to_numpy() for c in more)))
            own = pdf[pdf["held"]]
            if len(own) and asked:
                if best is None:
                    ids, q, *rest = map(np.concatenate, zip(*asked, strict=True))
                    best = (keep or Best)(ids, q, k, *rest)
                best.add(own["id"].to_numpy(), _unit(own["v"], half))
        if best:
            yield from best.rows()

    return run


def narrowed_overlap(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query: how many of the exact top-k stay in the top-k with vectors of half precision."""
    coarse = vector(chunks, queries, k, half=True).select("query_id", "chunk_id", F.lit(1).alias("_in"))
    return vector(chunks, queries, k).join(coarse, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("_in").alias("overlap"), F.count(F.lit(1)).alias("returned"))


def fuse(lists: DataFrame, constant: int = RRF) -> DataFrame:
    """lists: query_id, retriever, chunk_id, rank (from 1). Reciprocal rank fusion; the best of each query scores 1."""
    each = lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("raw"), F.count(F.lit(1)).alias("agreement"), F.min("rank").cast("long").alias("best_rank"))
    best = each.groupBy("query_id").agg(F.max("raw").alias("best"))
    out = each.join(best, "query_id").withColumn("score", F.round(F.col("raw") / F.col("best"), 6))
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("agreement"), "best_rank", "chunk_id")
    return out.withColumn("position", F.row_number().over(w)).select("query_id", "chunk_id", "score", "agreement", "best_rank", "position")


def running_fusion(lists: DataFrame, constant: int = RRF) -> DataFrame:
    """The prototype's variant: ranks go on across the lists, in the order of retriever."""
    w = W.Window.partitionBy("query_id").orderBy("retriever", "rank")
    rows = lists.withColumn("_n", F.row_number().over(w))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("_n"))), 9).alias("score"))


def linear(lexical_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Half the lexical and half the vector score, a missing one counting 0."""
    a, b = lexical_hits.select("query_id", "chunk_id", F.col("score").alias("l")), vector_hits.select("query_id", "chunk_id", F.col("score").alias("v"))
    return a.join(b, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", F.round(0.5 * F.coalesce("l", F.lit(0.0)) + 0.5 * F.coalesce("v", F.lit(0.0)), 7).alias("score"))


def authorised(hits: DataFrame, readable: DataFrame, memory_of: DataFrame) -> DataFrame:
    """Hits whose memory the principal may read, in one join for the whole batch."""
    return hits.join(memory_of, "chunk_id").join(readable.select("memory_id"), "memory_id", "left_semi")


def related(anchors: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """Candidates around anchors in the same memory: same region 1.0, neighbour 0.8, shared entity 0.6, same time 0.4; best first.

    One equi-join for each relation, on the memory and what the relation shares. A relation's candidates are numbered by chunk_id in their
    group before the join, and of each group only the first `most` + 1 can stand among an anchor's best, so a large memory is never paired with itself.
    """
    key = {
        "region": (F.col("region"), 1.0),
        "entity": (F.explode("entity_keys"), 0.6),
        "time": (F.col("time_key"), 0.4),
    }
    side = lambda rows, c: rows.select("memory_id", "chunk_id", c.alias("_key")).where("_key is not null").distinct()
    near = chunks.select("memory_id", "chunk_id", (F.col("ordinal") + 1).alias("_key")).unionByName(chunks.select("memory_id", "chunk_id", (F.col("ordinal") - 1).alias("_key")))
    found = None
    first = W.Window.partitionBy("memory_id", "_key").orderBy("chunk_id")
    for c, priority in key.values():
        few = side(chunks, c).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).drop("_n")
        part = side(anchors, c).withColumnRenamed("chunk_id", "anchor_id").join(few, ["memory_id", "_key"]).withColumn("priority", F.lit(priority))
        found = part if found is None else found.unionByName(part)
    beside = anchors.select("memory_id", F.col("chunk_id").alias("anchor_id"), F.col("ordinal").alias("_key")).join(near, ["memory_id", "_key"]).withColumn("priority", F.lit(0.8))
    each = found.unionByName(beside).where("anchor_id <> chunk_id").groupBy("anchor_id", "chunk_id").agg(F.max("priority").alias("priority"))
    w = W.Window.partitionBy("anchor_id").orderBy(F.desc("priority"), "chunk_id")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
