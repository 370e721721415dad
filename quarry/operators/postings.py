"""A stored inverted index with positions, and top-k search over it with block maxima.

The task that reads chunks deals them to shards by their length, so that those with many occurrences stand together, and writes the shards without a
shuffle. A row of the index is the block of one term in one shard: which chunks (ordinals in the shard, by chunk_id), how often, where, and the largest count. Rows lie in
folders by a hash of the term, sorted by term, so that a search reads the folders of its own terms, and no positions unless a chunk holds all words of an alternative.

A search of a block of queries runs in three steps:
1. Block maxima bound what any chunk of a shard can score for a query. The SEEDS shards with the highest bounds are scored first; a query's kth score there is its threshold.
2. Of the other shards, only those whose bound reaches the threshold are scored.
3. Cover density is computed, from positions, in shards with chunks that hold an alternative whole and whose bound reaches the kth score. No step gives more than
   2 k rows for a query and shard, however many copies of a chunk there are.
Nothing that could be among the k best is left out: bounds are compared after rounding, as scores are.

Chunks are added by further shards, without a rebuild.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.functions import text as T
from quarry.functions import websearch
from quarry.operators import retrieval

#: A shard ends at so many chunks or tokens; fewer tokens where a table is small, so that all cores have shards. A task holds two shards' tokens at most.
SHARD_CHUNKS, SHARD_TOKENS, LEAST_TOKENS = 16_384, 1 << 19, 1 << 15
#: Folders by term. Each task that writes has a file in each, so large tables are best read in large parts (spark.sql.files.maxPartitionBytes).
BUCKETS = 16
SEEDS, BLOCK = 2, 256
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
IDS, ALLOWED = -1, -2  # rows of a shard that are no postings


# --- building ---

_ROW = pa.schema([("term", pa.string()), ("shard", pa.int64()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("most", pa.int32()), ("ids", pa.list_(pa.int64()))])
_ROW_SQL = "term string, shard long, docs array<int>, tfs array<int>, positions array<int>, most int, ids array<long>"


def _blocks_of(shard: int, ids: np.ndarray, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: the chunk ids by ordinal, and the terms' blocks."""
    order = np.argsort(ids, kind="stable")
    tokens = tokens.take(pa.array(order))
    many = np.diff(tokens.offsets.to_numpy())
    nothing = pa.array([None], pa.list_(pa.int32()))
    yield pa.record_batch([pa.array([""]), pa.array([shard]), nothing, nothing, nothing, pa.array([0], pa.int32()), pa.array([ids[order].tolist()], pa.list_(pa.int64()))], schema=_ROW)
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    if not len(code):
        return
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), many)
    at = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(many) - many).astype(np.int32), many)
    by = np.argsort(code, kind="stable")  # by term, then chunk, then position
    code, doc, at = code[by], doc[by], at[by]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
    tfs, docs, of = np.diff(np.append(new, len(code))).astype(np.int32), doc[new], code[new]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    edge = np.append(first, len(of)).astype(np.int32)
    where = np.append(new[first], len(code)).astype(np.int32)
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    n = len(first)
    columns = [coded.dictionary.take(pa.array(of[first])), pa.array(np.full(n, shard)), lists(edge, docs), lists(edge, tfs), lists(where, at), pa.array(np.maximum.reduceat(tfs, first)), pa.nulls(n, pa.list_(pa.int64()))]
    whole = pa.record_batch(columns, schema=_ROW)
    yield from (whole.slice(i, 4096) for i in range(0, n, 4096))


class _Class:
    """Chunks of about the same length that wait for their shard to be full."""

    def __init__(self):
        self.held, self.chunks, self.tokens = [], 0, 0

    def add(self, rows: pa.RecordBatch, tokens: int) -> None:
        self.held.append(rows)
        self.chunks, self.tokens = self.chunks + rows.num_rows, self.tokens + tokens


def _shards(most_chunks: int, most_tokens: int, base: int):
    """Blocks of the shards of a task: chunks are gathered by the power of two of their length, and what is left over at the end by falling length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, n, classes = base + (TaskContext.get().partitionId() << 24), 0, {}

        def flush(some: list[_Class]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            both = pa.Table.from_batches([h for c in some for h in c.held]).combine_chunks()
            n += 1
            yield from _blocks_of(first + n, both.column("chunk_id").to_numpy(), both.column("tokens").combine_chunks())

        for b in batches:
            many = np.diff(b.column("tokens").offsets.to_numpy())
            power = np.frexp(many.astype(float))[1]
            for c in np.unique(power).tolist():
                at = np.flatnonzero(power == c)
                rows, size, start = b.take(pa.array(at)), np.cumsum(many[at]), 0
                while start < len(at):
                    own = classes.setdefault(c, _Class())
                    gone = size[start - 1] if start else 0
                    end = max(start + 1, min(int(np.searchsorted(size, gone + most_tokens - own.tokens, "right")), start + most_chunks - own.chunks))
                    end = min(end, len(at))
                    own.add(rows.slice(start, end - start), int(size[end - 1] - gone))
                    start = end
                    if own.chunks >= most_chunks or own.tokens >= most_tokens or end < len(at):
                        yield from flush([classes.pop(c)])
            while classes and sum(c.tokens for c in classes.values()) > 2 * most_tokens:
                yield from flush([classes.pop(max(classes, key=lambda c: classes[c].tokens))])
        rest: list[_Class] = []
        for c in sorted(classes, reverse=True):
            rest.append(classes[c])
            if sum(x.tokens for x in rest) >= most_tokens or sum(x.chunks for x in rest) >= most_chunks:
                yield from flush(rest)
                rest = []
        if rest:
            yield from flush(rest)
        classes.clear()
        _give_back()

    return run


def _give_back() -> None:
    """Unused memory of a worker, which other kinds of tasks run in after this one, goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- what a block of queries asks ---


@dataclass
class Asked:
    """A block of queries: terms by number, and for each term who asks for it."""

    ids: list[int]
    k: np.ndarray
    terms: dict[str, int]
    latin: list[list[int]]  # of each query, term numbers
    han: list[list[int]]
    required: list[list[list[int]]]  # of each query and alternative
    units: list[list[tuple[int, bool, list[int]]]]
    least: int

    @staticmethod
    def of(rows, k: str | int, least: int) -> Asked:
        terms: dict[str, int] = {}
        number = lambda ts: [terms.setdefault(t, len(terms)) for t in ts]
        out = Asked([], np.zeros(0, np.int64), terms, [], [], [], [], least)
        limits = []
        for r in rows:
            out.ids.append(r["query_id"])
            limits.append(int(r["_k"]) if isinstance(k, str) else k)
            out.latin.append(number(r["latin"]))
            out.han.append(number(r["han"]))
            units = [(u["alternative"], u["excluded"], number(u["terms"])) for u in r["units"]]
            asks: dict[int, dict[int, None]] = {}
            for alternative, excluded, ts in units:
                if not excluded:
                    asks.setdefault(alternative, {}).update(dict.fromkeys(ts))
            out.required.append([list(a) for a in asks.values()])
            out.units.append(units)
        out.k = np.array(limits, np.int64)
        return out

    def simple(self, q: int) -> bool:
        """Every alternative is one word and nothing is excluded: each occurrence is a cover of its own."""
        return all(not x and len(ts) == 1 for _, x, ts in self.units[q]) and all(len(a) == 1 for a in self.required[q]) and len(self.units[q]) == len(self.required[q])

    def web(self, q: int) -> list[int]:
        """Terms whose occurrences can begin a cover."""
        return list(dict.fromkeys(t for a in self.required[q] for t in a))


def _rounded(value: np.ndarray) -> np.ndarray:
    """r / (1 + r) to six digits, halves up, as the scores are rounded; each distinct value once."""
    distinct, back = np.unique(value, return_inverse=True)
    six = Decimal("0.000001")
    out = [float(Decimal(repr(float(v / (1 + v)))).quantize(six, ROUND_HALF_UP)) if v > 0 else 0.0 for v in distinct]
    return np.array(out, float)[back].reshape(value.shape)


def _bound(asked: Asked):
    """shard, q, bound: the largest score that block maxima allow."""
    schema = pa.schema([("shard", pa.int64()), ("q", pa.int32()), ("bound", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        most = np.zeros(len(asked.terms), np.int64)
        most[rows.column("t").to_numpy()] = rows.column("most").to_numpy()
        q, value = [], []
        for i in range(len(asked.ids)):
            v = 0.0
            for ts in (asked.latin[i], asked.han[i]):
                m = most[ts]
                if len(ts) and np.count_nonzero(m) >= min(asked.least, len(ts)):
                    v += 0.5 * (m.sum() * websearch.WEIGHT)
            if any(most[a].all() for a in asked.required[i]):
                v += websearch.WEIGHT * most[asked.web(i)].sum()
            if v > 0:
                q.append(i)
                value.append(v * (1 + 1e-9))
        shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
        return pa.table([np.full(len(q), shard), np.array(q, np.int32), _rounded(np.array(value))], schema=schema)

    return run


_HIT = pa.schema([("q", pa.int32()), ("shard", pa.int64()), ("chunk_id", pa.int64()), ("value", pa.float64()), ("whole", pa.bool_()), ("bound", pa.float64())])
_HIT_SQL = "q int, shard long, chunk_id long, value double, whole boolean, bound double"


def _of_shard(rows: pa.Table, t: np.ndarray) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Its number, the chunk ids by ordinal, and which of them may be in a result (None: all)."""
    at = int(np.flatnonzero(t == IDS)[0])
    ids, allowed = rows.column("ids")[at].values.to_numpy(), None
    if rows.column("limited")[at].as_py():
        allowed = np.zeros(len(ids), bool)
        for i in np.flatnonzero(t == ALLOWED):
            allowed[rows.column("docs")[int(i)].values.to_numpy()] = True
    return rows.column("shard")[at].as_py(), ids, allowed


def _score(asked: Asked):
    """Of one shard, each wanted query's k best chunks by what is known without positions: those that hold no alternative whole, which are settled, and those
    that do, whose values are the least they can have; with these, the most that any of them can have."""
    askers: dict[str, dict[int, list[int]]] = {"latin": {}, "han": {}}
    for kind, of in askers.items():
        for i, ts in enumerate(getattr(asked, kind)):
            for t in ts:
                of.setdefault(t, []).append(i)
    needs: dict[int, list[tuple[int, int]]] = {}
    for i, alternatives in enumerate(asked.required):
        for a, ts in enumerate(alternatives):
            for t in ts:
                needs.setdefault(t, []).append((i, a))

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        t = rows.column("t").to_numpy()
        if not pairs.num_rows or not (t == IDS).any():
            return _HIT.empty_table()
        shard, ids, allowed = _of_shard(rows, t)
        lists = {int(t[i]): (rows.column("docs")[int(i)].values.to_numpy(), rows.column("tfs")[int(i)].values.to_numpy()) for i in np.flatnonzero(t >= 0)}
        out = []
        wanted = np.unique(pairs.column("q").to_numpy())
        for s in range(0, len(wanted), 64):
            qs = wanted[s : s + 64]
            row = {int(q): i for i, q in enumerate(qs)}
            occ, met = ({k: np.zeros((len(qs), len(ids)), d) for k in ("latin", "han")} for d in (np.int32, np.int16))
            have = {(q, a): np.zeros(len(ids), np.int16) for q in row for a in range(len(asked.required[q])) if all(x in lists for x in asked.required[q][a])}
            for term, (docs, tfs) in lists.items():
                for kind, of in askers.items():
                    own = [row[q] for q in of.get(term, ()) if q in row]
                    if own:
                        cell = np.ix_(own, docs)
                        occ[kind][cell] += tfs
                        met[kind][cell] += 1
                for pair in needs.get(term, ()):
                    if pair in have:
                        have[pair][docs] += 1
            for q, i in row.items():
                value, match = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for kind, n in (("latin", len(asked.latin[q])), ("han", len(asked.han[q]))):
                    fine = met[kind][i] >= max(1, min(asked.least, n)) if n else np.zeros(len(ids), bool)
                    value += np.where(fine, 0.5 * (occ[kind][i] * websearch.WEIGHT), 0.0)
                    match |= fine
                whole = np.zeros(len(ids), bool)
                for a, ts in enumerate(asked.required[q]):
                    if (q, a) in have:
                        whole |= have[q, a] == len(ts)
                match |= whole
                if allowed is not None:
                    match, whole = match & allowed, whole & allowed
                if not match.any():
                    continue
                entries = np.zeros(len(ids), np.int64)
                if whole.any():
                    for x in asked.web(q):
                        if x in lists:
                            entries[lists[x][0]] += lists[x][1]
                if asked.simple(q):
                    value = np.where(whole, websearch.WEIGHT * entries + value, value)
                    whole[:] = False
                k = int(asked.k[q])
                for flag, which in ((False, np.flatnonzero(match & ~whole)), (True, np.flatnonzero(whole))):
                    low = _rounded(value[which])
                    d = which[np.lexsort((which, -low))[:k]]
                    if len(d):
                        high = _high(value[which], entries[which]).max() if flag else 0.0
                        out.append(pa.record_batch([np.full(len(d), q, np.int32), np.full(len(d), shard), ids[d], value[d], np.full(len(d), flag), np.full(len(d), high)], schema=_HIT))
        _give_back()
        return pa.Table.from_batches(out, schema=_HIT)

    return run


def _high(value: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The largest score that so many occurrences of words that begin covers allow."""
    return _rounded((websearch.WEIGHT * entries + value) * (1 + 1e-9))


def _density(asked: Asked):
    """Of one shard, each wanted query's best chunks among those that hold an alternative, with their cover density from positions.

    Chunks with the same positions, such as copies, are worked out once.
    """

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        t = rows.column("t").to_numpy()
        if not pairs.num_rows or not (t == IDS).any():
            return _HIT.empty_table()
        shard, ids, allowed = _of_shard(rows, t)
        lists = {}
        for i in np.flatnonzero(t >= 0).tolist():
            tfs = rows.column("tfs")[i].values.to_numpy()
            lists[int(t[i])] = (rows.column("docs")[i].values.to_numpy(), tfs, np.append(0, np.cumsum(tfs)), rows.column("positions")[i].values.to_numpy())
        out = []
        for q, least in zip(pairs.column("q").to_pylist(), pairs.column("least").to_pylist(), strict=True):
            whole = np.zeros(len(ids), bool)
            for ts in asked.required[q]:
                if all(x in lists for x in ts):
                    have = np.zeros(len(ids), np.int32)
                    for x in ts:
                        have[lists[x][0]] += 1
                    whole |= have == len(ts)
            d = np.flatnonzero(whole if allowed is None else whole & allowed)
            value, entries = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for ts in (asked.latin[q], asked.han[q]):
                occ, met = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
                for x in ts:
                    if x in lists:
                        occ[lists[x][0]] += lists[x][1]
                        met[lists[x][0]] += 1
                if ts:
                    value += np.where(met >= max(1, min(asked.least, len(ts))), 0.5 * (occ * websearch.WEIGHT), 0.0)
            for x in asked.web(q):
                if x in lists:
                    entries[lists[x][0]] += lists[x][1]
            d = d[_high(value[d], entries[d]) >= least]
            total, known = np.full(len(d), np.nan), {}
            named = sorted({x for _, _, ts in asked.units[q] for x in ts if x in lists})
            for n, doc in enumerate(d.tolist()):
                at = {}
                for x in named:
                    docs, _, edge, positions = lists[x]
                    i = int(np.searchsorted(docs, doc))
                    if i < len(docs) and docs[i] == doc:
                        at[x] = positions[edge[i] : edge[i + 1]]
                key = tuple((x, p.tobytes()) for x, p in at.items())
                if key not in known:
                    known[key] = websearch.cover_density(asked.units[q], at)
                if known[key] is not None:
                    total[n] = known[key] + value[doc]
                elif value[doc] > 0:
                    total[n] = value[doc]
            d, total = d[~np.isnan(total)], total[~np.isnan(total)]
            pick = np.lexsort((d, -_rounded(total)))[: int(asked.k[q])]
            d, total = d[pick], total[pick]
            out.append(pa.record_batch([np.full(len(d), q, np.int32), np.full(len(d), shard), ids[d], total, np.ones(len(d), bool), np.zeros(len(d))], schema=_HIT))
        _give_back()
        return pa.Table.from_batches(out, schema=_HIT)

    return run


# --- the index ---


@dataclass(frozen=True)
class Stored:
    """An index at a path."""

    path: str
    buckets: int

    @staticmethod
    def build(chunks: DataFrame, path: str, shard_chunks: int = SHARD_CHUNKS, shard_tokens: int | None = None) -> Stored:
        """chunks: chunk_id (each once), content. A null content is in no result."""
        spark = chunks.sparkSession
        size = chunks.agg(F.sum(F.length("content"))).first()[0] or 0
        out = Stored(path, BUCKETS)
        spark.createDataFrame([(out.buckets,)], "buckets long").coalesce(1).write.parquet(f"{path}/meta")
        out._write(chunks, size, shard_chunks, shard_tokens, 0)
        return out

    @staticmethod
    def open(spark: SparkSession, path: str) -> Stored:
        return Stored(path, spark.read.parquet(f"{path}/meta").first()["buckets"])

    def insert(self, chunks: DataFrame) -> None:
        """Adds chunks, whose ids are new, as further shards."""
        last = self.table(chunks.sparkSession).where("bucket = -1").agg(F.max("shard")).first()[0]
        self._write(chunks, chunks.agg(F.sum(F.length("content"))).first()[0] or 0, SHARD_CHUNKS, None, ((last >> 48) + 1) << 48 if last is not None else 0)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_ROW_SQL}, bucket int").parquet(f"{self.path}/postings")

    def _write(self, chunks: DataFrame, size: int, shard_chunks: int, shard_tokens: int | None, base: int) -> None:
        spark = chunks.sparkSession
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        shard_tokens = shard_tokens or min(SHARD_TOKENS, max(LEAST_TOKENS, size // 6 // (2 * parts)))
        rows = chunks.where("content is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "content")
        if rows.rdd.getNumPartitions() < parts:  # a small table in few files: all cores are to work
            rows = rows.repartition(parts)
        words = F.concat(T.tokens(F.col("content")), T.cjk_occurrences(F.col("content")))
        made = rows.select("chunk_id", words.alias("tokens")).mapInArrow(_shards(shard_chunks, shard_tokens, base), _ROW_SQL)
        bucket = F.when(F.col("term") == "", -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        was = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, str(2 << 20))  # tokens take several times their bytes in a worker
        try:
            self._append(made.withColumn("bucket", bucket))
        finally:
            spark.conf.set(_BATCH, was)

    def _append(self, rows: DataFrame) -> None:
        rows.sortWithinPartitions("bucket", "term", "shard").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")

    # --- searching ---

    def search(self, queries: DataFrame, k: int | str = 10, least: int = 2, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank: as retrieval.lexical(), over the stored chunks. allowed: chunk_id of those that may be in a result."""
        spark = queries.sparkSession
        text = T.sanitise_query(F.col("query"))
        more = [F.col(k).alias("_k")] if isinstance(k, str) else []
        queries = queries.where("query is not null")  # they only make blocks
        parsed = queries.select("query_id", T.query_terms(text).alias("latin"), websearch.parse(text).alias("units"), T.cjk_bigrams(text).alias("han"), *more).where("latin is not null")
        blocks = -(-queries.count() // BLOCK)
        limits = self._ordinals(spark, allowed) if allowed is not None else None
        out = None
        for b in range(blocks):
            rows = parsed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if not rows:
                continue
            found = self._block(spark, Asked.of(rows, k, least), limits)
            out = found if out is None else out.unionByName(found)
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int") if out is None else out

    def _ordinals(self, spark: SparkSession, allowed: DataFrame) -> DataFrame:
        """shard, docs: the ordinals of the allowed chunks."""
        each = self.table(spark).where("bucket = -1").select("shard", F.posexplode("ids").alias("at", "chunk_id"))
        own = each.join(allowed.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
        return session.cut(own.groupBy("shard").agg(F.sort_array(F.collect_list("at")).alias("docs")))

    def _block(self, spark: SparkSession, asked: Asked, limits: DataFrame | None) -> DataFrame:
        table = self.table(spark)

        def postings_of(terms: dict[str, int]) -> DataFrame:
            """The blocks of these terms, from the folders that hold them."""
            bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")
            wanted = spark.createDataFrame(list(terms.items()) or [("", 0)], "term string, t int").select("term", "t", bucket)
            folders = sorted({r["bucket"] for r in wanted.select("bucket").collect()})
            return table.where(F.col("bucket").isin(folders)).join(F.broadcast(wanted), ["bucket", "term"])

        def per_query(values, kind: str) -> Column:
            """The value of each query, by q."""
            return F.expr(f"element_at(array({', '.join(f'cast({v!r} as {kind})' for v in values)}), q + 1)")

        limit = per_query(asked.k.tolist(), "int")
        met = postings_of(asked.terms)
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # given as a number, so that few bytes are not put into few tasks
        bounds = session.cut(met.select("t", "shard", "most").repartition(parts, "shard").groupBy("shard").applyInArrow(_bound(asked), "shard long, q int, bound double"))
        w = retrieval.W.Window.partitionBy("q").orderBy(F.desc("bound"), "shard")
        ranked = bounds.withColumn("_n", F.row_number().over(w))

        def side(pairs: DataFrame, few: bool, positions: bool = False, terms: set[int] | None = None) -> DataFrame:
            """The postings of the shards that pairs name, their chunk ids, and the ordinals that are allowed. few: there are at most BLOCK * SEEDS of them."""
            shards = pairs.select("shard").distinct()
            shards = F.broadcast(shards) if few else retrieval.small(shards)
            own = met if terms is None else postings_of({t: n for t, n in asked.terms.items() if n in terms})
            held = F.col("positions") if positions else F.lit(None).cast("array<int>").alias("positions")
            no = lambda kind: F.lit(None).cast(kind)
            limited = F.lit(limits is not None).alias("limited")
            out = own.select("shard", "t", "docs", "tfs", held, no("array<long>").alias("ids"), limited)
            out = out.unionByName(table.where("bucket = -1").select("shard", F.lit(IDS).alias("t"), no("array<int>").alias("docs"), no("array<int>").alias("tfs"), no("array<int>").alias("positions"), "ids", limited))
            if limits is not None:
                out = out.unionByName(limits.select("shard", F.lit(ALLOWED).alias("t"), "docs", no("array<int>").alias("tfs"), no("array<int>").alias("positions"), no("array<long>").alias("ids"), limited))
            return out.join(shards, "shard", "left_semi")

        def meet(run, pairs: DataFrame, few: bool = False, positions: bool = False, terms: set[int] | None = None) -> DataFrame:
            right = pairs.withColumnRenamed("shard", "in_shard")
            left = side(pairs, few, positions, terms).repartition(parts, "shard").groupBy("shard")
            return session.cut(left.cogroup(right.repartition(parts, "in_shard").groupBy("in_shard")).applyInArrow(run, _HIT_SQL))

        def kth(hits: DataFrame, score: str) -> dict[int, float]:
            """Of each query with k hits, the rounded value of the kth."""
            n = F.row_number().over(retrieval.W.Window.partitionBy("q").orderBy(F.desc(score), "chunk_id"))
            found = hits.withColumn("_n", n).where(F.col("_n") == limit).select("q", score).collect()
            values = _rounded(np.array([r[score] for r in found], float)) if found else []
            return {r["q"]: float(v) for r, v in zip(found, values, strict=True)}

        def reach(rows: DataFrame, least: dict[int, float]) -> DataFrame:
            return rows.where(F.col("bound") >= per_query([least.get(i, -1.0) for i in range(len(asked.ids))], "double"))

        hits = meet(_score(asked), ranked.where(F.col("_n") <= SEEDS).select("shard", "q"), few=True)
        rest = reach(ranked.where(F.col("_n") > SEEDS), kth(hits, "value"))
        hits = hits.unionByName(meet(_score(asked), rest.select("shard", "q")))
        least = kth(hits, "value")
        whole = session.cut(reach(hits.where("whole"), least).select("shard", "q").distinct().withColumn("least", per_query([least.get(i, -1.0) for i in range(len(asked.ids))], "double")))
        names = sorted(r["q"] for r in whole.groupBy("q").count().collect())
        final = hits.where("not whole")
        if names:
            terms = {x for q in names for x in (*asked.latin[q], *asked.han[q], *(y for _, _, ts in asked.units[q] for y in ts))}
            final = final.unionByName(meet(_density(asked), whole, positions=True, terms=terms))
        ids = per_query(asked.ids, "long")
        scored = final.select(ids.alias("query_id"), "chunk_id", F.round(T.normalised_score(F.col("value")), 6).alias("score"), limit.alias("_k"))
        return retrieval.top(scored, F.col("_k")).select("query_id", "chunk_id", "score", "rank")
