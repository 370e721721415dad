"""Exact top-k by inner product: a ball tree whose upper levels deal vectors to shards, and one in each shard, by branch and bound.

A ball tree is built by splitting at the median of the widest component; a ball with centre c and radius r bounds the inner product
with q by q.c + |q| r. The upper levels are fitted to a sample of at most `SAMPLE` vectors of each length, and end in cells of about
`CELL_ROWS` vectors, at most `CELLS`; every vector is dealt to a cell, and a cell's radius is the largest distance of any of its vectors. Cells of more
than `shard_rows` vectors make several shards. In a shard, a query visits the balls in the order of the bound and stops at the first below its
current kth score. That score is shared: a query searches its own shard first, and the kth score found there goes along to the
others. A query is only sent to cells whose bound reaches it: no other cell can hold an answer.

Queries of a shard are dealt in blocks of about `block`, so that no task holds more than a shard and a block.
Components are floor(256 x) of the double x; scores are integer inner products, exact in doubles up to 2**53 and in Python
integers beyond, clipped to 64 bits.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor rows without vec_id; a query's own
row is every row with its id; repeated rows are candidates each; a repeated query row is answered once; vectors meet only vectors
of the same length; a query without candidates has no rows. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import small_batches, spool

K, EVERY, SHARD_ROWS, LEAF, BLOCK = 5, 50, 16384, 128, 32768
SAMPLE, CELL_ROWS, CELLS = 4096, 2048, 512


def balls(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a ball tree over x."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) > leaf and x.shape[1] else np.zeros(1)
        if len(rows) <= leaf or not spread.max() > 0:
            out.append(rows)
            continue
        axis = int(spread.argmax())
        half = np.argpartition(x[rows, axis], len(rows) // 2)
        todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return out


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return q @ x.T
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = np.empty((len(q), len(x)), object)
    for i, u in enumerate(q):
        for j, v in enumerate(x):
            out[i, j] = clip(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))
    return out


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and score of the k best rows of x for each q, leaving out what cannot reach kth."""
    leaves = balls(x)
    centre = np.array([x[r].mean(axis=0) for r in leaves])
    radius = np.array([np.sqrt(((x[r] - c) ** 2).sum(axis=1).max()) for r, c in zip(leaves, centre, strict=True)])
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    exact = top < 2**53
    bound = q @ centre.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius[None, :]
    bound += 1e-9 * np.abs(bound) + 1e-6
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf) if exact else np.full((len(q), k), -(1 << 70), object)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    kth = kth.astype(float).copy()
    active = np.arange(len(q))
    for step in range(len(leaves)):
        at = order[active, step]
        active = active[go := bound[active, at] >= kth[active]]
        at = at[go]
        if not len(active):
            break
        by = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(at[by]) != 0))
        for a, z in zip(cut, np.append(cut[1:], len(by)), strict=True):
            qs, rows = active[by[a:z]], leaves[at[by[a]]]
            s = _scores(q[qs], x[rows], exact)
            s[qids[qs][:, None] == ids[rows][None, :]] = -np.inf if exact else -(1 << 70)
            score = np.concatenate([best[qs], s], axis=1)
            name = np.concatenate([who[qs], np.broadcast_to(ids[rows], s.shape)], axis=1)
            pick = np.lexsort((name, -score), axis=1)[:, :k] if exact else np.array([sorted(range(len(r)), key=lambda i: (-r[i], w[i]))[:k] for r, w in zip(score, name, strict=True)])  # noqa: B023
            best[qs], who[qs] = np.take_along_axis(score, pick, 1), np.take_along_axis(name, pick, 1)
            kth[qs] = np.maximum(kth[qs], best[qs, k - 1].astype(float))
    hit = best > (-np.inf if exact else -(1 << 70))
    row, col = np.nonzero(hit)
    return row, who[row, col], best[row, col].astype(np.int64)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Cells:
    """The upper levels of the tree over vectors of one length: splits, and the balls of the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.down = [], [], []  # of each split; down: the next split if not negative, else the cell -1 - down
        self.centre: list[np.ndarray] = []
        size = max(1, ceil(len(sample) / max(1, cells)))
        todo = [(np.arange(len(sample)), None)]
        while todo:
            rows, above = todo.pop()
            spread = np.ptp(sample[rows], axis=0) if len(rows) > size and sample.shape[1] else np.zeros(1)
            here = len(self.axis) if spread.max() > 0 else -1 - len(self.centre)
            if above:
                self.down[above[0]][above[1]] = here
            if here < 0:
                self.centre.append(sample[rows].mean(axis=0))
                continue
            axis = int(spread.argmax())
            x = sample[rows, axis]
            cut = float(np.median(x))
            cut = cut if cut < x.max() else float(x[x < x.max()].max())
            self.axis.append(axis)
            self.cut.append(cut)
            self.down.append([0, 0])
            todo += [(rows[x > cut], (here, 1)), (rows[x <= cut], (here, 0))]
        self.radius = np.zeros(len(self.centre))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and its distance from the centre."""
        at = np.zeros(len(x), np.int64) if self.axis else np.full(len(x), -1)
        axis, cut, down = np.array(self.axis, np.int64), np.array(self.cut), np.array(self.down, np.int64).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            at[inner] = down[k, (x[inner, axis[k]] > cut[k]).astype(np.int64)]
        cell = -1 - at
        return cell, np.sqrt(((x - np.array(self.centre)[cell]) ** 2).sum(axis=1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of each query and cell: no inner product is larger."""
        bound = q @ np.array(self.centre).T + np.sqrt((q**2).sum(axis=1))[:, None] * self.radius[None, :]
        return bound + 1e-9 * np.abs(bound) + 1e-6


def _deal(trees: dict[int, Cells]):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("dim", pa.int32()), ("cell", pa.int32()), ("away", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                cell, away = trees[dim].place(_matrix(own.column("v")))
                yield pa.record_batch([own.column("vec_id"), own.column("v"), own.column("dim"), pa.array(cell.astype(np.int32)), pa.array(away)], schema=schema)

    return run


def _send(trees: dict[int, Cells], shards: dict[tuple[int, int], int]):
    """Queries with the shards, other than their own, that can hold an answer."""
    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int64()), ("part", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("kth", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, kth = b.column("dim").to_numpy(), np.nan_to_num(b.column("kth").to_numpy(zero_copy_only=False), nan=-np.inf)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                many = np.array([shards.get((dim, c), 0) for c in range(len(trees[dim].centre))], np.int64)
                for i in range(0, len(rows), 1024):
                    own = b.take(pa.array(rows[i : i + 1024]))
                    who, cell = np.nonzero(trees[dim].bounds(_matrix(own.column("v"))) >= kth[rows[i : i + 1024]][:, None])
                    n = many[cell]
                    who, cell, shard = np.repeat(who, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    other = (cell != own.column("cell").to_numpy()[who]) | (shard != own.column("shard").to_numpy()[who])
                    who, cell, shard = who[other], cell[other], shard[other]
                    for k in range(0, len(who), 8192):
                        w = own.take(pa.array(who[k : k + 8192]))
                        yield pa.record_batch([w.column("dim"), pa.array(cell[k : k + 8192].astype(np.int32)), pa.array(shard[k : k + 8192]), w.column("part"), w.column("vec_id"), w.column("v"), pa.array(kth[rows[i : i + 1024]][who[k : k + 8192]])], schema=schema)

    return run


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        if not (x.num_rows and q.num_rows):
            return schema.empty_table()
        qids, kth = q.column("qvec").to_numpy(), np.nan_to_num(q.column("kth").to_numpy(), nan=-np.inf)
        row, ids, score = search(x.column("vec_id").to_numpy(), _matrix(x.column("v")), qids, _matrix(q.column("qv")), kth, k)
        return pa.table([qids[row], ids, score], schema=schema)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of floor(256 x)), of rows that take part."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("v"))


def _fit(v: DataFrame, sizes: dict[int, int], sample: int, cell_rows: int) -> dict[int, Cells]:
    """The upper levels for each length, from at most `sample` vectors of it, the first by a hash of their ids."""
    first = W.Window.partitionBy("dim").orderBy("_hash", "vec_id", "v")
    rows = v.withColumn("_hash", F.xxhash64("vec_id")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample).select("dim", "v").toArrow()
    dims = rows.column("dim").to_numpy()
    return {d: Cells(_matrix(rows.filter(pa.array(dims == d)).column("v")), min(CELLS, ceil(n / cell_rows))) for d, n in sizes.items()}


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block: int = BLOCK, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; queries are the rows whose vec_id is divisible by `every`.

    The driver holds the sample, and a row for each length and cell.
    """
    small_batches(vectors.sparkSession)
    v = quantised(vectors).withColumn("dim", F.size("v"))
    sizes = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees = _fit(v, sizes, sample, cell_rows)
    dealt = spool(v.select("vec_id", "v", "dim").mapInArrow(_deal(trees), "vec_id long, v array<long>, dim int, cell int, away double"), "dealt")
    found = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()
    shards = {(r["dim"], r["cell"]): max(1, ceil(r["n"] / shard_rows)) for r in found}
    for r in found:
        trees[r["dim"]].radius[r["cell"]] = r["r"]
    queries_of: dict[int, int] = {}
    for r in found:
        queries_of[r["dim"]] = queries_of.get(r["dim"], 0) + r["q"]
    blocks = vectors.sparkSession.createDataFrame([(d, c, n, max(1, ceil(queries_of[d] / block))) for (d, c), n in shards.items()], "dim int, cell int, shards long, parts long")
    v = dealt.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    queries = v.where(F.col("vec_id") % every == 0).select("dim", "cell", "shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).alias("part"), "vec_id", "v").dropDuplicates(["vec_id", "v"])

    def meet(side: DataFrame) -> DataFrame:
        """Shards and the blocks of queries that were sent to them."""
        keys = ["dim", "cell", "shard", "part"]
        wanted = side.select(*keys).distinct()
        return v.select("dim", "cell", "shard", "vec_id", "v").join(wanted, ["dim", "cell", "shard"]).groupBy(*keys).cogroup(side.toDF("qdim", "qcell", "qshard", "qpart", "qvec", "qv", "kth").groupBy("qdim", "qcell", "qshard", "qpart")).applyInArrow(_search(k), _FOUND)

    home = spool(meet(queries.withColumn("kth", F.lit(float("-inf")))), "home")
    kth = _ranked(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    sent = spool(queries.join(kth, "vec_id", "left").select("dim", "cell", "shard", "part", "vec_id", "v", "kth").mapInArrow(_send(trees, shards), "dim int, cell int, shard long, part long, vec_id long, v array<long>, kth double"), "sent")
    return _ranked(home.unionByName(meet(sent)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
