"""A stored inverted file over unit vectors: fine cells, kept as a partitioned table that a search prunes and an insert appends to.

Layout under a path:
  centres/   cell, part, centre: the fine cells, and the part (partition folder) that each lies in; near cells share a part
  cells/     chunk_id, embedding, cell, away (distance from the centre), written by part and sorted by cell; each insert appends files
A search ranks the centres for each query on the driver's bounded table of centres, reads only the parts that hold a wanted cell, and compares a query
only with the vectors of its own cells. `exact` goes on, after the nearest cells, to every cell that can still hold an answer: by the triangle inequality,
no vector of a cell is nearer than the centre less the cell's radius.

Bounds: centres are fitted to at most `sample` vectors, so that their number is bounded whatever the number of rows; a part's vectors are dealt to tasks by salts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval

SAMPLE, MOST_CELLS, PARTS, ROUNDS = 8192, 2048, 16, 10
#: The share of cells that a search reads at first; doubled with each attempt of an over-fetch.
PROBES = 0.24
#: Queries are ranked and sent in blocks of this many.
BLOCK = 1024
#: Vectors of a cell that meet its queries at once, and rows that a task gathers, beside the k best of each query of a block, before it keeps only these.
TILE, HELD = 1024, 1 << 18
#: An exact search asks of this many queries how many cells they need; where they need more than this share, cells exclude too little to be worth a pass for each block.
TRIED, WORTH = 64, 0.5


def _kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _dealt(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector, the nearest centre and the distance from it; TILE vectors meet the centres at once, however many a batch has."""
    cell, away = np.zeros(len(x), int), np.zeros(len(x))
    for a in range(0, len(x), TILE):
        near = x[a : a + TILE] @ centres.T
        cell[a : a + TILE] = own = near.argmax(axis=1)
        away[a : a + TILE] = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(own)), own]))
    return cell, away


def _valid(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & fine).select("chunk_id", "embedding")


def _first(rows: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best of each query, in their order."""
    got = pd.concat(rows).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return got[got.groupby("query_id").cumcount() < k]


@dataclass(frozen=True)
class Stored:
    """An index at a path, with its centres, which are few, in memory."""

    path: str
    centres: np.ndarray
    part: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")

    # --- writing ---

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Stored:
        """Fits the cells to at most `sample` vectors, the first by a hash of their ids, and writes every vector."""
        rows = _valid(vectors)
        own = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toPandas()["embedding"]
        x = retrieval._unit(own, False) if len(own) else np.zeros((0, 0))
        centres = _kmeans(x, min(cells or MOST_CELLS, max(1, len(x) // 3))) if len(x) else x
        coarse = _kmeans(centres, min(PARTS, len(centres))) if len(centres) else centres
        part = (centres @ coarse.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
        spark = vectors.sparkSession
        spark.createDataFrame([(i, int(p), c.tolist()) for i, (p, c) in enumerate(zip(part, centres, strict=True))], "cell int, part int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        out = Stored(path, centres, part)
        out.insert(vectors)
        return out

    @staticmethod
    def open(spark: SparkSession, path: str) -> Stored:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()
        return Stored(path, np.array(rows["centre"].tolist(), float).reshape(len(rows), -1), rows["part"].to_numpy(int))

    def insert(self, vectors: DataFrame) -> None:
        """Appends vectors to their cells; centres stay as they are. A repeated job appends again: ids are the caller's to keep apart."""
        rows = _valid(vectors)
        centres, part = self.centres, self.part
        schema = rows.schema

        def run(batches):
            for pdf in batches:
                cell, away = _dealt(retrieval._unit(pdf["embedding"], False), centres)
                yield pdf.assign(cell=cell.astype(np.int32), away=away, part=part[cell].astype(np.int32))

        dealt = rows.mapInPandas(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema), "cell int, away double, part int"]))
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTS)))
        dealt.repartition("part", salt).sortWithinPartitions("part", "cell", "chunk_id").write.mode("append").partitionBy("part").parquet(f"{self.path}/cells")

    # --- searching ---

    def search(self, queries: DataFrame, k: int, probes: float = PROBES, exact: bool = False, half: bool = True) -> DataFrame:
        """query_id, chunk_id, score, rank, compared: the k best of each query's nearest cells, and how many vectors it was compared with.

        probes: the share of the cells. exact: the k best of all, by the cells where these exclude enough, else by products of large blocks of queries with all
        vectors. half: distances between vectors narrowed to half precision.
        """
        spark = queries.sparkSession
        out = None
        if exact and len(self.centres) and self._needed(spark, queries, probes, k, half) > WORTH:
            every = self.table(spark).select("chunk_id", "embedding")
            asked = queries.where("query_vector is not null").select("query_id", "query_vector")
            return retrieval.vector(every, asked, k, half=half).withColumn("compared", F.lit(every.count()).cast("long"))
        for rows in _blocks(queries):
            near = self._search(spark, rows, self._wanted(rows, probes), k, half)
            if exact and len(self.centres):
                near = self._complete(spark, rows, near, probes, k, half)
            out = near if out is None else out.unionByName(near)
        if out is None:
            return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int, compared long")
        return out

    def _near(self, rows: pd.DataFrame) -> np.ndarray:
        return retrieval._unit(rows["query_vector"], False) @ self.centres.T

    def _wanted(self, rows: pd.DataFrame, probes: float) -> list[np.ndarray]:
        n = min(len(self.centres), max(1, int(probes * len(self.centres))))
        return list(np.argsort(-self._near(rows), axis=1, kind="stable")[:, :n]) if n else [np.zeros(0, int)] * len(rows)

    def _search(self, spark: SparkSession, rows: pd.DataFrame, wanted: list[np.ndarray], k: int, half: bool) -> DataFrame:
        """Queries meet the parts of their cells; what is broadcast is a block of queries with the numbers of their cells."""
        empty = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int, compared long")
        if not len(self.centres) or not any(map(len, wanted)):
            return empty
        parts = sorted({int(p) for w in wanted for p in np.unique(self.part[w])})
        asks: dict[int, list[int]] = {}
        for i, w in enumerate(wanted):
            for c in w.tolist():
                asks.setdefault(c, []).append(i)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), retrieval._unit(rows["query_vector"], half), {c: np.array(q) for c, q in asks.items()}))

        def run(batches):
            ids, q, of = shared.value
            best, held, seen = [], 0, np.zeros(len(ids), np.int64)
            for pdf in batches:
                cells, x, chunk = pdf["cell"].to_numpy(), retrieval._unit(pdf["embedding"], half), pdf["chunk_id"].to_numpy()
                order = np.argsort(cells, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(cells[order])) + 1, len(order))
                for a, z in zip(np.append(0, ends[:-1]), ends, strict=True):
                    if z > a and (who := of.get(int(cells[order[a]]))) is not None:
                        at = order[a:z]
                        for b in range(0, len(at), TILE):
                            best.append(retrieval._nearest(chunk[at[b : b + TILE]], x[at[b : b + TILE]], who, q[who], k))
                            held += len(best[-1])
                            if held > HELD + len(ids) * k:
                                best, held = (kept := [_first(best, k)]), len(kept[0])
                        seen[who] += len(at)
            if best:
                got = _first(best, k)
                first = ~got["query_id"].duplicated()
                out = got.assign(compared=np.where(first, seen[got["query_id"]], 0), query_id=ids[got["query_id"]])[["query_id", "chunk_id", "score", "compared"]]
                yield from (out[i : i + (1 << 16)] for i in range(0, len(out), 1 << 16))

        table = self.table(spark).where(F.col("part").isin(parts)).select("chunk_id", "embedding", "cell")
        found = table.mapInPandas(run, "query_id long, chunk_id long, score double, compared long")
        w = retrieval.W.Window.partitionBy("query_id")
        counted = found.withColumn("compared", F.sum("compared").over(w))
        return retrieval.top(counted, k).select("query_id", "chunk_id", "score", "rank", "compared")

    def _complete(self, spark: SparkSession, rows: pd.DataFrame, near: DataFrame, probes: float, k: int, half: bool) -> DataFrame:
        """Adds the cells that can hold something better than what `near` has."""
        more = self._more(spark, rows, near, k, half)
        return self._search(spark, rows, [np.union1d(a, b) for a, b in zip(more, self._wanted(rows, probes), strict=True)], k, half)

    def _needed(self, spark: SparkSession, queries: DataFrame, probes: float, k: int, half: bool) -> float:
        """The share of the cells that can hold one of the k best of a query, over the first TRIED queries by a hash of their ids."""
        rows = queries.where("query_vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED).select("query_id", "query_vector").toPandas()
        if not len(rows):
            return 0.0
        more = self._more(spark, rows, self._search(spark, rows, self._wanted(rows, probes), k, half), k, half)
        return float(np.mean([len(m) for m in more])) / len(self.centres)

    def _more(self, spark: SparkSession, rows: pd.DataFrame, near: DataFrame, k: int, half: bool) -> list[np.ndarray]:
        """The cells that can hold something better than what `near` has; only the kth scores of a block of queries reach the driver."""
        kth = {r["query_id"]: r["score"] for r in near.where(F.col("rank") == k).collect()}
        radius = np.full(len(self.centres), -1.0)
        for r in self.table(spark).groupBy("cell").agg(F.max("away").alias("r")).collect():
            radius[r["cell"]] = r["r"]
        slack = 2e-3 if half else 1e-5  # rounding of scores and of half-precision vectors
        apart = np.sqrt(np.maximum(0, 2 - 2 * self._near(rows))) - radius[None, :]
        best = 1 - np.maximum(0, apart) ** 2 / 4 + slack  # the largest score in the cell
        least = np.array([kth.get(i, -1.0) for i in rows["query_id"].tolist()])
        return [np.flatnonzero((radius >= 0) & (b >= low)) for b, low in zip(best, least, strict=True)]


def _blocks(queries: DataFrame):
    """Blocks of at most BLOCK queries as driver tables; one block in memory at a time."""
    held = queries.where("query_vector is not null").select("query_id", "query_vector")
    n = held.count()
    many = -(-n // BLOCK)
    for b in range(many):
        rows = (held if many == 1 else held.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == b)).orderBy("query_id").toPandas()
        if len(rows):
            yield rows
