"""Vector code compression: product quantisation by a delta-maintained Lloyd iteration.

A vector is cut into 16 parts, each coded by the nearest of 64 entries of its position's codebook. Entries are means of their parts, rounded down. Sums and
counts of entries are running integers: every round writes the assignments beside the previous ones, and only parts whose assignment changed
are read back, as plus at the new entry and minus at the old one, added up in each task before they are shuffled. What reaches the driver are the sums of
entries, 64 numbers a component whatever the number of rows.

Defined results: vectors that are null or hold a null or non-finite component are dropped; rows without vec_id are coded, and come last among the
first entries; of repeated vec_ids every row counts, ordered by vec_id and vector; with fewer than 64 rows, the codebook has as many entries; vectors of different
lengths have codebooks of their own; where 16 does not divide a length d, part p holds the components from p d div 16 up to (p + 1) d div 16;
floors beyond 2**53 are clipped to it; errors that no long can hold are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import drop, small_batches, spool
from .vectors import by_length, floored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to this many are broadcast with their totals; more are joined by shuffles.
MOST_LABELS = 100_000
SALTS = 16


class Codebook:
    """Entries of all parts of vectors of one length, with the running counts and sums of what is assigned to them."""

    def __init__(self, first: np.ndarray):
        n, d = first.shape
        self.cuts = [p * d // PARTS for p in range(PARTS + 1)]
        self.entries = [first[:, a:z].astype(object) for a, z in zip(self.cuts, self.cuts[1:], strict=False)]
        self.counts = np.zeros((PARTS, n), object)
        self.sums = [np.zeros(e.shape, object) for e in self.entries]

    def add(self, part: int, entry: int, at: int, value: int) -> None:
        """A contribution: at component `at` of the part, or to the count where that is negative."""
        if at < 0:
            self.counts[part, entry] += value
        else:
            self.sums[part][entry, at] += value

    def move(self) -> None:
        for p in range(PARTS):
            for k in np.flatnonzero(self.counts[p] > 0).tolist():
                self.entries[p][k] = self.sums[p][k] // self.counts[p][k]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for row in e for x in row).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Indexes (rows by parts) of the nearest entries, ties to the lower one, and the squared distances' sums."""
        codes, total = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), object)
        for p, (a, z) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            v, e = x[:, a:z], self.entries[p]
            top = int(np.abs(v).max(initial=0)) + int(np.abs(e).max(initial=0))
            if 4 * max(1, z - a) * top * top < 1 << 53:
                v, e = v.astype(float), e.astype(float)
                away = (v * v).sum(axis=1)[:, None] - 2 * (v @ e.T) + (e * e).sum(axis=1)[None, :]
            else:
                away = np.array([[sum((int(s) - t) ** 2 for s, t in zip(row, entry, strict=True)) for entry in e] for row in v], object).reshape(len(v), len(e))
            codes[:, p] = away.argmin(axis=1)
            total = total + np.take_along_axis(away, codes[:, p : p + 1].astype(np.int64), 1)[:, 0].astype(object)
        return codes, [int(t) if t < 1 << 63 else None for t in total]


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def _assign(books: dict[int, Codebook]):
    """Adds the new code, and keeps the one that was persisted as `before`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column("x")):
                own = b.take(pa.array(at))
                columns = [own.column("vec_id"), own.column("label"), own.column("x"), own.column("code"), _bytes(books[d].nearest(x)[0])]
                yield pa.record_batch(columns, names=["vec_id", "label", "x", "before", "code"])

    return run


def _changes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's contributions: length, part, entry, component (-1: the count), value as decimal digits."""
    held: dict[int, tuple[np.ndarray, list[np.ndarray], list[int]]] = {}

    def give(d: int) -> pa.RecordBatch:
        counts, sums, _ = held.pop(d)
        rows = [(p, k, -1, int(counts[p, k])) for p, k in zip(*np.nonzero(counts), strict=True)]
        rows += [(p, k, j, int(s[k, j])) for p, s in enumerate(sums) for k, j in zip(*np.nonzero(s), strict=True)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.record_batch([pa.array([d] * len(rows), pa.int32()), *(pa.array([int(v) for v in c], pa.int32()) for c in cols[:3]), pa.array([str(v) for v in cols[3]], pa.string())], names=["dim", "part", "entry", "at", "value"])

    for b in batches:
        for d, at, x in by_length(b.column("x")):
            cuts = [p * d // PARTS for p in range(PARTS + 1)]
            big = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 50
            if d not in held:
                held[d] = (np.zeros((PARTS, ENTRIES), object), [np.zeros((ENTRIES, z - a), object) for a, z in zip(cuts, cuts[1:], strict=False)], cuts)
            counts, sums, _ = held[d]
            new, old = (b.column(c).take(pa.array(at)).to_pylist() for c in ("code", "before"))
            new = np.frombuffer(b"".join(new), np.uint8).reshape(len(at), PARTS).astype(np.int64)
            had = np.array([len(o) == PARTS for o in old])
            old = np.frombuffer(b"".join(o if len(o) == PARTS else bytes(PARTS) for o in old), np.uint8).reshape(len(at), PARTS).astype(np.int64)
            moved = (new != old) | ~had[:, None]
            for p in range(PARTS):
                v = x[:, cuts[p] : cuts[p + 1]].astype(object if big else np.int64)
                for codes, rows, sign in ((new[:, p], moved[:, p], 1), (old[:, p], moved[:, p] & had, -1)):
                    n, s = np.zeros(ENTRIES, np.int64), np.zeros((ENTRIES, v.shape[1]), v.dtype)
                    np.add.at(n, codes[rows], 1)
                    np.add.at(s, codes[rows], v[rows])
                    counts[p] += sign * n
                    sums[p] += sign * s.astype(object)
    yield from (give(d) for d in list(held))


def _final(books: dict[int, Codebook]):
    digests = {d: b.digest() for d, b in books.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column("x")):
                codes, error = books[d].nearest(x)
                own = b.take(pa.array(at))
                columns = [own.column("vec_id"), own.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64()), pa.array([digests[d]] * len(at))]
                yield pa.record_batch(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def first_entries(rows: DataFrame) -> dict[int, Codebook]:
    """A codebook for each length, from its first rows by vec_id; at most ENTRIES rows of each length reach the driver."""
    w = W.Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "x")
    found = rows.select("vec_id", "x", F.size("x").alias("dim")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= ENTRIES).orderBy("dim", "n").toArrow()
    return {d: Codebook(x) for d, _, x in by_length(found.column("x").combine_chunks())}


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of the same label, added up; labels that are null are the same."""
    totals = spool(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")), "labels")
    few = totals.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    own = totals.select(F.col("label").alias("_label"), F.expr("try_cast(_sum as long)").alias("label_error"))
    if few:
        return coded.join(F.broadcast(own), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    own = own.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(own, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_to")), "left").drop("_label", "_salt", "_to")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256; one row for each vector that takes part."""
    small_batches(vectors.sparkSession)
    rows = floored(vectors, SCALE, 0, "label")
    books = first_entries(rows)
    kind = rows.schema["label"].dataType.simpleString()
    at = rows.withColumn("code", F.lit(b""))
    held = None
    for _ in range(rounds):
        now = spool(at.mapInArrow(_assign(books), f"vec_id long, label {kind}, x array<long>, before binary, code binary"), "assigned")
        if held is not None:
            drop(held)
        changed = now.where("before <> code").select("x", "before", "code").mapInArrow(_changes, "dim int, part int, entry int, at int, value string")
        for r in changed.groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            books[r["dim"]].add(r["part"], r["entry"], r["at"], int(r["value"]))
        for b in books.values():
            b.move()
        held, at = now, now.select("vec_id", "label", "x", "code")
    coded = spool(at.mapInArrow(_final(books), f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"), "coded")
    if held is not None:
        drop(held)
    return label_errors(coded).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
