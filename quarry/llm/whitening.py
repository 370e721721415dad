"""Embedding whitening: principal components of integer vectors, from one pass over the distinct ones.

1. Every entry c becomes x = floor(64 c) + 1,000,000; each distinct x vector stands once in the fit list.
2. Welford's rank-one updates run through the batches of each partition: count, exact sums, mean, and the matrix M of products of deviations,
   M += (x - mean before)(x - mean after)'. The running means of a batch are prefix sums, so a batch's updates add up in one matrix product.
3. Partitions are merged by the parallel update M = Ma + Mb + d d' na nb / (na + nb), d being the difference of their means: first in about as many
   tasks as the square root of the number of partitions, then in one. A task holds one state a length, and the driver gets one.
4. V = M / n is reduced to a tridiagonal matrix by Householder reflections, which implicit QR steps with Wilkinson's shift make diagonal.
5. A second pass over the fit list measures the covariance of what was whitened, by the same updates.

Means and products are kept relative to a vector of the partition (integers, subtracted exactly), so that the offset costs no digits.

Defined results: vectors that are null or hold a null or non-finite entry are dropped; a row without vec_id stays, with a null vec_id; repeated rows
get equal results, each its own; vectors of different lengths are fitted apart, each length with its own n and components; an eigenvalue of at most
1e-12 of the trace counts as none (fewer distinct vectors than dimensions, constant entries) and has no component, so a single distinct vector, and an
empty one, has no rows; floor(64 c) beyond 2**53 is clipped to it; a deviation that no long can hold is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, hypot, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions, small_batches, spool
from .vectors import by_length, floored, row_sums

SCALE, OFFSET, COMPONENTS, NONE, ROWS = 64, 1_000_000, 16, 1e-12, 4096


class Moments:
    """Count, sums, mean and products of deviations of the vectors seen; the mean is relative to base."""

    SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("base", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
    SQL = "dim int, n long, sums array<string>, base array<long>, mean array<double>, products array<double>"

    def __init__(self, base: np.ndarray):
        d = len(base)
        self.base, self.n, self.sums, self.mean, self.products = base.astype(np.int64), 0, [0] * d, np.zeros(d), np.zeros((d, d))

    def update(self, rows: np.ndarray) -> None:
        """Rank-one updates by these rows, given relative to base, in order."""
        for i in range(0, len(rows), ROWS):
            y = rows[i : i + ROWS]
            after = (self.n * self.mean + np.cumsum(y, axis=0)) / (self.n + np.arange(1, len(y) + 1))[:, None]
            before = np.vstack([self.mean, after[:-1]])
            self.products += (y - before).T @ (y - after)
            self.n, self.mean = self.n + len(y), after[-1]

    def count(self, x: np.ndarray) -> None:
        """Exact sums of integer rows."""
        small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
        self.sums = [s + int(t) for s, t in zip(self.sums, (x if small else x.astype(object)).sum(axis=0), strict=True)]

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        apart = (other.base - self.base).astype(float) + other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * (other.n / n))
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self, dim: int) -> pa.RecordBatch:
        return pa.record_batch([[dim], [self.n], [[str(s) for s in self.sums]], [self.base.tolist()], [self.mean.tolist()], [self.products.ravel().tolist()]], schema=self.SCHEMA)

    @staticmethod
    def of(row: dict) -> Moments:
        m = Moments(np.array(row["base"], np.int64))
        m.n, m.sums, m.mean = row["n"], [int(s) for s in row["sums"]], np.array(row["mean"], float)
        m.products = np.array(row["products"], float).reshape(m.products.shape)
        return m


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and the rows of Q', where Q' a Q is tridiagonal, by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        if not np.abs(v[1:]).max() > 0:
            continue
        v /= np.abs(v).max()  # so that squares of tiny entries are not lost
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :, :] -= 2 * np.outer(v, v @ q[k + 1 :, :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    diagonal, side, q = tridiagonal(a)
    d, eps = len(diagonal), np.finfo(float).eps
    x, y, high, steps = diagonal.tolist(), side.tolist(), d - 1, 0
    none = eps * max((abs(v) for v in x + y), default=0.0) / 16
    split = lambda k: abs(y[k]) <= max(none, eps * (abs(x[k]) + abs(x[k + 1])))
    while high > 0:
        if split(high - 1):
            high -= 1
            continue
        steps += 1
        if steps > 60 * d:
            raise ArithmeticError("QR steps do not converge: not a finite symmetric matrix")
        low = high - 1
        while low > 0 and not split(low - 1):
            low -= 1
        half = (x[high - 1] - x[high]) / 2
        shift = x[high] - y[high - 1] ** 2 / (half + (hypot(half, y[high - 1]) if half >= 0 else -hypot(half, y[high - 1])))
        f, g = x[low] - shift, y[low]
        for k in range(low, high):  # the bulge goes down
            r = hypot(f, g)
            c, s = (f / r, g / r) if r else (1.0, 0.0)
            if k > low:
                y[k - 1] = r
            p, o, t = x[k], y[k], x[k + 1]
            x[k], x[k + 1], y[k] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t, c * s * (t - p) + (c * c - s * s) * o
            if k < high - 1:
                f, g, y[k + 1] = y[k], s * y[k + 1], c * y[k + 1]
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-np.array(x), kind="stable")
    return np.array(x)[order], q[order].T.reshape(d, d)


@dataclass(frozen=True)
class Whitener:
    """What one length's vectors are projected on."""

    n: int
    base: np.ndarray
    rest: tuple[int, ...]  # sums less n * base
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def fit(m: Moments, components: int) -> Whitener:
        values, vectors = symmetric_qr(m.covariance())
        trace = float(np.trace(m.covariance()))
        k = min(components, int((values > NONE * trace).sum()))
        return Whitener(m.n, m.base, tuple(s - m.n * int(b) for s, b in zip(m.sums, m.base, strict=True)), vectors[:, :k], values[:k], trace)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return ((x - self.base).astype(float) - mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = x - self.base
        fits = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0) < 1 << 62
        return row_sums(self.n * y - np.array(self.rest, np.int64) if fits else self.n * y.astype(object) - np.array(self.rest, object))


def _moments(rows: Callable[[int, np.ndarray], np.ndarray | None], exact: bool):
    """Welford's updates over a partition; rows(length, x) are the vectors that are measured."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for b in batches:
            for d, _, x in by_length(b.column("x")):
                if (made := rows(d, x)) is None or not made.shape[1]:
                    continue
                if d not in states:
                    states[d] = Moments(x[0] if exact else np.zeros(made.shape[1]))
                states[d].update((x - states[d].base).astype(float) if exact else made)
                if exact:
                    states[d].count(x)
        yield from (m.row(d) for d, m in states.items())

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, Moments] = {}
    for b in batches:
        for row in b.to_pylist():
            m = Moments.of(row)
            if row["dim"] in states:
                states[row["dim"]].merge(m)
            else:
                states[row["dim"]] = m
    yield from (m.row(d) for d, m in states.items())


def _merged(parts: DataFrame) -> dict[int, Moments]:
    """One state for each length."""
    some = parts.repartition(ceil(sqrt(partitions(parts.sparkSession)))).mapInArrow(_merge, Moments.SQL)
    return {r["dim"]: Moments.of(r) for r in some.repartition(1).mapInArrow(_merge, Moments.SQL).toArrow().to_pylist()}


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """distinct: x, integer vectors, each once. A model for each length."""
    found = _merged(distinct.select("x").mapInArrow(_moments(lambda d, x: x, True), Moments.SQL))
    return {d: Whitener.fit(m, components) for d, m in found.items()}


def identity_errors(distinct: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """Of each length, the largest entry of the whitened vectors' covariance less the identity, measured over the fit list."""
    found = _merged(distinct.select("x").mapInArrow(_moments(lambda d, x: models[d].whiten(x) if d in models else None, False), Moments.SQL))
    return {d: float(np.abs(m.covariance() - np.eye(len(m.mean))).max()) for d, m in found.items()}


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _project(models: dict[int, Whitener], errors: dict[int, float]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column("x")):
                k = len(models[d].values) if d in models else 0
                if not k:
                    continue
                m, who = models[d], np.repeat(at, k)
                deviation = pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                columns = [b.column("vec_id").take(pa.array(who)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), np.full(len(who), m.n), deviation]
                columns += [m.whiten(x).ravel(), np.tile(m.values / m.trace, len(at)), np.full(len(who), errors[d])]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_OUT)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    small_batches(vectors.sparkSession)
    rows = floored(vectors, SCALE, OFFSET)
    distinct = spool(rows.select("x").distinct(), "fit")
    models = fit(distinct, components)
    return rows.mapInArrow(_project(models, identity_errors(distinct, models)), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
