"""Benchmark decontamination by SimHash over item-sized windows.

Items fall into classes by length; each class has a window width w of at most two thirds of its items' words. All windows of w words
of an item are fingerprinted: 64 bits, each the sign of the sum of its words' hash bits. Documents are fingerprinted in windows of
the same widths, a stride apart that is no more than the number of an item's windows, so that a copied item always has a document
window that covers exactly the same words as one of the item's windows. Fingerprints within `RADIUS` bits are found by multi-index
blocks: of RADIUS + 1 blocks of bits at least one is equal, so four tables by 16 bits lose none within radius 3.

Changed copies lie beyond any small radius, so candidates also come from an exact path: the rarest word five-shingles of each item, as
many as it takes until the others carry less of its weight than `SIMILARITY`. A stretch at the threshold holds one of them, and they
are looked up at every position of every document. No leak is lost by the search, up to 64-bit hash equality.

The similarity of a document to an item is the largest weighted Jaccard similarity of shingles (weights: inverse document frequency
over all items) of any stretch of its words; it is computed exactly for each candidate, and a document leaks an item at `SIMILARITY`
or more. An item shorter than a shingle is one shingle, its whole sequence, and only a document that is nothing else has it.

Words are compared in lower case with punctuation left out. Items are taken in blocks of at most `ITEMS` items and `ITEM_BYTES` bytes (or
one item), one pass over the documents each, so the index of a task is bounded; tasks are sent a block's items, and each worker builds the index of
them. Shingle frequencies are counted over all items before.

Defined results: null or empty texts leak nothing; items without words are left out; rows without doc_id are left out of results and
kept by remove_leaks; repeated items or documents give repeated results; a document may leak several items. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import keyed_text, small_batches, spool

WORDS, SIMILARITY, RADIUS, ITEMS, ITEM_BYTES = 5, 0.75, 3, 20_000, 2 << 20
WIDTHS = (3, 5, 8, 10, 16, 24, 40, 64, 100, 160, 250)


def _width(n: int) -> int:
    """The widest window of at most two thirds of n words; a short item is one window."""
    fit = [w for w in WIDTHS if 3 * w <= 2 * n]
    return fit[-1] if fit else n


STEP = 16384  # words whose bits are summed at once


def fingerprints_of(h: np.ndarray, wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (width, stride): SimHash of the windows of `width` words at 0, stride, 2 stride, ...

    Running sums of the words' bits serve all widths; they are taken over STEP words and the longest window at a time.
    """
    out: list[list[np.ndarray]] = [[] for _ in wanted]
    longest = max((w for w, _ in wanted), default=0)
    for i in range(0, len(h), STEP):
        own = h[i : i + STEP + longest]
        total = np.zeros((len(own) + 1, 64), np.int16)
        total[1:] = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
        np.add.accumulate(total, axis=0, out=total)
        for k, (width, stride) in enumerate(wanted):
            s = np.arange(-(-i // stride) * stride, min(i + STEP, len(h) - width + 1), stride) - i
            if len(s):
                out[k].append(np.packbits(total[s + width] - total[s] > width // 2, axis=1).view(K.U).ravel())
    return [np.concatenate(o) if o else np.zeros(0, K.U) for o in out]


def fingerprints(h: np.ndarray, width: int, stride: int) -> np.ndarray:
    return fingerprints_of(h, [(width, stride)])[0]


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct shingles; of fewer words, the whole sequence as one."""
    return np.unique(K.ngrams(h, min(words, max(1, len(h)))))


class Index:
    """Fingerprints of all items' windows in four tables by 16 bits, the items' weighted shingles, and where the rarest of them stand."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, least: float = SIMILARITY, known: dict[int, int] | None = None, count: int = 0):
        """known: in how many items each shingle stands, count: how many items there are; by default these items are all."""
        self.words, self.least = words, least
        self.short: dict[int, list[int]] = defaultdict(list)  # items shorter than a shingle, by their only one
        self.ids, self.n, self.shingles = [], [], []
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        spare: dict[int, int] = {}
        for item, text in items:
            buf, off = K.text_buffer(pa.array([text], pa.string()))
            h = K.words(buf, off, 0, 1, lower=True, space=K.PUNCT).hash
            if not len(h):
                continue
            self.ids.append(item)
            self.n.append(len(h))
            self.shingles.append(_shingles(h, words))
            if len(h) < words:
                self.short[int(self.shingles[-1][0])].append(len(self.ids) - 1)
                continue
            w = _width(len(h))
            spare[w] = min(spare.get(w, 1 << 30), len(h) - w + 1)
            rows[w] += [(int(f), len(self.ids) - 1, k) for k, f in enumerate(fingerprints(h, w, 1))]
        df: dict[int, int] = defaultdict(int)
        for s in self.shingles:
            for v in s.tolist():
                df[v] += 1
        if known is not None:
            df = {v: known[v] for v in df}
        count = count or len(self.ids)
        self.weight = {v: float(np.log1p(count / k)) for v, k in df.items()}
        self.total = [sum(self.weight[v] for v in s.tolist()) for s in self.shingles]
        self.own = [frozenset(s.tolist()) for s in self.shingles]
        self.unseen = float(np.log1p(count or 1))
        self.classes = {}
        for w, r in rows.items():
            f = np.array([x[0] for x in r], K.U)
            tables = []
            for b in range(RADIUS + 1):
                key = ((f >> K.U(16 * b)) & K.U(0xFFFF)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                tables.append((np.searchsorted(key[order], np.arange(65537)), order))
            self.classes[w] = (spare[w], f, np.array([x[1:] for x in r], np.int64).reshape(-1, 2), tables)
        r: list[tuple[int, int]] = []  # hash, item
        for k, s in enumerate(self.shingles):
            rest = self.total[k] if self.n[k] >= words else 0
            for v in sorted(s.tolist(), key=lambda v: (df[v], v)):
                if rest < least * self.total[k] - 1e-9:
                    break
                r.append((v, k))
                rest -= self.weight[v]
        r.sort()
        v = np.array([x[0] for x in r], K.U)
        marks = np.zeros(1 << max(16, (16 * len(r)).bit_length()), bool)
        marks[v & K.U(len(marks) - 1)] = True
        self.rare = marks, v, np.array([x[1] for x in r], np.int64)

    def similarity(self, item: int, h: np.ndarray) -> float:
        got = _shingles(h, self.words).tolist()
        both = sum(self.weight[v] for v in got if v in self.own[item])
        return both / (self.total[item] + sum(self.weight.get(v, self.unseen) for v in got) - both)

    def candidates(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """For each width: rows of item, position in h at which the item would begin."""
        out = {}
        found = fingerprints_of(h, [(w, stride) for w, (stride, *_) in self.classes.items()])
        for got, (w, (stride, f, of, tables)) in zip(found, self.classes.items(), strict=True):
            hits = []
            for b, (edge, order) in enumerate(tables):
                key = ((got >> K.U(16 * b)) & K.U(0xFFFF)).astype(np.int64)
                at, window = K.flat(edge[key], edge[key + 1] - edge[key])
                near = np.bitwise_count(f[order[at]] ^ got[window]) <= RADIUS
                hits.append(np.column_stack([of[order[at[near]]], window[near] * stride]))
            hits = np.concatenate(hits)
            out[w] = np.unique(np.column_stack([hits[:, 0], hits[:, 2] - hits[:, 1]]), axis=0)
        return out

    def pairs(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """Document and item of all candidates; documents are h[first[i] : first[i + 1]]."""
        out = set()
        for rows in self.candidates(h).values():
            n = np.array(self.n, np.int64)[rows[:, 0]]
            i = np.searchsorted(first, rows[:, 1] + n // 2, "right") - 1
            fit = (i >= 0) & (i < len(first) - 1)
            out.update(zip(i[fit].tolist(), rows[fit, 0].tolist(), strict=True))
        (marks, v, item), g = self.rare, K.ngrams(h, self.words)
        at = np.flatnonzero(marks[g & K.U(len(marks) - 1)])
        lo = np.searchsorted(v, g[at])
        hit, owner = K.flat(lo, np.searchsorted(v, g[at], "right") - lo)
        at = at[owner]
        i = np.searchsorted(first, at, "right") - 1
        fit = at + self.words <= first[np.minimum(i + 1, len(first) - 1)]
        if fit.any():
            out.update(map(tuple, np.unique(np.column_stack([i[fit], item[hit[fit]]]), axis=0).tolist()))
        return out

    def best(self, item: int, g: np.ndarray) -> float:
        """The largest similarity of any stretch of a document, whose shingles are g; 0 if it is below the threshold.

        Such a stretch begins and ends with shingles of the item, and its first shingle does not come again in it: otherwise the
        stretch without its ends holds the same of the item and no more of anything else.
        """
        own, total = self.shingles[item], self.total[item]
        mine = own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g
        at = np.flatnonzero(mine)
        if sum(self.weight[v] for v in np.unique(g[at]).tolist()) < self.least * total - 1e-9:
            return 0.0
        values, mine, top = g[at[0] : at[-1] + 1].tolist(), mine[at[0] : at[-1] + 1].tolist(), 0.0
        for a in (at - at[0]).tolist():
            both, more, seen = 0.0, 0.0, set()
            for z in range(a, len(values)):
                v = values[z]
                if v in seen:
                    if v == values[a]:
                        break
                    continue
                seen.add(v)
                if mine[z]:
                    both += self.weight[v]
                    top = max(top, both / (total + more))
                else:
                    more += self.weight.get(v, self.unseen)
                    if total / (total + more) < max(top, self.least - 1e-9):
                        break
            if top >= 1 - 1e-12:
                return 1.0
        return top if top >= self.least - 1e-12 else 0.0

    def leaks(self, h: np.ndarray, first: np.ndarray) -> dict[int, dict[int, float]]:
        """Of each document (its words h[first[i] : first[i + 1]]): items that it leaks, with their similarity."""
        out: dict[int, dict[int, float]] = defaultdict(dict)
        if self.short:
            size = np.diff(first)
            for i in np.flatnonzero((size > 0) & (size < self.words)).tolist():
                out[i].update(dict.fromkeys(self.short.get(int(_shingles(h[first[i] : first[i + 1]], self.words)[0]), ()), 1.0))
        for i, item in self.pairs(h, first):
            g = K.ngrams(h[first[i] : first[i + 1]], self.words)
            if len(g) and (s := self.best(item, g)):
                out[i][item] = s
        return {i: found for i, found in out.items() if found}


@dataclass(frozen=True)
class Items:
    """What an Index is made of. Plans carry this; a worker makes the index, which is over a hundred times larger, and keeps it from task to task."""

    rows: tuple[tuple[int, str], ...]
    least: float
    known: dict[int, int] | None
    count: int
    name: str

    def index(self) -> Index:
        return K.held(self.name, lambda: Index(list(self.rows), least=self.least, known=self.known, count=self.count))


def _over(run, items: Items, docs: DataFrame, schema) -> DataFrame:
    """docs through run(index, batches)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(items.index(), batches)
        K._powers.clear()

    return docs.mapInArrow(K.tidy(task, items.name), schema)


def _search():
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])

    def run(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.text_buffer(b.column(1))
            out = []
            for lo, hi in K.chunks(off):
                w = K.words(buf, off, lo, hi, lower=True, space=K.PUNCT)
                found = index.leaks(w.hash, w.first)
                out += [(b.column(0)[lo + i].as_py(), index.ids[item], s) for i, items in sorted(found.items()) for item, s in sorted(items.items())]
            yield pa.record_batch([pa.array([r[k] for r in out], t.type) for k, t in enumerate(schema)], schema=schema)

    return run


def _counted(words: int):
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.text_buffer(b.column(0))
            for lo, hi in K.chunks(off):
                w = K.words(buf, off, lo, hi, lower=True, space=K.PUNCT)
                for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    if z > a:
                        yield pa.record_batch([pa.array(_shingles(w.hash[a:z], words).view(np.int64))], schema=schema)

    return run


def _items(benchmark: DataFrame, block: int, least: float) -> Iterator[Items]:
    small_batches(benchmark.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, size = items.agg(F.count_if(F.regexp_like("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // block), -(-(size or 0) // ITEM_BYTES))
    count = spool(items.select("text").mapInArrow(K.tidy(_counted(WORDS)), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingles")
    items = spool(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    for k in range(blocks):
        own = items.where(F.col("block") == k).select("item_id", "text")
        rows = own.orderBy("item_id", "text").collect()
        if blocks == 1:
            yield Items(tuple(map(tuple, rows)), least, None, n, f"items-{uuid.uuid4().hex}")
            continue
        mine = own.select("text").mapInArrow(K.tidy(_counted(WORDS)), "shingle long").distinct()
        known = {r["shingle"] & ((1 << 64) - 1): r["n"] for r in count.join(mine, "shingle").collect()}
        yield Items(tuple(map(tuple, rows)), least, known, n, f"items-{uuid.uuid4().hex}")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block: int = ITEMS) -> DataFrame:
    """doc_id, item_id, similarity of every item that a document leaks."""
    out = None
    for items in _items(benchmark, block, least):
        part = _over(_search(), items, keyed_text(docs), "doc_id long, item_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(at: int):
    def run(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.text_buffer(b.column(at))
            keep = np.ones(b.num_rows, bool)
            for lo, hi in K.chunks(off):
                w = K.words(buf, off, lo, hi, lower=True, space=K.PUNCT)
                keep[[lo + i for i in index.leaks(w.hash, w.first)]] = False
            yield b.filter(pa.array(keep))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block: int = ITEMS) -> DataFrame:
    """The same columns without the rows that leak an item."""
    for items in _items(benchmark, block, least):
        docs = _over(_clean(docs.columns.index("text")), items, docs, docs.schema)
    return docs
