"""Exact N-gram Jaccard join as a metric-space join.

Distances are Jaccard distances of the documents' sets of distinct word shingles; a link is a distance of at most 1 - similarity.

1. Every shingle v stands for a pivot {v}. A set's nearest pivots are its own shingles, all at the same distance 1 - 1/n, so ties
   are broken by one global order, rarest shingle first. A set's home is the Voronoi region of its first shingle. By the triangle
   inequality two linked sets a and b with |b| <= |a| share at least t / (1 + t) * (|a| + |b|) shingles, so the first shingle that
   they share stands among the first |b| - ceil(2t / (1 + t) |b|) + 1 of b and the first |a| - ceil(t |a|) + 1 of a. Each set is
   therefore replicated into the regions of that window of its own shingles, and no linked pair is lost. Shingles that only one
   document has come first in the order and can be shared by nobody: they take up the window but no replica is made for them, and
   a set whose window holds nothing else is done.
2. Within a region, the set with the smallest share of shingles of its own is the pivot; all members are compared with it, exactly.
   Members within the radius are one class with it.
3. What is left joins recursively: a region whose members are in different classes gets a new pivot from those outside its largest
   class, until the pairs of a member outside with any other of its region are at most `LEAF` for each replica, all regions together, or a
   round no longer takes a tenth of those outside in. Then the members outside the largest class are compared with members of other
   classes, except pairs that sizes, positions in the order or the triangle inequality over the distances to the pivot rule out.
   Every pair is ruled out by a bound or compared, whenever the recursion ends.

Shingle counts come from one exchange between blocks of documents: each block asks about each of its shingles once, with the number of
its documents that have it, and is told the sum. Equal shingle sets are one point of the space and are represented by the smallest
doc_id.

Defined results: text that is null, empty or white space has no shingles and is linked with nothing; a text of fewer than `words`
words has its whole sequence as only shingle. Of rows that repeat a doc_id, one with the most shingles counts.
Rows without doc_id are left out. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import asked, blocks, drop, parts_of, spool, together
from .graph import components

WORDS, NUM, DEN, LEAF = 5, 75, 100, 64


def shingle_sets(w: K.Words, words: int) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted."""
    g = K.ngrams(w.hash, words)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        out.append(K.distinct(g[a : z - words + 1]) if z - a >= words else K.ngrams(w.hash[a:z], z - a) if z > a else np.zeros(0, K.U))
    return out


def _ask(words: int, parts: int):
    """Each distinct shingle of a block, by 48 bits of its hash, with the number of documents that have it; first those that only one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for b in batches:
                for text in K.texts(b):
                    key = np.sort(np.concatenate([np.zeros(0, K.U), *shingle_sets(text.words(lower=True), words)]) & K.KEY)
                    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                    key, n = key[begin], np.diff(np.append(begin, len(key)))
                    one, more, count = key[n == 1], key[n > 1], n[n > 1].astype(np.uint32)
                    several = {part: (a, z) for part, a, z in K.slices(more, parts)}
                    single = {part: (a, z) for part, a, z in K.slices(one, parts)}
                    for part in sorted(single.keys() | several.keys()):
                        (a, z), (c, d) = single.get(part, (0, 0)), several.get(part, (0, 0))
                        yield K.row(part, text.block, K.ASK, K.narrow(one[a:z]), K.narrow(more[c:d]), count[c:d].tobytes())

        yield from K.batched(found())

    return run


MANY = (1 << 16) - 1  # larger counts are not told apart


def _count(parts: int):
    """Tells each block, of its shingles that more than one document has, how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, counts = [], [], []
        for b in batches:
            for n, one, more, count in zip(b.column("block").to_pylist(), b.column("a"), b.column("b"), b.column("c"), strict=True):
                one, more = K.wide(one.as_buffer()), K.wide(more.as_buffer())
                block.append(n)
                keys.append(np.concatenate([one, more]))
                counts.append(np.concatenate([np.ones(len(one), np.uint32), np.frombuffer(count.as_buffer(), np.uint32)]))
        if not keys:
            return
        of = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        key, count = np.concatenate(keys), np.concatenate(counts)
        keys.clear(), counts.clear()
        order = np.argsort(key, kind="stable")
        key, of, count = key[order], of[order], count[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.repeat(np.minimum(np.add.reduceat(count, begin, dtype=np.int64), MANY).astype(np.uint16), np.diff(np.append(begin, len(key))))
        key, of, total = key[total > 1], of[total > 1], total[total > 1]
        order = np.argsort(of, kind="stable")
        key, of, total = key[order], of[order], total[order]
        cut = np.searchsorted(of, np.arange(len(block) + 1))
        yield from K.batched(K.row(K.home(n, parts), n, K.TELL, K.narrow(key[cut[i] : cut[i + 1]]), total[cut[i] : cut[i + 1]].tobytes()) for i, n in enumerate(block) if cut[i + 1] > cut[i])

    return run


_POINTS = "doc_id long, n long, own long, sig1 long, sig2 long, window int, short_window int, shared array<long>"


def _points(words: int, num: int, den: int):
    """The points that can have a link have their shared shingles, rarest first; the others only a size."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("window", pa.int32()), ("short_window", pa.int32()), ("shared", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, told in K.met(batches):
            key, count = np.zeros(0, K.U), np.zeros(0, np.uint16)
            if told:
                key, count = np.concatenate([K.wide(a) for a, *_ in told]), np.concatenate([np.frombuffer(b, np.uint16) for _, b, _ in told])
                order = np.argsort(key)
                key, count = key[order], count[order]
            out: list[tuple] = []
            for d, h in zip(text.ids.tolist(), shingle_sets(text.words(lower=True), words), strict=True):
                n = len(h)
                if len(key):
                    at = np.minimum(np.searchsorted(key, h & K.KEY), len(key) - 1)
                    shared = np.flatnonzero(key[at] == h & K.KEY)
                    s = h[shared][np.lexsort((h[shared], count[at[shared]]))]
                else:
                    s = h[:0]
                own = n - len(s)
                wide, short = n - ceil(num * n / den) + 1 - own, n - ceil(2 * num * n / (num + den)) + 1 - own
                if len(s) and wide > 0:
                    sig = K.mix(s)
                    same = (int(sig.sum(dtype=K.U).view(np.int64)), int(np.bitwise_xor.reduce(K.mix(sig + K.U(1))).view(np.int64))) if own == 0 else (d, d)  # with a shingle of its own, a set has no copy
                    out.append((d, n, own, *same, wide, max(0, short), s.view(np.int64)))
                else:
                    out.append((d, n, own, None, None, None, None, None))
            for i in range(0, len(out), 1000):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 1000], strict=True), schema, strict=True)], schema=schema)

    return run


def points(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Spooled; one row per doc_id."""
    text = blocks(docs)
    n = parts_of(text)
    told = spool(asked(text, _ask(words, n), n).mapInArrow(K.tidy(_count(n)), K.ROW), "counts")
    pts = spool(together(text, told, n).mapInArrow(K.tidy(_points(words, num, den)), _POINTS), "points")
    drop(told)
    drop(text)
    again = spool(pts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "again")
    if again.isEmpty():
        return pts
    one = pts.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("n", *(c for c in pts.columns if c not in ("doc_id", "n")))).alias("c")).select("doc_id", "c.*")
    return spool(pts.join(again, "doc_id", "left_anti").unionByName(one), "points")


def _linked(inter, a, b, num: int, den: int):
    return F.lit(den + num) * inter >= F.lit(num) * (a + b)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, p, inter, nx, np of the pairs, by their shingles."""
    x = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("sx"))
    p = sets.select(F.col("doc_id").alias("p"), F.col("n").alias("np"), F.col("shared").alias("sp"))
    return pairs.join(x, "x").join(p, "p").select("x", "p", "nx", "np", F.size(F.array_intersect("sx", "sp")).cast("long").alias("inter"))


def link_classes(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, itself included."""
    pts = points(docs, words, num, den)
    able = pts.where("shared is not null")
    copies = able.groupBy("n", "own", "sig1", "sig2").agg(F.min("doc_id").alias("rep"))
    sets = spool(able.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "sets")
    post = sets.select("doc_id", "n", "own", "short_window", F.posexplode(F.slice("shared", 1, F.col("window"))).alias("k", "v")).select("v", "doc_id", "n", (F.col("own") + F.col("k")).cast("long").alias("at"), (F.col("k") < F.col("short_window")).alias("short"), (F.col("own") / F.col("n")).alias("apart"))
    busy = post.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max("short").alias("any")).where("m > 1 and any").select("v")
    post = spool(post.join(busy, "v"), "regions").withColumn("label", F.col("doc_id"))
    known = links = None
    fits = lambda a, b: _linked(F.least(a["n"], b["n"]), a["n"], b["n"], num, den) & _linked(F.least(a["n"] - a["at"], b["n"] - b["at"]), a["n"], b["n"], num, den)
    before = None
    for r in itertools.count():
        # what is outside a region's largest class, and the pivot among it
        left = post if r == 0 else _outside(post)
        pivot = left.groupBy("v").agg(F.min(F.struct("apart", "doc_id", "n", "at", "label")).alias("c")).select("v", F.col("c.doc_id").alias("p"), F.col("c.n").alias("n"), F.col("c.at").alias("at"), F.col("c.label").alias("label"))
        a, b = post.alias("a"), pivot.alias("b")
        pairs = a.join(b, F.col("a.v") == F.col("b.v")).where((F.col("a.label") != F.col("b.label")) & fits(_of("a"), _of("b"))).select(F.col("a.doc_id").alias("x"), "b.p").distinct()
        seen = _distances(pairs if known is None else pairs.join(known, ["x", "p"], "left_anti"), sets)
        found = spool(seen, f"distances{r}")
        known = found if known is None else known.unionByName(found)
        links = known.where(_linked(F.col("inter"), F.col("nx"), F.col("np"), num, den)).select("x", "p")
        labels = components(links)
        was, post = post, spool(post.drop("label").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).select("v", "doc_id", "n", "at", "short", "apart", "label"), f"regions{r}")
        drop(was) if r else None
        each = post.groupBy("v", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("v").agg(F.sum("m").alias("all"), F.max("m").alias("most"))
        replicas, outside, pairs = each.agg(F.sum("all"), F.sum(F.col("all") - F.col("most")), F.sum(((F.col("all") - F.col("most")) * F.col("all")).cast("double"))).first()
        if (pairs or 0) <= leaf * (replicas or 0) or (before is not None and outside > 0.9 * before):
            break
        before = outside
    # exact rest: pairs of different classes of a region, one of them outside the largest class
    home = known.groupBy("x").agg(F.min(F.struct((1 - F.col("inter") / (F.col("nx") + F.col("np") - F.col("inter"))).alias("d"), "p")).alias("c")).select(F.col("x").alias("doc_id"), F.col("c.p").alias("p"), F.col("c.d").alias("d"))
    placed = post.join(home, "doc_id", "left")
    a, b = _outside(placed).alias("a"), placed.alias("b")
    away = F.lit((den - num) / den + 1e-9)
    window = F.col("a.p").isNull() | F.col("b.p").isNull() | (F.col("a.p") != F.col("b.p")) | ((F.abs(F.col("a.d") - F.col("b.d")) <= away) & (F.col("a.d") + F.col("b.d") > 0))
    smaller = F.struct("a.n", "a.doc_id") < F.struct("b.n", "b.doc_id")
    rest = a.join(b, F.col("a.v") == F.col("b.v")).where((F.col("a.label") != F.col("b.label")) & F.when(smaller, F.col("a.short")).otherwise(F.col("b.short")) & fits(_of("a"), _of("b")) & window)
    rest = rest.select(F.greatest("a.doc_id", "b.doc_id").alias("x"), F.least("a.doc_id", "b.doc_id").alias("p")).distinct()
    tried = known.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p"))
    last = spool(_distances(rest.join(tried, ["x", "p"], "left_anti"), sets).where(_linked(F.col("inter"), F.col("nx"), F.col("np"), num, den)).select("x", "p"), "rest")
    labels = components(links.unionByName(last))
    named = pts.select("doc_id", F.col("n").alias("n_shingles"), "n", "own", "sig1", "sig2").join(copies, ["n", "own", "sig1", "sig2"], "left")
    return named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))


def _of(side: str) -> dict:
    return {k: F.col(f"{side}.{k}") for k in ("n", "at")}


def _outside(post: DataFrame) -> DataFrame:
    """Replicas whose class is not the largest of their region; regions of one class have none."""
    each = post.groupBy("v", "label").agg(F.count(F.lit(1)).alias("m"))
    most = each.groupBy("v").agg(F.max(F.struct("m", "label")).alias("c"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("v", F.col("c.label").alias("_most"))
    return post.join(most, "v").where("label != _most").drop("_most")
