"""Packing by concatenating and cutting.

Pass one tokenises every document once and writes its ids, in the order of the rows of each partition, with the running total inside
the partition. Prefix sums over the partitions' totals (one figure a partition) then give every document its offset in the one
stream that all documents make. Pass two cuts the stream at multiples of the window: sequence k holds the ids k * size .. (k + 1) *
size - 1, and each document is cut where a boundary falls into it. So all sequences are full except the last.

Ids come from the tokenizer file `vocabulary`, as it encodes without special tokens added (those that stand in a text are matched);
each document ends with `end_id`. With a byte-level tokenizer, tokenising is done once for each distinct stretch of text: cuts are
made at single blanks and line feeds and between ASCII letters or digits and ASCII punctuation, all places that such a tokenizer's own
pre-tokenisation never joins. A bounded table of stretches, told apart by 128 bits of hashes, is kept for each worker. With any other
kind of tokenizer each document is encoded whole.

Defined results: null or empty text is the end id alone; rows that repeat a doc_id are packed one by one; rows without doc_id are
left out; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import keyed_text, spool

SIZE, END_ID = 2048, 1
#: Stretches that a worker remembers, at most; beyond, it begins anew.
REMEMBERED = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Bytes at whose sides a cut is safe: printable ASCII, and characters U+00C0 to U+07FF, none of which is white space.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
#: 1 for ASCII letters and digits, 2 for ASCII punctuation other than the apostrophe, which may begin a contraction; 0 for all else.
_KIND = np.array([1 if chr(b).isalnum() else 2 if 0x21 <= b < 0x7F and b != 0x27 else 0 for b in range(128)] + [0] * 128, np.uint8)
#: For the second hash of a stretch.
_OTHER = np.random.Generator(np.random.PCG64(50021)).integers(0, 1 << 64, 256, dtype=K.U)


def stretches(seg: np.ndarray, edge: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where stretches begin: at documents' ends, around single blanks (which go with what follows) and line feeds between plain characters, and between letters or digits and punctuation."""
    n = len(seg)
    solid_before = _PLAIN[seg].copy()
    tail = np.flatnonzero((seg >= 0x80) & (seg < 0xC0))
    tail = tail[tail > 0]
    solid_before[tail] = _LEAD[seg[tail - 1]]
    solid_after = _PLAIN[seg] | _LEAD[seg]
    doc_start, doc_end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    doc_start[edge[:-1]] = True
    doc_end[edge[1:]] = True
    at = np.flatnonzero((seg == 0x20) | (seg == 0x0A))
    at = at[(at > 0) & (at < n - 1)]
    at = at[solid_before[at - 1] & solid_after[at + 1] & ~doc_start[at] & ~doc_end[at + 1]]
    begin = np.zeros(n + 1, bool)
    begin[at] = True
    begin[at[seg[at] == 0x0A] + 1] = True
    kind = _KIND[seg]
    begin[1:n] |= (kind[1:] ^ kind[:-1]) == 3
    data = seg.tobytes() if special else b""
    for word in special:  # no cut within a special token
        at = data.find(word)
        while at >= 0:
            begin[at + 1 : at + len(word)] = False
            at = data.find(word, at + 1)
    begin[edge] = True
    begin[n] = False
    return np.flatnonzero(begin)


class Encoder:
    """Token ids by the `tokenizers` library, with a bounded memory of stretches by hash."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            made = json.load(f)
        kind = made.get("pre_tokenizer") or {}
        added = [a["content"] for a in made.get("added_tokens", [])]
        #: Whether stretches may be encoded by themselves.
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space", True) and not made.get("normalizer") and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in made.get("added_tokens", [])) and not any(c.isspace() for a in added for c in a)
        self.special = [a.encode() for a in added]
        self.clear()

    def clear(self) -> None:
        self.hash, self.check, self.at, self.count, self.ids = np.zeros(0, K.U), np.zeros(0, K.U), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and their numbers."""
        got = [e.ids for e in getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)(texts, add_special_tokens=False)]
        count = np.array([len(g) for g in got], np.int32)
        return np.fromiter((i for g in got for i in g), np.uint32, int(count.sum())), count

    def learn(self, h: np.ndarray, check: np.ndarray, texts: list[str]) -> None:
        if len(self.hash) + len(h) > REMEMBERED:
            self.clear()
        ids, count = self.plain(texts)
        at = (len(self.ids) + np.cumsum(count) - count).astype(np.int32)
        self.ids = np.concatenate([self.ids, ids])
        self.hash = np.concatenate([self.hash, h])
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        for name, new in (("check", check), ("at", at), ("count", count)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    def whole(self, seg: np.ndarray, edge: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        data = seg.tobytes()
        ids, count = self.plain([data[a:z].decode() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        ends = np.cumsum(count)
        return np.insert(ids, ends, end_id).astype(np.uint32), count.astype(np.int64) + 1

    def encode(self, buf: np.ndarray, off: np.ndarray, lo: int, hi: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents lo..hi one after another, each with end_id, and their lengths."""
        seg, edge = buf[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo]).astype(np.int64)
        if not len(seg):
            return np.full(hi - lo, end_id, np.uint32), np.ones(hi - lo, np.int64)
        if not self.cuts:
            return self.whole(seg, edge, end_id)
        start = stretches(seg, edge, self.special)
        end = np.append(start[1:], len(seg))
        up, down = K._power(len(seg) + 1)
        total, both = np.zeros(len(seg) + 1, K.U), []
        for table in (K._TABLE, _OTHER):
            np.cumsum(table[seg] * up[: len(seg)], out=total[1:])
            both.append(K.mix((total[end] - total[start]) * down[start] + (end - start).astype(K.U)))
        h, first, which = np.unique(both[0], return_index=True, return_inverse=True)
        which, check = which.ravel(), both[1][first]
        if not np.array_equal(check[which], both[1]):  # two stretches share 64 bits
            return self.whole(seg, edge, end_id)
        for again in range(2):
            where = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
            new = self.hash[where] != h if len(self.hash) else np.ones(len(h), bool)
            if not new.any():
                break
            if again or (len(self.hash) + int(new.sum()) > REMEMBERED and not new.all()):
                self.clear()
                new = np.ones(len(h), bool)
            data, f = seg.tobytes(), first[new]
            self.learn(h[new], check[new], [data[a:z].decode() for a, z in zip(start[f].tolist(), end[f].tolist(), strict=True)])
        where = np.searchsorted(self.hash, h)
        if not np.array_equal(self.check[where], check):
            return self.whole(seg, edge, end_id)
        where = where[which]
        count, doc = self.count[where].astype(np.int64), np.searchsorted(edge, start, "right") - 1
        length = np.bincount(doc, count, hi - lo).astype(np.int64) + 1
        ends = np.cumsum(length)
        out = np.empty(int(ends[-1]), np.uint32)
        out[ends - 1] = end_id
        to, _ = K.flat(np.cumsum(count) - count + doc, count)
        source, _ = K.flat(self.at[where], count)
        out[to] = self.ids[source]
        return out, length


_IDS = "part int, row long, doc_id long, before long, doc_tokens long, ids binary"


def _tokenise(vocabulary: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, row, before, encoder = TaskContext.get().partitionId(), 0, 0, K.held(vocabulary, lambda: Encoder(vocabulary))
        for b in batches:
            buf, off = K.text_buffer(b.column(1))
            for lo, hi in K.chunks(off):
                ids, length = encoder.encode(buf, off, lo, hi, end_id)
                narrow = ids.astype(np.uint16) if not len(ids) or ids.max() < 65536 else ids
                ends, width = np.cumsum(length), narrow.dtype.itemsize
                data = pa.py_buffer(narrow.tobytes())
                offsets = pa.py_buffer((np.append(0, ends) * width).astype(np.int32).tobytes())
                n = hi - lo
                yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(row + np.arange(n)), b.column(0).slice(lo, n), pa.array(before + ends - length), pa.array(length), pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])], schema=schema)
                row, before = row + n, before + int(ends[-1])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(size: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in schema]
            doc, n, at, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)
            for i in range(b.num_rows):
                raw, begin = ids[i].as_buffer(), 0
                own = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n[i] else np.uint32).astype("<u4")
                while begin < n[i]:
                    seq, offset = divmod(at[i] + begin, size)
                    m = min(size - offset, n[i] - begin)
                    for col, v in zip(out, (doc[i], begin, m, zlib.crc32(own[begin : begin + m].tobytes()), n[i], seq, offset), strict=True):
                        col.append(v)
                    begin += m
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The boundary records are the pieces that begin or end inside a document; the totals that reach the driver are one long per partition.
    """
    spark = docs.sparkSession
    ids = spool(keyed_text(docs).mapInArrow(K.tidy(_tokenise(vocabulary or default_vocabulary(), end_id), vocabulary or default_vocabulary()), _IDS), "ids")
    totals, base = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect(), []
    for t in totals:
        base.append((t["part"], base[-1][1] + base[-1][2] if base else 0, t["n"]))
    offsets = spark.createDataFrame([(p, o) for p, o, _ in base], "part int, base long")
    placed = ids.join(F.broadcast(offsets), "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(K.tidy(_cut(size)), _PIECES)
