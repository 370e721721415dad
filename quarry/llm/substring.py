"""Substring deduplication by relative Lempel-Ziv parsing.

The reference against which a document is parsed is everything that documents with smaller ids hold. It lies in blocks, and all blocks
are indexed by the hashes of their windows of `width` consecutive words:

1. Each block asks, once for each of its windows, which ones other blocks hold too (48 bits of hash, which only sieve).
2. For those, it sends where its smallest document has the window, under 128 bits of hash; the index answers with the document of the
   smallest id that has it, and the position there. So every window that can be copied has a source: document and position.
3. Each document is then factored greedily from left to right: a factor begins at the first window that can be copied and goes on for
   as long as the next window continues in the same source; elsewhere one literal word is taken. A factor ends where its source's
   match ends, but a window of another source can lie across that end: so the windows that begin in a factor's last words are
   checked, and the next factor, if there is one, begins right at the end of the one before. The words of all factors, each at least one window long
   with its overlap, are the duplicate spans.

Defined results: null text counts as empty (no words, nothing removed, the hash of the empty string). Rows with the same doc_id
are one each, and never copy from each other. A document shorter than `width` keeps all words. Rows without doc_id are left out.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import asked, blocks, drop, parts_of, spool, together

WIDTH = 13


class Windows:
    """All windows of a block: position among the block's words, and document."""

    def __init__(self, text: K.Text, width: int):
        self.words = text.words()
        self.width = width
        self.begin, self.owner = K.flat(*K.grams_of(self.words.first, width))
        self.hash = K.ngrams(self.words.hash, width)[self.begin]
        self.key = self.hash & K.KEY
        self.doc = text.ids[self.owner]
        self.at = self.begin - self.words.first[self.owner]  # position in the document

    def second(self, own: np.ndarray) -> np.ndarray:
        """64 more bits of hash for some windows."""
        return K.ngrams_at(self.words.hash, self.begin[own], self.width, seed=1)


def keys_of(text: K.Text, width: int) -> np.ndarray:
    """The 48-bit keys of a block's windows."""
    w = text.words()
    at, _ = K.flat(*K.grams_of(w.first, width))
    return K.ngrams(w.hash, width)[at] & K.KEY


def _ask(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for b in batches:
                for text in K.texts(b):
                    key = K.distinct(keys_of(text, width))
                    for part, a, z in K.slices(key, parts):
                        yield K.row(part, text.block, K.ASK, K.narrow(key[a:z]))

        yield from K.batched(found())

    return run


def _sieve(parts: int):
    """Tells each block which of its windows another block asks about too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys = [], []
        for b in batches:
            block += b.column("block").to_pylist()
            keys += [K.wide(a.as_buffer()) for a in b.column("a")]
        if not keys:
            return
        of = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        key = np.concatenate(keys)
        keys.clear()
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same)
        key, of = key[shared], of[shared]
        order = np.argsort(of, kind="stable")
        key, of = key[order], of[order]
        cut = np.searchsorted(of, np.arange(len(block) + 1))
        yield from K.batched(K.row(K.home(n, parts), n, K.TELL, K.narrow(key[cut[i] : cut[i + 1]])) for i, n in enumerate(block) if cut[i + 1] > cut[i])

    return run


def _least(w: Windows, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows `own`: their order by both hashes, where each group of equal ones begins in it, both hashes, and each group's first window by document and position."""
    h, second = w.hash[own], w.second(own)
    order = np.lexsort((w.at[own], w.doc[own], second, h))
    h, second = h[order], second[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (second[1:] != second[:-1]))) if len(h) else np.zeros(0, np.int64)
    return order, begin, h[begin], second[begin], own[order[begin]]


def _shared(w: Windows, told: list[tuple]) -> np.ndarray:
    """The windows that other blocks hold too."""
    key = K.distinct(np.concatenate([K.wide(a) for a, *_ in told])) if told else np.zeros(0, K.U)
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(key[np.minimum(np.searchsorted(key, w.key), len(key) - 1)] == w.key)


def _offer(width: int, parts: int):
    """Sends the first place in the block of each window that other blocks hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for text, told in K.met(batches):
                w = Windows(text, width)
                own = _shared(w, told)
                if not len(own):
                    continue
                *_, h, second, first = _least(w, own)
                order = np.argsort(h & K.KEY, kind="stable")
                h, second, first = h[order], second[order], first[order]
                for part, a, z in K.slices(h & K.KEY, parts):
                    yield K.row(part, text.block, K.ASK, np.stack([h[a:z], second[a:z]]).tobytes(), K.packed(w.doc[first[a:z]]), K.packed(w.at[first[a:z]].astype(np.uint32)))

        yield from K.batched(found())

    return run


def _places(a, d, p) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, document and position, as they travel."""
    h, second = np.frombuffer(a, K.U).reshape(2, -1)
    return h, second, K.unpacked(d, np.int64, len(h)), K.unpacked(p, np.uint32, len(h))


def _index(parts: int):
    """Tells each block where the smallest document has a window, if that is smaller than the block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cols = [], []
        for b in batches:
            block += b.column("block").to_pylist()
            cols += [_places(a.as_buffer(), d.as_buffer(), p.as_buffer()) for a, d, p in zip(b.column("a"), b.column("b"), b.column("c"), strict=True)]
        if not cols:
            return
        of = np.repeat(np.arange(len(cols), dtype=np.uint32), [len(c[0]) for c in cols])
        h, second, doc, at = (np.concatenate(c) for c in zip(*cols, strict=True))
        cols.clear()
        order = np.lexsort((at, doc, second, h))
        h, second, doc, at, of = h[order], second[order], doc[order], at[order], of[order]
        begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (second[1:] != second[:-1])))
        first = np.repeat(begin, np.diff(np.append(begin, len(h))))
        late = np.flatnonzero(doc > doc[first])
        late = late[np.argsort(of[late], kind="stable")]
        cut = np.searchsorted(of[late], np.arange(len(block) + 1))

        def found():
            for i, n in enumerate(block):
                own = late[cut[i] : cut[i + 1]]
                if len(own):
                    yield K.row(K.home(n, parts), n, K.TELL, np.stack([h[own], second[own]]).tobytes(), K.packed(doc[first[own]]), K.packed(at[first[own]]))

        yield from K.batched(found())

    return run


def sources(w: Windows, told: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that a smaller document has: their places among w's, the document, and the position there."""
    order = np.argsort(w.hash, kind="stable")
    same = w.hash[order[1:]] == w.hash[order[:-1]]
    again = np.zeros(len(order), bool)
    again[order] = np.append(same, False) | np.append(False, same)
    if told:
        h, second, doc, at = (np.concatenate(c) for c in zip(*(_places(*t) for t in told), strict=True))
        known, at = np.stack([h, second]), at.astype(np.int64)
        by = np.lexsort((known[1], known[0]))
        known, doc, at = known[:, by], doc[by], at[by]
        again |= known[0][np.minimum(np.searchsorted(known[0], w.hash), len(doc) - 1)] == w.hash
    own = np.flatnonzero(again)
    order, begin, h, second, first = _least(w, own)
    from_doc, from_at = w.doc[first], w.at[first]
    if told and len(h):
        both = np.concatenate([known, np.stack([h, second])], axis=1)
        by = np.lexsort((np.arange(both.shape[1]), both[1], both[0]))  # what was told stands before the block's own
        hit = np.flatnonzero((by[1:] >= len(doc)) & (by[:-1] < len(doc)) & (both[:, by[1:]] == both[:, by[:-1]]).all(axis=0))
        to, told_at = by[hit + 1] - len(doc), by[hit]
        from_doc[to], from_at[to] = doc[told_at], at[told_at]
    group = np.empty(len(own), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(own))))
    late = w.doc[own] > from_doc[group]
    return own[late], from_doc[group[late]], from_at[group[late]]


def factors(at: np.ndarray, doc: np.ndarray, source: np.ndarray, width: int) -> np.ndarray:
    """The greedy parse of one document, from the windows that can be copied (ascending), their source documents and positions there.

    Rows of begin, end, source document, source begin; a factor begins where the one before ends, if they overlap.
    """
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (source[1:] != source[:-1] + 1)
    first = np.flatnonzero(new)
    end = at[np.append(first[1:], len(at)) - 1] + width if len(at) else np.zeros(0, np.int64)
    over = np.zeros(len(first), np.int64)
    over[1:] = np.maximum(0, end[:-1] - at[first[1:]])  # windows across the boundary
    return np.stack([at[first] + over, end, doc[first], source[first] + over], axis=1)


def spans(parsed: np.ndarray) -> np.ndarray:
    """Begin and end of what factors cover, joined where they touch."""
    if not len(parsed):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.append(True, parsed[1:, 0] > parsed[:-1, 1]))
    return np.stack([parsed[first, 0], parsed[np.append(first[1:], len(parsed)) - 1, 1]], axis=1)


_COLUMNS = {"doc_id": "long", "n_words": "long", "n_removed": "long", "spans": "string", "kept_sha256": "string", "factors": "string", "kept_text": "string"}


def _parse(width: int, names: list[str]):
    schema = pa.schema([(n, pa.int64() if _COLUMNS[n] == "long" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, told in K.met(batches):
            w = Windows(text, width)
            own, doc, source = sources(w, told)
            cut = np.searchsorted(w.owner[own], np.arange(len(text.ids) + 1))
            data, out, words = text.buf.tobytes(), [], w.words
            for i, doc_id in enumerate(text.ids.tolist()):
                a, z = int(words.first[i]), int(words.first[i + 1])
                mine = slice(cut[i], cut[i + 1])
                parsed = factors(w.at[own[mine]], doc[mine], source[mine], width) if cut[i + 1] > cut[i] else np.zeros((0, 4), np.int64)
                gone = spans(parsed)
                kept, last = [], 0
                for s, e in [*gone.tolist(), (z - a, z - a)]:
                    if s > last:
                        kept += data[words.start[a + last] : words.end[a + s - 1]].split()
                    last = e
                left = b" ".join(kept)
                out.append({"doc_id": doc_id, "n_words": z - a, "n_removed": z - a - len(kept), "spans": ",".join(f"{s}:{e}" for s, e in gone.tolist()), "kept_sha256": hashlib.sha256(left).hexdigest(), "factors": ",".join("{}:{}:{}:{}".format(*f) for f in parsed.tolist()), "kept_text": left})
            yield pa.record_batch([pa.array([r[n].decode() if n == "kept_text" else r[n] for r in out], schema.field(n).type) for n in names], schema=schema)

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words as begin:end, in words), kept_sha256, factors (begin:end:source document:source
    begin) and, if wanted, kept_text; one row per document."""
    text = blocks(docs)
    n = parts_of(text)
    sieved = spool(asked(text, _ask(width, n), n).mapInArrow(K.tidy(_sieve(n)), K.ROW), "sieved")
    offers = together(text, sieved, n).mapInArrow(K.tidy(_offer(width, n)), K.ROW).repartitionById(n, "part")
    told = spool(offers.mapInArrow(K.tidy(_index(n)), K.ROW), "told")
    drop(sieved)
    names = list(_COLUMNS)[: None if with_text else -1]
    return together(text, told, n).mapInArrow(K.tidy(_parse(width, names)), ", ".join(f"{c} {_COLUMNS[c]}" for c in names))
