"""Vectorised text kernels on Arrow string buffers: word bounds, rolling hashes, n-gram hashes, blobs for bucketed exchanges.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as `[^\\x20\\x09-\\x0D]+` on code points.
Hashes have 64 bits and are seeded; equal words or n-grams are taken as equal if their hashes are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20  # bytes that are hashed at once
_MASK = (1 << 64) - 1
_B = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20011)).integers(0, 1 << 64, 256, dtype=U)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: For comparison without regard to punctuation: every ASCII character that is no letter or digit separates words.
PUNCT = SPACE.copy()
PUNCT[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 2)
        for name, b in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together, or of one."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words(NamedTuple):
    """Words of documents lo..hi: byte positions in the chunk, hashes, and where each document's words begin (hi - lo + 1 entries)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(buf: np.ndarray, off: np.ndarray, lo: int, hi: int, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    seg = buf[off[lo] : off[hi]]
    edge = (off[lo : hi + 1] - off[lo]).astype(np.int64)
    n = len(seg)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, U), np.zeros(hi - lo + 1, np.int64))
    solid = ~space[seg]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[edge[:-1][edge[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edge[1:][edge[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return Words(start, end, _hashes(seg, start, end, _LOWER if lower else _TABLE), np.searchsorted(start, edge))


def _hashes(seg: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each word; in stretches of at most CHUNK bytes (or one word), so that memory does not depend on the length of a document."""
    out, i = np.empty(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        a, z = int(start[i]), int(end[j - 1])
        up, down = _power(z - a + 1)
        total = np.empty(z - a + 1, U)
        total[0] = 0
        np.cumsum(table[seg[a:z]] * up[: z - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n consecutive words at each position, documents' ends not regarded; empty if there are fewer than n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    acc = np.full(m, U((seed * 0x9E3779B97F4A7C15 + n) & _MASK), U)
    for j in range(n):
        acc *= U(0xD6E8FEB86659FD93)
        acc += h[j : j + m]
    return mix(acc)


def ngrams_at(h: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The same hashes, of the n words from each position in `at` only."""
    acc = np.full(len(at), U((seed * 0x9E3779B97F4A7C15 + n) & _MASK), U)
    for j in range(n):
        acc *= U(0xD6E8FEB86659FD93)
        acc += h[at + j]
    return mix(acc)


def grams_of(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: where its n-grams begin among those of ngrams(), and how many it has."""
    return first[:-1], np.maximum(0, np.diff(first) - n + 1)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def flat(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[i] .. start[i] + count[i] - 1 of all i in turn, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner], owner


# --- memory of the Python workers, which Spark keeps for later tasks ---

_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """One large object that a worker keeps from task to task, until a task of another kind begins in it."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, for mapInArrow: what other kinds of tasks hold goes before, and unused memory goes back to the system after."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in _held if k != name]:
            del _held[other]
        yield from run(batches)
        if not name:
            _powers.clear()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# --- blocks of documents, and an exchange by hash between them ---
#
# A block is some documents whose texts have at most BLOCK bytes together, or one document. Blocks ask parts about hashes, each hash
# once, however many of the block's documents have it, and parts answer blocks. So a hash that a third of all documents has costs a
# part one entry for each block, and no task ever holds all documents of a hash.

BLOCK = 4 << 20
ROW = "part int, block long, kind int, a binary, b binary, c binary"
TEXT, ASK, TELL = 0, 1, 2
_ROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
KEY = U((1 << 48) - 1)
_CODEC = pa.Codec("zstd", compression_level=1)


def row(part: int, block: int, kind: int, a: bytes, b: bytes = b"", c: bytes = b"") -> tuple:
    return part, block, kind, a, b, c


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), _ROW, strict=True)] if found else [pa.array([], f.type) for f in _ROW], schema=_ROW)


def batched(found: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` bytes."""
    held, size = [], 0
    for r in found:
        held.append(r)
        size += 64 + len(r[3]) + len(r[4]) + len(r[5])
        if size >= most:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def home(block: np.ndarray | int, parts: int):
    """The part that a block's text and answers go to; the blocks of a task, and those of all tasks, are spread evenly."""
    return ((block >> 32) + (block & 0xFFFFFFFF) * 7919) % parts


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """A part for each 48-bit key; ascends with the keys."""
    return (((key >> U(16)) * U(parts)) >> U(32)).astype(np.int64)


def narrow(key: np.ndarray) -> bytes:
    """48-bit keys in six bytes each."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def wide(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel().astype(U, copy=False)


def packed(values: np.ndarray) -> bytes:
    """Compressed; for figures that take few of their bits."""
    return _CODEC.compress(np.ascontiguousarray(values), asbytes=True)


def unpacked(data, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data, n * np.dtype(kind).itemsize), kind)


def slices(key: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """part, begin and end of each part's stretch of ascending keys."""
    part = part_of(key, parts)
    if len(part):
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        yield from zip(part[cut].tolist(), cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True)


class Text(NamedTuple):
    """A block's documents; buf[off[i] : off[i + 1]] is the text of ids[i]."""

    block: int
    ids: np.ndarray
    off: np.ndarray
    buf: np.ndarray

    def words(self, lower: bool = False) -> Words:
        """Of all documents of the block."""
        return words(self.buf, self.off, 0, len(self.ids), lower)


def text_rows(partition: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, size, a (ids), b (offsets), c (texts, compressed, since they go through two or three exchanges): the blocks of a task's documents."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = seq = 0

    def flush() -> pa.RecordBatch:
        lengths = np.concatenate([np.diff(o) for _, o, _ in held])
        off = np.append(0, np.cumsum(lengths)).astype(np.int64)
        return pa.record_batch([pa.array([(partition << 32) + seq]), pa.array([size]), pa.array([np.concatenate([i for i, _, _ in held]).astype(np.int64).tobytes()], pa.binary()), pa.array([off.tobytes()], pa.binary()), pa.array([_CODEC.compress(np.concatenate([b for *_, b in held]), asbytes=True)], pa.binary())], names=["block", "size", "a", "b", "c"])

    for b in batches:
        buf, off = text_buffer(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in chunks(off, BLOCK // 4):
            n = int(off[hi] - off[lo])
            if held and size + n > BLOCK:
                yield flush()
                held, size, seq = [], 0, seq + 1
            held.append((ids[lo:hi], off[lo : hi + 1], buf[off[lo] : off[hi]].copy()))
            size += n
    if held:
        yield flush()


def texts(b: pa.RecordBatch) -> Iterator[Text]:
    """The blocks in a batch that has the columns block, a, b, c."""
    for block, a, o, c in zip(b.column("block"), b.column("a"), b.column("b"), b.column("c"), strict=True):
        off = np.frombuffer(o.as_buffer(), np.int64)
        yield Text(block.as_py(), np.frombuffer(a.as_buffer(), np.int64), off, np.frombuffer(_CODEC.decompress(c.as_buffer(), int(off[-1])), np.uint8))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Text, list[tuple]]]:
    """Of each block that comes to a part: its text, and the answers to it as (a, b, c)."""
    text: dict[int, Text] = {}
    told: dict[int, list[tuple]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for t in texts(batch.take(pa.array(np.flatnonzero(kind == TEXT)))):
            text[t.block] = t
        own = batch.take(pa.array(np.flatnonzero(kind != TEXT)))
        for block, *cols in zip(own.column("block").to_pylist(), own.column("a"), own.column("b"), own.column("c"), strict=True):
            told.setdefault(block, []).append(tuple(c.as_buffer() for c in cols))
    for block in sorted(text):
        yield text.pop(block), told.pop(block, [])
