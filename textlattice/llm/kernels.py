"""Vectorised kernels over Arrow string columns: words, hashes, rolling windows.

Everything works on one flat byte buffer per chunk of rows, so the cost per byte
is a handful of numpy passes and memory is bounded by the chunk size (or by one
text, where a single text is larger than a chunk).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20

#: ASCII white space splits raw words: 0x20 and 0x09-0x0D.
RAW_WORD = np.ones(256, dtype=bool)
RAW_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and every byte above ASCII make alphanumeric words.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and leaves other bytes alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_P, _Q = 0x9E3779B97F4A7C13, 0xD1B54A32D192ED03  # odd, 3 mod 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; x is overwritten."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019) + U(lane * 7919 + 1))


_BYTES = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(lane: int, fold: bool) -> np.ndarray:
    if (lane, fold) not in _BYTES:
        t = _table(lane)
        _BYTES[lane, fold] = t[FOLD] if fold else t
    return _BYTES[lane, fold]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, CHUNK_BYTES + 64)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = both[0], both[1]
        if m > 4 * CHUNK_BYTES:  # one very long text: not kept
            return have
        _POWERS[base] = have
    return have


class Chunk:
    """Rows [first, first + n) of a column as one byte buffer and row offsets."""

    __slots__ = ("data", "off", "first", "n")

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if a.null_count:
        a = pc.fill_null(a, b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole rows of up to limit bytes; a null is an empty text."""
    first = 0
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(a):
            continue
        buf, off = _flat(a)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            j = min(j, len(a))
            yield Chunk(buf[off[i] : off[j]], off[i : j + 1] - off[i], first + i)
            i = j
        first += len(a)


def words(c: Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a chunk, and each row's first word (n + 1 offsets)."""
    size = len(c.data)
    if not size:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(c.n + 1, np.int64)
    w = table[c.data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[c.off] = True
    before = np.empty(size, dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(w & ~before)
    after = np.empty(size, dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, c.off)


def prefix(data: np.ndarray, lane: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums H of a polynomial hash and the inverse powers: (H[e] - H[s]) * inv[s] identifies bytes s..e."""
    p, inv = powers(_P, len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(byte_table(lane, fold)[data] * p[: len(data)], out=h[1:])
    return h, inv


#: Bytes from which a word is digested instead: powers modulo 2**64 can't tell some very long strings apart.
LONG_WORD = 256


def word_hashes(c: Chunk, starts: np.ndarray, ends: np.ndarray, lane: int = 0, fold: bool = False) -> np.ndarray:
    h, inv = prefix(c.data, lane, fold)
    out = mix((h[ends] - h[starts]) * inv[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = c.data[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((FOLD[word] if fold else word).tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def rolling(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position; the last k - 1 positions are left out."""
    if len(wh) < k:
        return np.zeros(0, dtype=U)
    q, inv = powers(_Q, len(wh) + 1)
    s = np.zeros(len(wh) + 1, dtype=U)
    np.cumsum(wh * q[: len(wh)], out=s[1:])
    return mix((s[k:] - s[:-k]) * inv[: len(wh) - k + 1])


def row_of(off: np.ndarray) -> np.ndarray:
    """The row of each item, from row offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def inside(off: np.ndarray, rows: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first n positions have k items left in their own row."""
    return np.arange(k, n + k) <= off[rows[:n] + 1]


def any_ahead(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each of n positions j: is any of flags[j : j + width] set?"""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    j = np.arange(n)
    return c[np.minimum(j + width, len(flags))] > c[np.minimum(j, len(flags))]


def covered(starts: np.ndarray, width, size: int) -> np.ndarray:
    """Positions under any of the spans [start, start + width)."""
    d = np.zeros(size + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, size), -1)
    return np.cumsum(d[:-1]) > 0


def runs(flags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags that don't cross rows: starts, ends, and run offsets by row."""
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate(([False], flags[:-1])) & ~edge[:-1] if len(flags) else flags
    after = np.concatenate((flags[1:], [False])) & ~edge[1:] if len(flags) else flags
    s, e = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    return s, e, np.searchsorted(s, off)


class Members:
    """Membership in a sorted set of 64-bit keys, by a bit table before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, min(24, int(len(keys) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[(keys & U((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of x that are members, and the places of their keys."""
        if not len(self.keys) or not len(x):
            z = np.zeros(0, np.int64)
            return z, z
        at = np.flatnonzero(self.seen[(x & U((1 << self.bits) - 1)).astype(np.int64)])
        k = np.searchsorted(self.keys, x[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == x[at]
        return at[ok], k[ok]


# ---- packed columns: sorted keys take little more than their information content


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance, so that a general compressor finds the constant ones."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(v: np.ndarray) -> bytes:
    """Elias-Fano coding of ascending uint64 values: low bytes plain, high parts as a bit vector."""
    n = len(v)
    if not n:
        return b""
    base = v[0]
    d = v - base
    low, top = 0, int(d[-1])
    while (top >> (8 * low)) > 8 * n + 64:
        low += 1
    hi = (d >> U(8 * low)).astype(np.int64) if low < 8 else np.zeros(n, np.int64)
    bits = np.zeros(int(hi[-1]) + n, dtype=np.uint8)
    bits[hi + np.arange(n)] = 1
    lows = d.view(np.uint8).reshape(n, 8)[:, :low].T.tobytes()
    return np.array([n, base, low], dtype=U).tobytes() + lows + np.packbits(bits).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype=U)
    n, base, low = (int(x) for x in np.frombuffer(b, dtype=U, count=3))
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :low] = np.frombuffer(b, np.uint8, count=n * low, offset=24).reshape(low, n).T
    hi = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, offset=24 + n * low)))[:n] - np.arange(n)
    d = out.view(U).ravel()
    if low < 8:
        d = d + (hi.astype(U) << U(8 * low))
    return d + U(base)


def strings(data: np.ndarray, off: np.ndarray, kind=pa.string()) -> pa.Array:
    """An Arrow string column over a byte buffer."""
    if len(data) < 1 << 31:
        return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    raise ValueError("a batch holds over 2 GB of text")


def spans_array(starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> pa.Array:
    """array<struct<start, end>> by row."""
    s = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), s)


def row_spans(flags: np.ndarray, off: np.ndarray) -> pa.Array:
    """Runs of set flags as array<struct<start, end>>, counted from the start of each row."""
    s, e, by_row = runs(flags, off)
    base = np.repeat(off[:-1], np.diff(by_row))
    return spans_array(s - base, e - base, by_row)
