"""Suffix-array dedup: every 100-byte string that also starts earlier is removed.

Sorting all suffixes of a corpus in one place isn't possible, so equal strings are
first brought together without sorting: the least hash among a 100-byte string's
32-byte grams depends on the string alone, so equal strings share it.

1. Each group of documents sends its distinct least hashes, sorted and packed, to
   hash buckets and learns which occur anywhere else. A string whose hash occurs
   once is unique. (Whole equal documents are found alongside.)
2. For the others, the run of strings with one least gram goes to the hash's bucket
   as one segment of up to 168 bytes; equal segments of a group go once, with their
   first place. In a bucket the distinct segments are concatenated and their suffix
   array is built by two-stage sorting: only suffixes smaller than their successors
   are sorted directly (to 100 bytes), the others are induced by scanning the
   buckets of first bytes in order; common prefixes of neighbours then give classes
   of equal 100-byte strings, and each class its first place.
3. The places of all later strings return to their groups by the segment's number,
   which names its bytes as well as its place, and are cut out of the rows that hold
   that segment there.

A passage that a third of all documents share is one segment per group. Where it
begins and ends, though, each document has a segment of its own under the same hash,
and a hash with many different segments is hot. Its strings take step 1 once more, by
a hash of all their bytes: a string whose hash occurs once is unique, and the others
go, 100 bytes each, to the bucket of that hash, where they are sorted like segments.

Hashes only ever decide where strings meet and which can't repeat; that two are equal
is seen in their bytes (of whole copies in 120 bits of a digest).

Defined results: a null text counts as empty; texts under 100 bytes keep everything;
a null id counts as larger than any other (but as equal to 2**63 - 1) and stays null;
rows that repeat an id count as one document whose places are compared by their
starts; an empty table gives none; other columns are ignored. What is kept is binary,
as a cut can fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlattice.llm import kernels as K
from textlattice.llm.common import BUCKET_BYTES, GROUP_BYTES, grouped_docs, parts_for, power_of_two, text_bytes
from textlattice.llm.exact_substring import _late, by_bucket, copies, distinct_flagged, doc_rows, later_docs
from textlattice.llm.exchange import Exchange, flat

U = K.U
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams in a string
POSITION_BITS = 20
HASH_BITS = 64 - POSITION_BITS
SEPARATOR = 0xFF  # no byte of UTF-8
#: A bucket is sorted in so many parts by its hashes, one after the other.
PARTS = 16
#: A hash is hot with so many different segments in one group, beyond one per group in all groups, or in so many groups.
HOT = 64, 512, 4096


# ---- the suffix array of a buffer, as far as it is needed


def words8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; zeros beyond the end."""
    out = np.zeros(len(t) + LENGTH + 16, dtype=U)
    padded = np.concatenate((t, np.zeros(LENGTH + 24, dtype=np.uint8)))
    for k in range(8):
        out |= padded[k : k + len(out)].astype(U) << U(56 - 8 * k)
    return out


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the empty suffix is the smallest."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[-1:] = -1
    at = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return step[nxt] > 0


def sort_directly(p: np.ndarray, w8: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first depth bytes: 8 bytes a round, only among what still ties."""
    p = p[np.argsort(w8[p], kind="stable")]
    if not len(p):
        return p
    key = w8[p]
    new = np.ones(len(p), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        q, g = p[tied], group[tied]
        key = w8[np.minimum(q + d, len(w8) - 1)]
        order = np.lexsort((key, g))
        p[tied], key = q[order], key[order]  # groups stand together, so g itself stays as it is
        change = np.ones(len(tied), dtype=bool)
        change[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        new[tied] = change
    return p


def suffix_order(t: np.ndarray, wanted: np.ndarray, w8: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Two-stage sorting: the wanted positions (and those that they are induced from) by their first depth bytes."""
    n = len(t)
    small = smaller_than_next(t)
    # a larger suffix is induced from its successor, so that is needed too, down to a directly sorted one
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(small, np.arange(n), -1))[:-1]))
    many = np.concatenate(([0], np.cumsum(wanted)))
    need = many[1:] > many[before + 1]
    direct = sort_directly(np.flatnonzero(need & small), w8, depth)
    first = t[direct]
    cut = np.searchsorted(first, np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and need[-1] and not small[-1]:  # induced from the empty suffix
        queue[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        now = np.concatenate(queue[c]) if queue[c] else np.zeros(0, dtype=np.int64)
        queue[c] = []
        parts = [now]
        while len(now):  # larger suffixes that start with the same byte as their successors
            now = now[now > 0] - 1
            now = now[(t[now] == c) & need[now]]
            parts.append(now)
        full = np.concatenate([*parts, direct[cut[c] : cut[c + 1]]])
        if not len(full):
            continue
        out.append(full)
        prev = full[full > 0] - 1
        prev = prev[(t[prev] > c) & need[prev]]
        if not len(prev):
            continue
        heads = t[prev]
        order = np.argsort(heads, kind="stable")
        prev, heads = prev[order], heads[order]
        edge = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
        for s, e in zip(edge, [*edge[1:], len(heads)], strict=True):
            queue[int(heads[s])].append(prev[s:e])
    sa = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return sa[wanted[sa]]


def common_prefixes(sa: np.ndarray, w8: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """How many of the first depth bytes each neighbour pair of the order has in common."""
    out = np.full(max(0, len(sa) - 1), depth, dtype=np.int64)
    at = np.arange(len(out))
    for d in range(0, depth, 8):
        x = w8[sa[at] + d] ^ w8[sa[at + 1] + d]
        miss = x != 0
        first = x[miss]
        out[at[miss]] = d + sum((first < U(1) << U(8 * k)).astype(np.int64) for k in range(8))
        at = at[~miss]
    return np.minimum(out, depth)


# ---- least grams and their segments


def segments(c: K.Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(base, rows, first string, end of the last string, hash) of the runs of strings with one least gram, by slices of bounded size."""
    size = 1 << POSITION_BITS
    rows = np.repeat(np.arange(c.n, dtype=np.int32), np.diff(c.off))
    for base in range(0, max(1, len(c.data) - LENGTH + 1), size - LENGTH + 1):
        data = c.data[base : base + size]
        n = len(data) - LENGTH + 1
        if n <= 0:
            return
        h, inv = K.prefix(data, 0, False)
        r = K.mix((h[GRAM:] - h[:-GRAM]) * inv[: len(data) - GRAM + 1])
        v = (r >> U(POSITION_BITS) << U(POSITION_BITS)) | np.arange(len(r), dtype=U)
        width = 1
        while 2 * width <= SPAN:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        least = np.minimum(v[:n], v[SPAN - width : SPAN - width + n])
        # strings that lie in one row
        row = rows[base : base + n]
        whole = row == rows[base + LENGTH - 1 : base + LENGTH - 1 + n]
        new = np.ones(n, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
        s = np.flatnonzero(new & whole)
        last = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        # least hashes crowd near zero, so they are mixed anew before buckets take their leading bits
        yield base, row[s].astype(np.int64), s + base, last + base + LENGTH, K.mix(least[s] >> U(POSITION_BITS)) >> U(POSITION_BITS)


def send_grams(n_buckets: int, hot: tuple[int, int, int] = HOT):
    def f(t: pa.Table) -> pa.Table:
        hashes, contents = [np.zeros(0, U)], [np.zeros(0, U)]
        for c in K.chunks(t["text"]):
            h2, inv = K.prefix(c.data, 1, False)
            for _, _, s, e, h in segments(c):
                hashes.append(h)
                contents.append((h2[e] - h2[s]) * inv[s])
        v = coded(np.concatenate(hashes), np.concatenate(contents), hot[0])
        g = t["g"][0].as_py()
        docs = doc_rows(t["id"].to_numpy(), t["text"], n_buckets)
        out = {b: v[s:e] for b, s, e in by_bucket(v, HASH_BITS + 3, n_buckets)}
        at = sorted({*out, *docs})
        return pa.table({"bucket": pa.array(at, pa.int32()), "g": pa.array([g] * len(at), pa.int32()), "keys": pa.array([K.pack(out[b]) if b in out else None for b in at], pa.binary()), "docs": pa.array([docs.get(b) for b in at], pa.binary())})

    return f


def coded(h: np.ndarray, content: np.ndarray, hot_in_group: int) -> np.ndarray:
    """Distinct hashes, ascending; their low 3 bits: seen more than once, and 0 to 3 for 1, 2, 8 or hot_in_group different segments and more."""
    order = np.lexsort((content, h))
    h, content = h[order], content[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    other = new.copy()
    other[1:] |= content[1:] != content[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return h
    times = np.diff(np.append(first, len(h)))
    different = np.add.reduceat(other.astype(np.int64), first)
    code = np.searchsorted([2, 8, hot_in_group], different, side="right")
    return (h[first] << U(3)) | (code.astype(U) << U(1)) | (times > 1)


def repeated(v: np.ndarray, who: np.ndarray, flag_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all groups (bit 0 of their flags: seen more than once), sorted: keys, flags, groups, and which occur at another place too."""
    order = np.argsort(v >> U(flag_bits), kind="stable")
    v, who = v[order], who[order]
    h, flags = v >> U(flag_bits), v & U((1 << flag_bits) - 1)
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return h, flags, who, new
    times = np.diff(np.append(first, len(h))) + np.add.reduceat((flags & U(1)).astype(np.int64), first)
    return h, flags, who, (times > 1)[np.cumsum(new) - 1]


def _by_sender(keys: np.ndarray, who: np.ndarray, n: int) -> dict[int, bytes]:
    """Ascending keys packed for each of n senders that has some."""
    order = np.argsort(who, kind="stable")
    keys, who = keys[order], who[order]
    cut = np.searchsorted(who, np.arange(n + 1))
    return {i: K.pack(keys[cut[i] : cut[i + 1]]) for i in range(n) if cut[i] < cut[i + 1]}


def meet_grams(hot: tuple[int, int, int] = HOT):
    """To each group those of its hashes that occur at another place too, with a low bit for the hot ones."""

    def f(t: pa.Table) -> pa.Table:
        g = t["g"].to_numpy()
        got = [K.unpack(x.as_py()) if x.is_valid else np.zeros(0, U) for x in t["keys"].combine_chunks()]
        late = later_docs([x.as_py() for x in t["docs"].combine_chunks()], g)
        h, flags, who, hit = repeated(np.concatenate(got), np.repeat(np.arange(len(got)), [len(x) for x in got]), 3)
        if len(h):
            new = np.concatenate(([True], h[1:] != h[:-1]))
            first = np.flatnonzero(new)
            excess = np.add.reduceat(np.array([0, 1, 7, hot[1]])[(flags >> U(1)).astype(np.int64)], first)
            is_hot = (excess >= hot[1]) | (np.diff(np.append(first, len(h))) >= hot[2])
            h = (h << U(1)) | is_hot[np.cumsum(new) - 1]
        hits = {int(g[i]): b for i, b in _by_sender(h[hit], who[hit], len(got)).items()}
        to = sorted({*hits, *late})
        return pa.table({"g": pa.array(to, pa.int32()), "hits": pa.array([hits.get(x) for x in to], pa.binary()), "late": pa.array([late.get(x) for x in to], pa.binary())})

    return f


def _ties(head: np.ndarray, tied: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places head to head + tied of the picked classes, one after the other, and for each the index into pick."""
    n = tied[pick]
    of = np.repeat(np.arange(len(pick)), n)
    return head[pick[of]] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of


def equal_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the runs of bytes from a and from b agree; each has 8 bytes or more. data: with 7 bytes of room at its end."""
    words = np.ndarray(max(0, len(data) - 7), dtype=U, buffer=data, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    at = np.arange(len(a))
    for d in range(0, int(size.max()) if len(size) else 0, 8):
        at = at[size[at] > d]
        step = np.minimum(d, size[at] - 8)  # the last step looks at the last 8 bytes
        ok = words[a[at] + step] == words[b[at] + step]
        same[at[~ok]] = False
        at = at[ok]
    return same


def bytes_from(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of bytes, one after the other."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    step = np.arange(n, dtype=np.int32) if n < 1 << 31 else np.arange(n)
    step += np.repeat((at - (ends - size)).astype(step.dtype), size)
    return data[step]


class Units:
    """Segments, or single strings, of a group with their places; equal ones stand together, the earliest first."""

    def __init__(self, ids: np.ndarray, parts: list[tuple]):
        """parts: by chunk its bytes, where in them the units start, and row, start in the row, size, hash and content hash of each."""
        chunks, size = {}, 0  # several parts can come from one chunk
        for p in parts:
            if id(p[0]) not in chunks:
                chunks[id(p[0])] = size, p[0]
                size += len(p[0])
        self.data = np.concatenate([*(data for _, data in chunks.values()), np.zeros(8, np.uint8)])
        self.at = np.concatenate([p[1] + chunks[id(p[0])][0] for p in parts]) if parts else np.zeros(0, np.int64)
        self.row, self.start, self.size, self.hash, self.content = (np.concatenate(x) if x else np.zeros(0, U if k > 2 else np.int64) for k, x in enumerate([[p[k] for p in parts] for k in range(2, 7)]))
        self.id = ids[self.row]
        o = self.order = np.lexsort((self.start, self.id, self.size, self.content, self.hash))
        same = np.zeros(len(o), dtype=bool)
        same[1:] = (self.hash[o][1:] == self.hash[o][:-1]) & (self.content[o][1:] == self.content[o][:-1]) & (self.size[o][1:] == self.size[o][:-1])
        at = np.flatnonzero(same)
        same[at] = equal_runs(self.data, self.at[o[at - 1]], self.at[o[at]], self.size[o[at]])
        self.head = np.flatnonzero(~same)
        self.first = o[self.head]
        lead = self.first[np.cumsum(~same) - 1] if len(o) else o
        late = (self.id[o] > self.id[lead]) | (self.id[o] == self.id[lead]) & (self.start[o] > self.start[lead])
        self.later = o[same & late]
        # how many equal units share the first place: rows that repeat an id can
        self.tied = np.add.reduceat((~late).astype(np.int64), self.head) if len(o) else self.head

    def at_place(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units at the first places with these numbers (the order of first), and for each the index of its number."""
        at, of = _ties(self.head, self.tied, number)
        return self.order[at], of

    def messages(self, n_buckets: int) -> dict[int, dict[str, bytes]]:
        """The distinct units with their first places and numbers, by bucket of their hashes."""
        pick = self.first
        body = bytes_from(self.data, self.at[pick], self.size[pick])
        ends = np.concatenate(([0], np.cumsum(self.size[pick])))
        shift = HASH_BITS - (n_buckets * PARTS).bit_length() + 1
        out = {}
        for b, s, e in by_bucket(self.hash[pick].astype(U), HASH_BITS, n_buckets):
            own = pick[s:e]
            part = (self.hash[own].astype(U) >> U(shift)).astype(np.int64) % PARTS
            out[b] = {
                "sizes": np.bincount(part, minlength=PARTS).astype(np.uint32).tobytes() + self.size[own].astype(np.uint8).tobytes(),
                "places": K.planes(self.id[own].astype(np.int64)) + K.planes(self.start[own].astype(np.int64)) + K.planes(np.arange(s, e)),
                "body": body[ends[s] : ends[e]].tobytes(),
            }
        return out


def _found(t: pa.Table, told: dict, copy: np.ndarray) -> Iterator[tuple]:
    """The segments whose hash occurs elsewhere too, in rows that aren't copies as a whole: chunk, content prefix sums, row, start, end, hash, hot."""
    hits = [K.unpack(x.as_py()) for x in told["hits"] if x.is_valid]
    if not hits:
        return
    keys = np.sort(np.concatenate(hits))
    known, is_hot = K.Members(keys >> U(1)), (keys & U(1)).astype(bool)
    for c in K.chunks(t["text"]):
        sums = K.prefix(c.data, 1, False)
        for _, row, s, e, h in segments(c):
            at, k = known.find(h)
            ok = ~copy[c.first + row[at]]
            at, k = at[ok], k[ok]
            yield c, sums, row[at], s[at], e[at], h[at], is_hot[k]


def _content(sums: tuple[np.ndarray, np.ndarray], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return K.mix((sums[0][e] - sums[0][s]) * sums[1][s])


def cold_part(c: K.Chunk, sums: tuple, row: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, hot: np.ndarray) -> tuple:
    row, s, e, h = row[~hot], s[~hot], e[~hot], h[~hot]
    return c.data, s, c.first + row, s - c.off[row], e - s, h, _content(sums, s, e)


def hot_part(c: K.Chunk, sums: tuple, row: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, hot: np.ndarray) -> tuple:
    """Every string of the hot segments by itself."""
    n = (e - s)[hot] - LENGTH + 1
    w = np.repeat(s[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    of, content = np.repeat(row[hot], n), _content(sums, w, w + LENGTH)
    return c.data, w, c.first + of, w - c.off[of], np.full(len(w), LENGTH), content >> U(POSITION_BITS), content


class Again:
    """Collects the strings of hot segments that a group was told to occur elsewhere too."""

    def __init__(self, told: dict):
        keys = [K.unpack(x.as_py()) for x in told["again"] if x.is_valid]
        self.known = K.Members(np.sort(np.concatenate(keys))) if keys else None
        self.parts: list[tuple] = []

    def add(self, found: tuple) -> None:
        if self.known and found[-1].any():
            p = hot_part(*found)
            at, _ = self.known.find(p[6] >> U(2))
            self.parts.append((p[0], *(x[at] for x in p[1:])))


def _rows(g: int, rows: dict[int, dict[str, bytes]], columns: list[str]) -> pa.Table:
    at = sorted(rows)
    return pa.table({"bucket": pa.array(at, pa.int32()), "g": pa.array([g] * len(at), pa.int32()), **{x: pa.array([rows[b].get(x) for b in at], pa.binary()) for x in columns}})


def send_segments(n_buckets: int):
    def f(t: pa.Table, told: dict) -> pa.Table:
        if not len(t):
            return _rows(0, {}, SENT)
        copy = copies(t["id"].to_numpy(), t["text"], _late(told))
        cold, keys = [], [np.zeros(0, U)]
        for found in _found(t, told, copy):
            cold.append(cold_part(*found))
            if found[-1].any():
                keys.append(hot_part(*found)[6])
        rows = Units(t["id"].to_numpy(), cold).messages(n_buckets)
        key = distinct_flagged(np.concatenate(keys) >> U(2) << U(1), 1)  # 62 bits, none, seen more than once
        for b, s, e in by_bucket(key, 64, n_buckets):
            rows.setdefault(b, {})["strings"] = K.pack(key[s:e])
        return _rows(t["g"][0].as_py(), rows, SENT)

    return f


def send_strings(n_buckets: int):
    def f(t: pa.Table, told: dict) -> pa.Table:
        again = Again(told)
        if not len(t) or not again.known:
            return _rows(0, {}, BODIES)
        for found in _found(t, told, copies(t["id"].to_numpy(), t["text"], _late(told))):
            again.add(found)
        return _rows(t["g"][0].as_py(), Units(t["id"].to_numpy(), again.parts).messages(n_buckets), BODIES)

    return f


GRAMS, HITS, BODIES = ["keys", "docs"], ["hits", "late"], ["sizes", "places", "body"]
SENT, ANSWERS, MORE = [*BODIES, "strings"], ["spans", "again"], ["more"]
TOLD = [*HITS, *ANSWERS, *MORE]


def _distinct(size: np.ndarray, off: np.ndarray, body: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal units stand together, the earliest first, and which of it are the first."""
    h, inv = K.prefix(body, 0, False)
    e = off + size
    content = K.mix((h[e] - h[off]) * inv[off])
    order = np.lexsort((start, ids, size, content))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1])
    at = np.flatnonzero(~new)
    room = np.concatenate((body, np.zeros(8, np.uint8)))
    new[at] = ~equal_runs(room, off[order[at - 1]], off[order[at]], size[order[at]].astype(np.int64))
    return order, new


def later_strings(body: np.ndarray, size: np.ndarray, off: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (segment, from, to) of the strings that have an earlier equal, of segments that all differ."""
    n = len(size)
    new_off = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    t = np.full(int(size.sum()) + n, SEPARATOR, dtype=np.uint8)
    keep = np.ones(len(t), dtype=bool)
    keep[new_off + size] = False
    t[keep] = bytes_from(body, off, size)
    count = size - LENGTH + 1
    seg = np.repeat(np.arange(n), count)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = new_off[seg] + within
    wanted = np.zeros(len(t), dtype=bool)
    wanted[place] = True
    number = np.zeros(len(t), dtype=np.int64)
    number[place] = np.arange(len(place))
    w8 = words8(t)
    sa = suffix_order(t, wanted, w8)
    cls = np.concatenate(([0], np.cumsum(common_prefixes(sa, w8) < LENGTH))) if len(sa) else np.zeros(0, np.int64)
    x = number[sa]
    wid, wat = ids[seg][x], (start[seg] + within)[x]
    order = np.lexsort((wat, wid, cls))
    head = np.ones(len(order), dtype=bool)
    head[1:] = cls[order][1:] != cls[order][:-1]
    lead = order[head][cls[order]] if len(order) else order
    late = (wid[order] > wid[lead]) | (wid[order] == wid[lead]) & (wat[order] > wat[lead])
    flags = np.zeros(len(place), dtype=bool)
    flags[x[order[late]]] = True
    s, e, _ = K.runs(flags, np.concatenate(([0], np.cumsum(count))))
    return seg[s], within[s], within[e - 1] + LENGTH


def _parts(t: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(size, id, start, number in its group, row of t, bytes) of the bucket's segments, part by part."""
    rows = []
    for sizes, places, body in zip(t["sizes"], t["places"], t["body"], strict=True):
        if not sizes.is_valid:
            rows.append((np.zeros(PARTS + 1, np.int64),))
            continue
        z = np.frombuffer(sizes.as_buffer(), np.uint8)
        cut = np.concatenate(([0], np.cumsum(z[: 4 * PARTS].view(np.uint32).astype(np.int64))))
        size, p = z[4 * PARTS :].astype(np.int32), places.as_py()
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[cut]
        rows.append((cut, ends, size, *_three(p), np.frombuffer(body.as_buffer(), np.uint8)))
    for k in range(PARTS):
        own = [(i, r, slice(r[0][k], r[0][k + 1])) for i, r in enumerate(rows) if r[0][k] < r[0][k + 1]]
        if own:
            yield (
                *(np.concatenate([r[x][at] for _, r, at in own]) for x in (2, 3, 4, 5)),
                np.concatenate([np.full(at.stop - at.start, i) for i, _, at in own]),
                np.concatenate([r[6][r[1][k] : r[1][k + 1]] for _, r, _ in own]),
            )


def later_units(t: pa.Table) -> dict[int, bytes]:
    """For each row of t the spans (unit, start, end) of its strings that have an earlier equal in the bucket."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for size, ids, start, number, who, body in _parts(t):
        off = np.cumsum(size, dtype=np.int64) - size
        order, new = _distinct(size, off, body, ids, start)
        lead = order[new][np.cumsum(new) - 1]
        late = (ids[order] > ids[lead]) | (ids[order] == ids[lead]) & (start[order] > start[lead])
        copy = order[~new & late]
        one = order[new]
        seg, a, b = later_strings(body, size[one].astype(np.int64), off[one], ids[one], start[one])
        # equal units at the first place come from several groups where rows share an id
        head = np.flatnonzero(new)
        at, of = _ties(head, np.add.reduceat((~late).astype(np.int64), head), seg)
        seg, a, b = order[at], a[of], b[of]
        for out, x in zip(found, (np.concatenate((who[copy], who[seg])), np.concatenate((number[copy], number[seg])), np.concatenate((start[copy], start[seg] + a)), np.concatenate((start[copy] + size[copy], start[seg] + b))), strict=True):
            out.append(x)
    src, num, s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    order = np.argsort(src, kind="stable")
    src, num, s, e = src[order], num[order], s[order], e[order]
    cut = np.searchsorted(src, np.arange(len(t) + 1))
    return {i: K.planes(num[cut[i] : cut[i + 1]]) + K.planes(s[cut[i] : cut[i + 1]]) + K.planes(e[cut[i] : cut[i + 1]]) for i in range(len(t)) if cut[i] < cut[i + 1]}


def _answer(t: pa.Table, **columns: dict[int, bytes]) -> pa.Table:
    some = sorted({i for c in columns.values() for i in c})
    return pa.table({"g": t["g"].combine_chunks().take(pa.array(some, pa.int32())), **{name: pa.array([c.get(i) for i in some], pa.binary()) for name, c in columns.items()}})


def sort_segments(t: pa.Table) -> pa.Table:
    """Spans of later strings, and the hashes of hot strings that occur at another place too."""
    got = [K.unpack(x.as_py()) if x.is_valid else np.zeros(0, U) for x in t["strings"]]
    h, _, who, hit = repeated(np.concatenate(got), np.repeat(np.arange(len(got)), [len(x) for x in got]), 2)
    return _answer(t, spans=later_units(t), again=_by_sender(h[hit], who[hit], len(got)))


def sort_strings(t: pa.Table) -> pa.Table:
    return _answer(t, more=later_units(t))


# ---- spans out


def _spans(units: Units, told) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, start and end of the units that have an earlier equal in their group, and of what a group was told."""
    yield units.row[units.later], units.start[units.later], units.start[units.later] + units.size[units.later]
    for x in told:
        if x.is_valid:
            number, s, e = _three(x.as_py())
            at, of = units.at_place(number)
            yield units.row[at], s[of], e[of]


def cut_spans(t: pa.Table, told: pa.Table) -> pa.Table:
    told = flat(told, TOLD)
    ids, real = t["id"].to_numpy(), t["real"].to_numpy()
    copy = copies(ids, t["text"], _late(told))
    cold, again = [], Again(told)
    for found in _found(t, told, copy):
        cold.append(cold_part(*found))
        again.add(found)
    spans = [*_spans(Units(ids, cold), told["spans"]), *_spans(Units(ids, again.parts), told["more"])]
    row, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(row, kind="stable")
    row, a, b = row[order], a[order], b[order]
    parts = []
    for c in K.chunks(t["text"]):
        n = len(c.data)
        lo, hi = np.searchsorted(row, [c.first, c.first + c.n])
        at = row[lo:hi] - c.first
        size = np.diff(c.off)
        own = slice(c.first, c.first + c.n)
        d = np.zeros(n + 1, dtype=np.int32)
        np.add.at(d, c.off[at] + a[lo:hi], 1)
        np.add.at(d, c.off[at] + b[lo:hi], -1)
        gone = np.cumsum(d[:-1]) > 0
        gone |= np.repeat(copy[own] & (size >= LENGTH), size)
        kept = np.concatenate(([0], np.cumsum(~gone)))[c.off]
        parts.append(pa.table({
            "id": pa.array(ids[own], mask=~real[own]),
            "n_bytes": pa.array(size, pa.int64()),
            "n_removed": pa.array(size - np.diff(kept), pa.int64()),
            "kept": K.strings(c.data[~gone], kept, pa.binary()),
            "removed": K.row_spans(gone, c.off),
        }))
    return pa.concat_tables(parts)


def _three(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b) // 3
    return tuple(K.unplanes(b[k * n : (k + 1) * n], np.int64) for k in range(3))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: tuple[int, int, int] = HOT) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, kept (the bytes that are left), removed (byte spans [start, end))."""
    size = text_bytes(docs, docs[text_col])
    n_groups, n_buckets = parts_for(size, group_bytes), power_of_two(parts_for(size, bucket_bytes))
    x = Exchange(n_groups, n_buckets)
    by_g = grouped_docs(docs, id_col, text_col, n_groups).groupBy("g")
    grams = by_g.applyInArrow(x.sends(send_grams(n_buckets, hot), GRAMS), x.schema(GRAMS))
    hits = x.answers(grams, meet_grams(hot), GRAMS, HITS).repartition("g")  # one exchange for all its readers
    segs = by_g.cogroup(hits.groupBy("g")).applyInArrow(x.sends(send_segments(n_buckets), SENT, HITS), x.schema(SENT))
    found = x.answers(segs, sort_segments, SENT, ANSWERS).repartition("g")
    told = hits.unionByName(found, allowMissingColumns=True)
    strings = by_g.cogroup(told.groupBy("g")).applyInArrow(x.sends(send_strings(n_buckets), BODIES, [*HITS, *ANSWERS]), x.schema(BODIES))
    more = x.answers(strings, sort_strings, BODIES, MORE)
    told = told.unionByName(more, allowMissingColumns=True)
    out = by_g.cogroup(told.groupBy("g")).applyInArrow(cut_spans, "id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "kept", "removed")
