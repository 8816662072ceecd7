"""Substring dedup with fixed-block anchors.

A repeat of WINDOW = 13 words always holds a whole aligned block of BLOCK = 7
words of the earlier text (2 * 7 - 1 = 13). So the operator

1. indexes the non-overlapping 7-word blocks of every document and probes them
   with every rolling 7-word window: each group of documents sends its distinct
   hashes once, sorted and Elias-Fano coded, to hash buckets, and gets back those
   that meet a block somewhere else (whole equal documents are found alongside);
2. extends each hit to all 13-word windows around it, and exchanges the windows'
   96-bit fingerprints with the smallest document id of each;
3. joins the windows that also start in a document with a smaller id into maximal
   repeats, and removes their words.

What a group sends about a key is one entry, however often the key occurs, so a
passage that a third of all documents share costs a bucket one entry per group.
No pairs are made at any point.

Defined results: a null or empty text has no words, is kept and removes nothing; a
null id counts as larger than any other (but as equal to 2**63 - 1) and stays null;
rows that repeat an id are judged one by one and don't remove each other's words; an
empty table gives an empty result; other columns are ignored, and a carried column
with the name of a new one comes back with _in at the end of its name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textlattice.llm import kernels as K
from textlattice.llm.common import BUCKET_BYTES, GROUP_BYTES, grouped_docs, names_beside, parts_for, power_of_two, text_bytes
from textlattice.llm.exchange import Exchange, flat

U = K.U
WINDOW, BLOCK = 13, 7
#: Bits of a block's hash in the index; a chance hit only costs work, as windows are compared in full later.
HASH_BITS = 42

DOC = np.dtype([("hash", "S16"), ("id", "<i8")])


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _digests(c: K.Chunk) -> np.ndarray:
    """128-bit digests of the rows' texts; 1 byte is or-ed in so that none ends in the zero byte that numpy drops."""
    return np.array([(d := _digest(c.text(i)))[:15] + bytes([d[15] | 1]) for i in range(c.n)], dtype="S16")


def _first_ids(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by digest and id, and for each the smallest id of its digest."""
    rec = rec[np.lexsort((rec["id"], rec["hash"]))]
    new = np.ones(len(rec), dtype=bool)
    new[1:] = rec["hash"][1:] != rec["hash"][:-1]
    return rec, rec["id"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(rec) else rec["id"]


def _docs_of(ids: np.ndarray, text) -> np.ndarray:
    rec = np.zeros(len(ids), dtype=DOC)
    rec["id"] = ids
    for c in K.chunks(text):
        rec["hash"][c.first : c.first + c.n] = _digests(c)
    return rec


def copies(ids: np.ndarray, text, told: np.ndarray) -> np.ndarray:
    """Which rows equal, as a whole, a text with a smaller id: in another group (told: its digest) or in this one."""
    rec = _docs_of(ids, text)
    order = np.lexsort((rec["id"], rec["hash"]))
    _, first = _first_ids(rec)
    copy = np.zeros(len(ids), dtype=bool)
    copy[order] = first < rec["id"][order]
    return copy | np.isin(rec["hash"], told)


def doc_rows(ids: np.ndarray, text, n_buckets: int) -> dict[int, bytes]:
    """The group's distinct texts with their smallest ids, by bucket of the digest."""
    rec, first = _first_ids(_docs_of(ids, text))
    if not len(rec):
        return {}
    keep = np.ones(len(rec), dtype=bool)
    keep[1:] = rec["hash"][1:] != rec["hash"][:-1]
    rec = rec[keep]
    at = np.ascontiguousarray(rec["hash"]).view(np.uint8).reshape(-1, 16)[:, :4].copy().view(np.uint32).ravel() % n_buckets
    return {int(b): rec[at == b].tobytes() for b in np.unique(at)}


def later_docs(blobs: list[bytes | None], g: np.ndarray) -> dict[int, bytes]:
    """From all groups' records of a bucket: for each group the digests of its texts that have a smaller id elsewhere."""
    recs = [np.frombuffer(b or b"", dtype=DOC) for b in blobs]
    if not sum(map(len, recs)):
        return {}
    rec, who = np.concatenate(recs), np.repeat(g, [len(r) for r in recs])
    order = np.lexsort((rec["id"], rec["hash"]))
    rec, first = _first_ids(rec)
    late, who = rec["id"] > first, who[order]
    return {int(x): rec["hash"][late & (who == x)].tobytes() for x in np.unique(who[late])}


def by_bucket(keys: np.ndarray, bits: int, n_buckets: int) -> list[tuple[int, int, int]]:
    """Slices of ascending keys by their leading bits."""
    if not len(keys):
        return []
    shift = bits - (n_buckets.bit_length() - 1)
    b = (keys >> U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return [(int(b[s]), int(s), int(e)) for s, e in zip(cut, [*cut[1:], len(b)], strict=True)]


def distinct_flagged(keys: np.ndarray, flag_bits: int) -> np.ndarray:
    """Keys with flags in their low bits, in any order -> (key, or of flags, seen more than once) ascending and distinct."""
    keys = np.sort(keys)
    h = keys >> U(flag_bits)
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return keys
    last = np.append(first[1:], len(h)) - 1
    return (keys[last] << U(1)) | (last > first).astype(U)


# ---- step 1: blocks and probes


def _probes(c: K.Chunk, starts, ends, off) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of whole 7-word windows, their hashes, and which are aligned blocks."""
    wh = K.word_hashes(c, starts, ends)
    r = K.rolling(wh, BLOCK) >> U(64 - HASH_BITS)
    rows = K.row_of(off)
    ok = np.flatnonzero(K.inside(off, rows, BLOCK, len(r)))
    return ok, r[ok], (ok - off[rows[ok]]) % BLOCK == 0


def send_probes(n_buckets: int):
    def f(t: pa.Table) -> pa.Table:
        found = []
        for c in K.chunks(t["text"]):
            _, r, block = _probes(c, *K.words(c, K.RAW_WORD))
            found.append((r << U(1)) | block)
        v = distinct_flagged(np.concatenate(found) if found else np.zeros(0, U), 1)
        ids = t["id"].to_numpy()
        g = t["g"][0].as_py()
        docs = doc_rows(ids, t["text"], n_buckets)
        out = {b: v[s:e] for b, s, e in by_bucket(v, HASH_BITS + 2, n_buckets)}
        at = sorted({*out, *docs})
        return pa.table({"bucket": pa.array(at, pa.int32()), "g": pa.array([g] * len(at), pa.int32()), "keys": pa.array([K.pack(out[b]) if b in out else None for b in at], pa.binary()), "docs": pa.array([docs.get(b) for b in at], pa.binary())})

    return f


def meet_probes(t: pa.Table) -> pa.Table:
    """A probe hits if its hash is a block's and occurs at another place too."""
    g = t["g"].to_numpy()
    got = [K.unpack(x.as_py()) if x.is_valid else np.zeros(0, U) for x in t["keys"].combine_chunks()] if len(t) else []
    late = later_docs([x.as_py() for x in t["docs"].combine_chunks()], g)
    v, who = np.concatenate(got), np.repeat(np.arange(len(got)), [len(x) for x in got])
    h = v >> U(2)
    order = np.argsort(h, kind="stable")
    h, v, who = h[order], v[order], who[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    hit = np.zeros(0, dtype=bool)
    if len(first):
        places = np.add.reduceat(1 + (v & U(1)).astype(np.int64), first)
        block = np.maximum.reduceat((v >> U(1)) & U(1), first)
        hit = ((places > 1) & (block > 0))[np.cumsum(new) - 1]
    h, who = h[hit], who[hit]
    order = np.argsort(who, kind="stable")
    h, who = h[order], who[order]
    cut = np.searchsorted(who, np.arange(len(got) + 1))
    hits = {int(x): K.pack(h[cut[i] : cut[i + 1]]) for i, x in enumerate(g) if cut[i] < cut[i + 1]}
    to = sorted({*hits, *late})
    return pa.table({"g": pa.array(to, pa.int32()), "hits": pa.array([hits.get(x) for x in to], pa.binary()), "late": pa.array([late.get(x) for x in to], pa.binary())})


# ---- step 2: windows around the hits


def _late(t: dict) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in t["late"] if x.is_valid), dtype=DOC["hash"])


def send_windows(n_buckets: int):
    def f(t: pa.Table, told: dict) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), "g": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "more": pa.array([], pa.binary())})
        hits = [K.unpack(x.as_py()) for x in told["hits"] if x.is_valid]
        if not len(t) or not hits:
            return none
        hits = K.Members(np.sort(np.concatenate(hits)))
        ids = t["id"].to_numpy()
        copy = copies(ids, t["text"], _late(told))
        k1, k2, who = [], [], []
        for c in K.chunks(t["text"]):
            starts, ends, off = K.words(c, K.RAW_WORD)
            at, r, _ = _probes(c, starts, ends, off)
            hit = np.zeros(len(starts), dtype=bool)
            hit[at[hits.find(r)[0]]] = True
            if not hit.any():
                continue
            rows = K.row_of(off)
            n = max(0, len(starts) - WINDOW + 1)
            w = np.flatnonzero(K.any_ahead(hit, WINDOW - BLOCK + 1, n) & K.inside(off, rows, WINDOW, n) & ~copy[c.first + rows[:n]])
            k1.append(K.rolling(K.word_hashes(c, starts, ends), WINDOW)[w])
            k2.append((K.rolling(K.word_hashes(c, starts, ends, 1), WINDOW)[w] >> U(32)).astype(np.uint32))
            who.append(ids[c.first + rows[w]])
        if not k1:
            return none
        k1, k2, who = np.concatenate(k1), np.concatenate(k2), np.concatenate(who)
        order = np.lexsort((who, k2, k1))
        k1, k2, who = k1[order], k2[order], who[order]
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return none
        many = who[np.append(first[1:], len(k1)) - 1] > who[first]
        k1, k2, who = k1[first], k2[first], who[first]
        cut = by_bucket(k1, 64, n_buckets)
        g = t["g"][0].as_py()
        return pa.table({
            "bucket": pa.array([b for b, _, _ in cut], pa.int32()),
            "g": pa.array([g] * len(cut), pa.int32()),
            "keys": pa.array([K.pack(k1[s:e]) for _, s, e in cut], pa.binary()),
            "more": pa.array([K.planes(k2[s:e]) + K.planes(who[s:e]) + np.packbits(many[s:e]).tobytes() for _, s, e in cut], pa.binary()),
        })

    return f


def meet_windows(t: pa.Table) -> pa.Table:
    """The smallest document of each window goes back to the groups that have a larger one."""
    g = t["g"].to_numpy()
    k1, k2, who, many = [], [], [], []
    for keys, more in zip(t["keys"], t["more"], strict=True):
        k, b = K.unpack(keys.as_py()), more.as_py()
        n = len(k)
        k1.append(k)
        k2.append(K.unplanes(b[: 4 * n], np.uint32))
        who.append(K.unplanes(b[4 * n : 12 * n], np.int64))
        many.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=12 * n))[:n].astype(bool))
    src = np.repeat(np.arange(len(k1)), [len(x) for x in k1])
    k1, k2, who, many = (np.concatenate(x) for x in (k1, k2, who, many))
    order = np.lexsort((who, k2, k1))
    k1, k2, who, many, src = (x[order] for x in (k1, k2, who, many, src))
    new = np.ones(len(k1), dtype=bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    least = who[np.flatnonzero(new)][np.cumsum(new) - 1]
    back = many | (least < who)
    k1, k2, least, src = k1[back], k2[back], least[back], src[back]
    order = np.argsort(src, kind="stable")
    k1, k2, least, src = k1[order], k2[order], least[order], src[order]
    cut = np.searchsorted(src, np.arange(len(g) + 1))
    some = [i for i in range(len(g)) if cut[i] < cut[i + 1]]
    return pa.table({
        "g": pa.array([g[i] for i in some], pa.int32()),
        "keys": pa.array([K.pack(k1[cut[i] : cut[i + 1]]) for i in some], pa.binary()),
        "least": pa.array([K.planes(k2[cut[i] : cut[i + 1]]) + K.planes(least[cut[i] : cut[i + 1]]) for i in some], pa.binary()),
    })


# ---- step 3: spans out


def kept_text(c: K.Chunk, starts, ends, off, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words joined by one space, row by row."""
    rows = K.row_of(off)
    k = np.flatnonzero(keep)
    last = np.ones(len(k), dtype=bool)
    last[:-1] = rows[k][1:] != rows[k][:-1]
    size = ends[k] - starts[k] + ~last
    end = np.cumsum(size)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[end[~last] - 1] = False
    d = np.zeros(len(c.data) + 1, dtype=np.int8)
    d[starts[k]] += 1
    d[ends[k]] -= 1
    out[body] = c.data[np.cumsum(d[:-1], dtype=np.int8).astype(bool)]
    ends_by_row = np.concatenate(([0], end))[np.searchsorted(rows[k], np.arange(c.n + 1))]
    return out, ends_by_row


class Earlier:
    """The windows that a group was told of, with the smallest document of each."""

    def __init__(self, told: dict):
        got = [(K.unpack(k.as_py()), m.as_py()) for k, m in zip(told["keys"], told["least"], strict=True) if k.is_valid]
        keys = np.concatenate([k for k, _ in got]) if got else np.zeros(0, U)
        more = np.concatenate([K.unplanes(m[: 4 * len(k)], np.uint32) for k, m in got]) if got else np.zeros(0, np.uint32)
        least = np.concatenate([K.unplanes(m[4 * len(k) :], np.int64) for k, m in got]) if got else np.zeros(0, np.int64)
        order = np.lexsort((more, keys))
        self.known, self.more, self.least = K.Members(keys[order]), more[order], least[order]
        cut = np.flatnonzero(np.concatenate(([True], np.diff(self.known.keys) != 0))) if len(keys) else np.zeros(1, np.int64)
        self.most = int(np.diff(np.append(cut, len(keys))).max())  # windows that share a first hash: nearly always one

    def find(self, c: K.Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows that are known by both their hashes, and their smallest documents."""
        r = K.rolling(K.word_hashes(c, starts, ends), WINDOW)
        at, k = self.known.find(r)
        if not len(at):
            return at, self.least[k]
        r, more = r[at], (K.rolling(K.word_hashes(c, starts, ends, 1), WINDOW)[at] >> U(32)).astype(np.uint32)
        found = np.full(len(at), -1)
        for step in range(self.most):
            j = np.minimum(k + step, len(self.least) - 1)
            hit = (self.known.keys[j] == r) & (self.more[j] == more)
            found[hit] = j[hit]
        return at[found >= 0], self.least[found[found >= 0]]


def remove_spans(keep_layout: bool, n_carried: int):
    def f(t: pa.Table, told: pa.Table) -> pa.Table:
        out = _remove(t, flat(told, TOLD))
        if keep_layout:
            whole = pc.equal(out["n_removed"], 0)
            out = out.set_column(3, "kept", pc.if_else(whole, t["text"], out["kept"]))
        for i in range(n_carried):
            out = out.append_column(f"c{i}", t[f"c{i}"])
        return out

    return f


def _remove(t: pa.Table, told: dict) -> pa.Table:
    ids, real = t["id"].to_numpy(), t["real"].to_numpy()
    copy = copies(ids, t["text"], _late(told))
    earlier = Earlier(told)
    parts = []
    for c in K.chunks(t["text"]):
        starts, ends, off = K.words(c, K.RAW_WORD)
        rows, n = K.row_of(off), max(0, len(starts) - WINDOW + 1)
        gone = np.zeros(len(starts), dtype=bool)
        if n and len(earlier.least):
            at, least = earlier.find(c, starts, ends)
            ok = K.inside(off, rows, WINDOW, n)[at] & (least < ids[c.first + rows[at]])
            gone |= K.covered(at[ok], WINDOW, len(starts))
        n_words = np.diff(off)
        own = slice(c.first, c.first + c.n)
        gone |= (copy[own] & (n_words >= WINDOW))[rows]
        text, text_off = kept_text(c, starts, ends, off, ~gone)
        n_gone = np.bincount(rows[gone], minlength=c.n)
        parts.append(pa.table({"id": pa.array(ids[own], mask=~real[own]), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": K.strings(text, text_off), "removed": K.row_spans(gone, off)}))
    return pa.concat_tables(parts)


PROBES, HITS, WINDOWS, FIRST = ["keys", "docs"], ["hits", "late"], ["keys", "more"], ["keys", "least"]
TOLD = [*FIRST, "late"]
NEW = ["n_words", "n_removed", "kept", "removed"]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), keep_layout: bool = False, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: id_col, n_words, n_removed, kept (the text that is left), removed (word spans [start, end)), and the columns named in carry.

    keep_layout: a text that loses nothing is kept as it is, with its own white space.
    """
    size = text_bytes(docs, docs[text_col])
    n_groups, n_buckets = parts_for(size, group_bytes), power_of_two(parts_for(size, bucket_bytes))
    x = Exchange(n_groups, n_buckets)
    by_g = grouped_docs(docs, id_col, text_col, n_groups, carry).groupBy("g")
    probes = by_g.applyInArrow(x.sends(send_probes(n_buckets), PROBES), x.schema(PROBES))
    hits = x.answers(probes, meet_probes, PROBES, HITS).repartition("g")  # one exchange for both its readers
    windows = by_g.cogroup(hits.groupBy("g")).applyInArrow(x.sends(send_windows(n_buckets), WINDOWS, HITS), x.schema(WINDOWS))
    told = x.answers(windows, meet_windows, WINDOWS, FIRST).unionByName(hits, allowMissingColumns=True)
    kinds = dict(docs.dtypes)
    carried = "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry))
    out = by_g.cogroup(told.groupBy("g")).applyInArrow(remove_spans(keep_layout, len(carry)), "id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>" + carried)
    names = names_beside(list(carry), [id_col, *NEW])
    return out.select(F.col("id").alias(id_col), *NEW, *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
