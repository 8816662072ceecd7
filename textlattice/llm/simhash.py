"""SimHash near-dedup with deletion-variant signatures.

Fingerprints are 64 bits: the majority bits of XXH64 over 3-word shingles. Two
fingerprints within 2 bits agree, in at least one of two 32-bit segments, in all
bits but at most one. So every distinct fingerprint is indexed under the variants
of its segments with one bit wildcarded; equal variants meet, and candidates are
verified by counting differing bits. The one bit lies in one half of a segment, so
fingerprints are dealt to buckets by the other half, which is equal, and their
variants are only made and joined there: a fingerprint is sent 4 times, not 64.

Verified links are reduced to a spanning forest before they leave a bucket, and
components are found by distributed alternating stars over the forests. Equal
fingerprints are one node from the start, so copies cost nothing. Under one variant
all bits but 33 agree; where many fingerprints share one, each looks up the 561
values that differ from it in one or two of those bits, instead of comparing all
pairs.

Two bits catch copies, but hardly edited ones: texts that share four fifths of their
5-word shingles differ in 5 to 10 bits of 64. So ``first_of_groups`` takes *wide*
fingerprints of 384 bits over different shingles (so that a line repeated many times
doesn't decide alone; five more words, from hashes mixed anew) in 12 segments, and links
those within NEAR bits. Some segment of two such differs in three bits at most, so one
of its four bytes is equal, by which they are dealt; of the other 24 bits, cut into n
parts, all but three parts are equal, and every choice of them is a variant. So every
link is found, of wide fingerprints as of others.

Defined results: null and empty texts have fingerprint zero and link to each other;
a null id counts as larger than any other and stays null; rows that repeat an id are
one node of the graph each through their fingerprints; an empty table gives none;
other columns are ignored (first_of_groups keeps them all). The distinct fingerprints
that agree in half a segment meet in one task, 9 bytes each; wide ones that agree in a
byte of a segment, about a 256th of all, 49 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textlattice.llm import kernels as K
from textlattice.llm.common import cut_lineage

U = K.U
SEED, SHINGLE, BITS = 42, 3, 2
#: Words of a wide fingerprint, and the bits in which two of them may differ: about those of texts that share four fifths of their 5-word shingles.
WIDE, NEAR = 6, 46
#: Fingerprints sent to a bucket of the index, about, one for each part; fingerprints under one variant, about, up to which they are told apart no further;
#: the size up to which those of one variant are compared in pairs; and that from which 64-bit ones are looked up instead of compared.
BUCKET = 80_000
CROWD = 12
FEW = 64
SPLIT = 2_048


def fingerprint(text: bytes, words: int = 1) -> int:
    """The majority bits of the shingles' hashes, repeats included; of more words, of different shingles' hashes, mixed anew for each word but the first."""
    split = text.lower().split()
    if not split:
        return 0
    h = xxhash.xxh64_intdigest
    if len(split) <= SHINGLE:
        hashes = np.array([h(b" ".join(split), SEED)], dtype=U)
    else:
        flat = b" ".join(split)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(split) - SHINGLE + 1].tolist()
        hashes = np.array([h(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=U)
    if words > 1:
        hashes = np.unique(hashes)
    n, out = len(hashes), 0
    for k in range(words):
        own = K.mix(hashes ^ U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else hashes
        count = np.zeros(64, dtype=np.int64)
        for i in range(0, n, 8192):
            count += np.unpackbits(own[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out |= int(np.packbits(2 * count > n, bitorder="little").view(U)[0]) << 64 * k
    return out


def node_of(fps: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint (rows of words): itself, or a hash of a wide one."""
    out = fps[:, 0].copy()
    for k in range(1, fps.shape[1]):
        out = K.mix(out * U(0xD1B54A32D192ED03) + fps[:, k])
    return out


def _fingerprints(words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names[:-1]
            for c in K.chunks(b.column("text")):
                raw = [fingerprint(c.text(i), words).to_bytes(8 * words, "little") for i in range(c.n)]
                node = node_of(np.frombuffer(b"".join(raw), U).reshape(-1, words))
                yield pa.record_batch([*(b.column(n).slice(c.first, c.n) for n in names), pa.array(node.view(np.int64)), pa.array(raw, pa.binary())], names=[*names, "fp", "words"])

    return f


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: dict[str, Column] = {}, words: int = 1) -> DataFrame:  # noqa: B006
    """id, the long columns of row, fp (the 64 bits as a long, or a wide fingerprint's name), words (all its bytes)."""
    d = docs.select(docs[id_col].cast("long").alias("id"), *(c.alias(n) for n, c in row.items()), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(_fingerprints(words), ", ".join(f"{n} long" for n in ("id", *row, "fp")) + ", words binary")


def most_wrong(words: int, limit: int) -> int:
    """The bits in which two fingerprints within the limit differ at most in the best of their segments."""
    n = limit // (2 * words)
    if 32 % (n + 1):
        raise ValueError(f"a segment of 32 bits has no {n + 1} equal parts")
    return n


def segments(fps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fps).view("<u4").reshape(len(fps), -1).astype(U)


def part_of(segment: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Part k of n of each segment, and the segment's other bits, closed up."""
    width, low = U(32 // n), U(32 // n) * k.astype(U)
    own = segment >> low & (U(1) << width) - U(1)
    return own, segment & (U(1) << low) - U(1) | segment >> low + width << low


def masks(bits: int, wrong: int, crowd: float) -> list[int]:
    """Masks of so many bits, one of which leaves out any given wrong bits. The more are to be told apart, the more bits each keeps, and the more there are."""
    for n in (n for n in range(wrong + 1, bits + 1) if bits % n == 0):
        size, keeps = bits // n, n - wrong
        if n == bits or crowd <= CROWD << size * keeps:
            break
    return [sum((1 << size) - 1 << size * k for k in some) for some in combinations(range(n), keeps)]


def _spread(n_buckets: int, words: int, limit: int = BITS):
    n = most_wrong(words, limit) + 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.frombuffer(b"".join(b.column("words").to_pylist()), U).reshape(-1, words)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                own, _ = part_of(segments(part)[:, :, None], np.arange(n), n)
                own = own.reshape(len(part), -1)
                slots = own.shape[1]
                at = (K.mix(own | (np.arange(slots, dtype=U) << U(16))).ravel() % U(n_buckets)).astype(np.int32)
                order = np.argsort(at, kind="stable")
                at = at[order]
                cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                who, slot = order // slots, (order % slots).astype(np.uint8)
                ends = np.append(cut[1:], len(at))
                yield pa.record_batch({
                    "bucket": pa.array(at[cut], pa.int32()),
                    "fps": pa.array([K.planes(part[who[s:e]].ravel()) for s, e in zip(cut, ends, strict=True)], pa.binary()),
                    "slots": pa.array([slot[s:e].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary()),
                })

    return f


class Forest:
    """Union-find over positions."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _apart(fps: np.ndarray, i, j) -> np.ndarray:
    """In how many bits fingerprints differ."""
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=-1)


def _links(fps: np.ndarray, members: np.ndarray, forest: Forest, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints: those reached are compared with those that nothing has reached yet, one by one on the smaller side."""
    left, out = members, []

    def join(a: int, b: int) -> None:
        if forest.join(a, b):
            out.append((a, b))

    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            if len(reached) <= len(left):
                x, reached = int(reached[0]), reached[1:]
                near = _apart(fps, left, x) <= limit
                for j in left[near].tolist():
                    join(x, j)
                reached = np.concatenate((reached, left[near]))
            else:
                near = np.zeros(len(left), dtype=bool)
                for k, j in enumerate(left.tolist()):
                    by = reached[_apart(fps, reached, j) <= limit]
                    if len(by):
                        near[k] = True
                        join(int(by[0]), j)
                reached = left[near]
            left = left[~near]
    return out


def _looked_up(fps: np.ndarray, members: np.ndarray, forest: Forest, wild: int) -> list[tuple[int, int]]:
    """The same for many 64-bit fingerprints under one variant, within BITS; wild: the bit that it leaves out of its segment."""
    m, out = len(members), []
    members = members[np.argsort(fps[members, 0])]
    values, up = fps[members, 0], list(range(m))
    label = np.arange(m)
    bits = [1 << wild, *(1 << b for b in range(32 * (1 - wild // 32), 32 * (1 - wild // 32) + 32))]
    for mask in [*bits, *(a | b for k, a in enumerate(bits) for b in bits[:k])]:
        other = values ^ U(mask)
        j = np.minimum(np.searchsorted(values, other), m - 1)
        i = np.flatnonzero((values[j] == other) & (values < other) & (label != label[j]))
        if not len(i):
            continue
        for a, b in zip(i.tolist(), j[i].tolist(), strict=True):
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                if forest.join(int(members[a]), int(members[b])):
                    out.append((int(members[a]), int(members[b])))
        label = np.array(up)
        while (label != (nxt := label[label])).any():
            label = nxt
        up = label.tolist()
    return out


def _meet(words: int, limit: int):
    wrong = most_wrong(words, limit)
    n = wrong + 1
    bits = 32 - 32 // n

    def f(t: pa.Table) -> pa.Table:
        fps = np.concatenate([K.unplanes(x.as_py(), U) for x in t["fps"]]).reshape(-1, words)
        slot = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["slots"]]).astype(np.int64)
        node, first, place = np.unique(node_of(fps), return_index=True, return_inverse=True)
        segment = segments(fps)[np.arange(len(fps)), slot // n]
        own, other = part_of(segment, slot % n, n)
        fps = fps[first]
        forest, edges, label = Forest(), [], np.arange(len(fps))
        group = (slot.astype(U) << U(32 // n) | own) << U(bits)
        crowd = (np.unique(group, return_counts=True)[1] ** 2.0).sum() / len(group)
        few = min(FEW, SPLIT)
        for mask in masks(bits, wrong, crowd if words > 1 else np.inf):
            key = group | other & U(mask)
            order = np.argsort(key)
            key, who, seg = key[order], place[order], segment[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            known = len(edges)
            i, d = np.flatnonzero(np.repeat((size > 1) & (size <= few), size)), 1
            while len(i := i[: np.searchsorted(i, len(key) - d)]) and len(i := i[key[i] == key[i + d]]):
                # a link is seen in a segment where few enough bits differ
                j = i[np.bitwise_count(seg[i] ^ seg[i + d]) <= wrong]
                a, b = who[j], who[j + d]
                a, b = a[apart := label[a] != label[b]], b[apart]
                near = _apart(fps, a, b) <= limit
                edges += [(x, y) for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True) if forest.join(x, y)]
                d += 1
            for s, m in zip(start[size > few].tolist(), size[size > few].tolist(), strict=True):
                members = who[s : s + m]
                if m > SPLIT and words == 1:
                    k, left_out = int(key[s] >> U(32)), ((1 << bits) - 1 ^ mask).bit_length() - 1
                    edges += _looked_up(fps, members, forest, 16 * (k ^ 1) + left_out)
                elif (label[members] != label[members[0]]).any():
                    edges += _links(fps, members, forest, limit)
            if len(edges) > known:
                for x in list(forest.up):
                    label[x] = forest.find(x)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[e[:, 0]].view(np.int64)), "b": pa.array(node[e[:, 1]].view(np.int64))})

    return f


def links(fps: DataFrame, n_fps: int, words: int = 1, limit: int = BITS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (words): a set whose components are those of all links within the limit."""
    slots = 2 * words * (most_wrong(words, limit) + 1)
    n_buckets = max(1, -(-n_fps * slots // BUCKET))
    spread = fps.select("words").mapInArrow(_spread(n_buckets, words, limit), "bucket int, fps binary, slots binary")
    return spread.groupBy("bucket").applyInArrow(_meet(words, limit), "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component), for every node with an edge: alternating large and small stars.

    A step emits one edge for each edge it reads, so the table never grows; each round is cut by checkpoint().
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = cut_lineage(small.where("u <> v").distinct())
        # stars: every u has one v, and no v is a u
        moved = nxt.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(nxt, ["u", "v"], "left_anti").isEmpty()
        e = nxt
        if moved:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _roots(fp: DataFrame, words: int = 1, limit: int = BITS) -> DataFrame:
    """fp, root: the same root for fingerprints of one component."""
    distinct = fp.groupBy("fp").agg(F.first("words").alias("words"))
    comp = components(links(distinct, fp.select("fp").distinct().count(), words, limit))
    names = fp.select("fp").distinct()
    return names.join(comp, names["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, fp (long), component (the smallest id reachable through links)."""
    fp = cut_lineage(fingerprints(docs, id_col, text_col))
    roots = _roots(fp)
    # a component's id is the smallest of its fingerprints' smallest ids
    named = fp.groupBy("fp").agg(F.min("id").alias("first")).join(roots, "fp")
    ids = named.groupBy("root").agg(F.min("first").alias("component"))
    by_fp = named.join(ids, "root").select("fp", "component")
    return fp.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked wide fingerprints, with all its columns: that of the smallest id; of several rows with it, any with one of their texts."""
    i, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    # 128 bits of id and text tell rows apart
    row = {"_row1": F.xxhash64(F.lit(1), i.isNull(), i, text.isNull(), text), "_row2": F.xxhash64(F.lit(2), i.isNull(), i, text.isNull(), text)}
    fp = cut_lineage(fingerprints(docs, id_col, text_col, row, WIDE))
    least = fp.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *row)).alias("first"))
    stay = least.join(_roots(fp, WIDE, NEAR), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first._row1", "first._row2")
    d = docs.withColumns(row)
    return d.join(stay, list(row), "left_semi").dropDuplicates(list(row)).select(*docs.columns)
