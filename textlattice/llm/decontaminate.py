"""Benchmark decontamination.

The benchmark's windows of 13 normalised words (an item with fewer words is one
window) become one sorted set of hashes per window length. The set is broadcast,
and every rolling window of every training text is scanned against it; a hit is
verified by comparing the words themselves, marks the words under it, and names
the items that hold the window.

The broadcast is bounded: a benchmark of at most ``block_bytes`` of text goes whole.
A larger one stays distributed: only a bit table of its windows' hashes, of fixed
size, is broadcast; windows of the texts that it lets through are joined with the
benchmark's windows by their words, and the hits return to their documents. Both
ways give the same rows.

Defined results: a null or empty text has no words and is clean; items with null
text or without words have no windows; equal items are both counted, as are rows
that repeat an id, each judged by its own text; a null id stays null; a null item id
takes part in hits but is not listed; an empty benchmark leaves every document clean;
an empty table gives none; other columns are ignored (clean_documents keeps them all).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textlattice.llm import kernels as K
from textlattice.llm.common import text_bytes

WINDOW = 13
#: Benchmark text that is broadcast whole: its index takes about four times as much.
BLOCK_BYTES = 16 << 20
#: Bits, as a power of two, of the table that stands in for a larger one.
FILTER_BITS = 27
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
OUT = "id long, n_words long, hit array<struct<start:long,end:long>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Index:
    """Hashes of one block's windows by window length, with their words and items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        by_length: dict[int, dict[bytes, set]] = {}
        for name, w in items:
            k = min(WINDOW, len(w))
            for j in range(len(w) - k + 1 if k else 0):
                by_length.setdefault(k, {}).setdefault(b" ".join(w[j : j + k]), set()).add(name)
        self.sets = []
        for k, windows in sorted(by_length.items()):
            texts = list(windows)
            table = pa.array(texts, pa.binary())
            c = next(K.chunks(table, 1 << 62))
            starts, ends, _ = K.words(c, K.ALNUM_WORD)
            h = K.rolling(K.word_hashes(c, starts, ends, fold=True), k)[::k][: len(texts)]
            order = np.argsort(h, kind="stable")
            self.sets.append((k, h[order], [texts[i] for i in order], [windows[texts[i]] for i in order]))

    def scan(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
        """Word offsets by row, words hit, run bounds, and the items of each row."""
        starts, ends, off = K.words(c, K.ALNUM_WORD)
        hit, items = np.zeros(len(starts), dtype=bool), [set() for _ in range(c.n)]
        if len(starts) and self.sets:
            rows = K.row_of(off)
            wh = K.word_hashes(c, starts, ends, fold=True)
            for k, keys, texts, names in self.sets:
                r = K.rolling(wh, k)
                at, place = self._members(k, keys).find(r)
                ok = K.inside(off, rows, k, len(r))[at]
                for j, p in zip(at[ok].tolist(), place[ok].tolist(), strict=True):
                    found = b" ".join(WORD.findall(c.data[starts[j] : ends[j + k - 1]].tobytes().lower()))
                    while p < len(keys) and keys[p] == r[j]:  # equal hashes stand together
                        if texts[p] == found:
                            hit[j : j + k] = True
                            items[rows[j]] |= names[p]
                        p += 1
        return off, hit, starts, items

    def _members(self, k: int, keys: np.ndarray) -> K.Members:
        known = self.__dict__.setdefault("known", {})
        if k not in known:
            known[k] = K.Members(keys)
        return known[k]


def _scan(index) -> object:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b.column("text")):
                off, hit, _, items = index.value.scan(c)
                yield pa.record_batch({
                    "id": b.column("id").slice(c.first, c.n),
                    "n_words": pa.array(np.diff(off), pa.int64()),
                    "hit": K.row_spans(hit, off),
                    "items": pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.string())),
                })

    return f


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items that have words."""
    text = benchmark[text_col].cast("string")
    return benchmark.select(benchmark[item_col].cast("string").alias("item"), text.alias("text")).where(text.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))


def _whole(items: DataFrame, block_bytes: int) -> Index | None:
    """The index of a benchmark of at most block_bytes; None for a larger one."""
    if text_bytes(items, F.col("text")) > block_bytes:
        return None
    return Index([(r["item"], item_words(r["text"])) for r in items.collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id_col, n_words, hit (word spans [start, end) under benchmark windows), n_hit, items (sorted ids), contaminated."""
    items = _items(benchmark, item_col, item_text)
    index = _whole(items, block_bytes)
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    out = d.mapInArrow(_scan(d.sparkSession.sparkContext.broadcast(index)), OUT) if index else _joined(d, items).select("id", "n_words", "hit", "items")
    return _judged(out).select(F.col("id").alias(id_col), "n_words", "hit", "n_hit", "items", "contaminated")


def _judged(out: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated."""
    out = out.withColumn("n_hit", F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


# ---- a benchmark that isn't broadcast


def _key(id_col: Column, text: Column) -> Column:
    """Tells rows apart by id and text; never null."""
    return F.sha2(F.concat_ws(":", F.coalesce(id_col.cast("long").cast("string"), F.lit("none")), F.coalesce(text.cast("string"), F.lit(""))), 256)


def _windows(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, k: int, at: list[int]) -> list[str]:
    """The words of the windows that begin at some words, lower-cased and joined by one space."""
    return [b" ".join(WORD.findall(data[starts[j] : ends[j + k - 1]].tobytes().lower())).decode() for j in at]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in K.chunks(b.column("text")):
            starts, ends, off = K.words(c, K.ALNUM_WORD)
            wh = K.word_hashes(c, starts, ends, fold=True)
            size = np.diff(off)
            for k in sorted(set(np.minimum(size[size > 0], WINDOW).tolist())):
                rows = K.row_of(off)
                r = K.rolling(wh, k)
                ok = K.inside(off, rows, k, len(r)) & (np.minimum(size, WINDOW)[rows[: len(r)]] == k)
                at = np.flatnonzero(ok)
                yield pa.record_batch({
                    "k": pa.array(np.full(len(at), k), pa.int32()),
                    "w": pa.array(_windows(starts, ends, c.data, k, at.tolist()), pa.string()),
                    "h": pa.array(r[at].view(np.int64)),
                    "item": b.column("item").take(pa.array(c.first + rows[at])),
                })


def _filter(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The lengths of the benchmark's windows, and a table of 2**FILTER_BITS bits with those of their hashes set."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = windows.groupBy(F.shiftrightunsigned(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits"))
    got = words.toArrow()  # at most 2**(FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return sorted(r["k"] for r in windows.select("k").distinct().collect()), table


CANDIDATES = "key string, id long, n_words long, k int, j long, w string"


def _candidates(shared) -> object:
    """A row for each document (k is 0), and one for each of its windows that the table lets through."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, table = shared.value
        for b in batches:
            for c in K.chunks(b.column("text")):
                starts, ends, off = K.words(c, K.ALNUM_WORD)
                rows = K.row_of(off)
                wh = K.word_hashes(c, starts, ends, fold=True) if len(starts) else np.zeros(0, K.U)
                key = b.column("key").slice(c.first, c.n)
                row, ks, js, ws = [np.arange(c.n)], [np.zeros(c.n, np.int32)], [np.zeros(c.n, np.int64)], key.to_pylist()
                for k in lengths:
                    r = K.rolling(wh, k)
                    slot = r >> K.U(64 - FILTER_BITS)
                    seen = (table[(slot >> K.U(6)).astype(np.int64)] >> (slot & K.U(63))) & K.U(1) > 0
                    at = np.flatnonzero(seen & K.inside(off, rows, k, len(r)))
                    row.append(rows[at])
                    ks.append(np.full(len(at), k, np.int32))
                    js.append(at - off[rows[at]])
                    ws += _windows(starts, ends, c.data, k, at.tolist())
                row = np.concatenate(row)
                yield pa.record_batch({
                    "key": key.take(pa.array(row)),
                    "id": b.column("id").slice(c.first, c.n).take(pa.array(row)),
                    "n_words": pa.array(np.diff(off)[row], pa.int64()),
                    "k": pa.array(np.concatenate(ks)),
                    "j": pa.array(np.concatenate(js)),
                    "w": pa.array(ws, pa.string()),
                })

    return f


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows to spans; a row for every copy of a document."""
    for b in batches:
        hits, items = [], []
        for places, names in zip(b.column("places").to_pylist(), b.column("names").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for s in sorted(places, key=lambda x: (x["j"], x["k"])):
                if spans and s["j"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s["j"] + s["k"])
                else:
                    spans.append([s["j"], s["j"] + s["k"]])
            hits.append([{"start": x, "end": y} for x, y in spans])
            items.append(sorted({x for n in names for x in n}))
        again = pa.array(np.repeat(np.arange(b.num_rows), b.column("copies").to_numpy()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([b.column("key").take(again), b.column("id").take(again), b.column("n_words").take(again), pa.array(hits, span).take(again), pa.array(items, pa.list_(pa.string())).take(again)], names=["key", "id", "n_words", "hit", "items"])


def _joined(d: DataFrame, items: DataFrame) -> DataFrame:
    """key and OUT for every row of d (id, text): candidates meet the benchmark's windows by length and words.

    A window that many documents hold is a skewed key of the join, which adaptive execution splits; on the benchmark's
    side it is one row.
    """
    windows = items.mapInArrow(_item_windows, "k int, w string, h long, item string")
    shared = d.sparkSession.sparkContext.broadcast(_filter(windows))
    own = windows.groupBy("k", "w").agg(F.collect_set("item").alias("names"))
    found = d.select(_key(d["id"], d["text"]).alias("key"), "id", "text").mapInArrow(_candidates(shared), CANDIDATES)
    met = found.join(own, ["k", "w"], "left")
    place = F.when(F.col("names").isNotNull(), F.struct("j", "k"))
    by_doc = met.groupBy("key").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.count_if(F.col("k") == 0).alias("copies"), F.collect_set(place).alias("places"), F.collect_set("names").alias("names"))
    return by_doc.mapInArrow(_spans, "key string, " + OUT)


def _drop(index, at: int) -> object:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for c in K.chunks(pc.cast(b.column(at), pa.string())):
                off, hit, _, _ = index.value.scan(c)
                n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[off])
                keep.append(~((n_hit > 0) & (20 * n_hit >= np.diff(off))))
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return f


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that aren't contaminated, each judged by its own text, with all their columns."""
    items = _items(benchmark, item_col, item_text)
    index = _whole(items, block_bytes)
    if index:
        return docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)), docs.schema)
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    bad = _judged(_joined(d, items)).where("contaminated").select(F.col("key").alias("_bad"))
    return docs.join(bad, _key(docs[id_col], docs[text_col]) == bad["_bad"], "left_anti")
