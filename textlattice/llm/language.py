"""Language identification by nearest centroid.

A text is the vector of its byte 1-, 2- and 3-grams (letters lower-cased, runs of
anything else one space), hashed to DIM places, with damped counts weighted by
inverse document frequency and scaled to length one. Each language gets up to
CLUSTERS centroids from spherical k-means over a bounded sample of labelled texts.
A text gets the language of the centroid with the largest cosine; it is rejected
when that cosine is far below what labelled texts of about its length reach that
the centroids weren't learned from (a short text never comes close to a centroid,
whatever its language). Every length has such a floor, however few texts show it:
the further a training text is from a length, the less it counts there.

Defined results: a null text and one without letters is ``und`` with score 0 and
rejected; rows without a label and rows that the caller holds out are not learned
from; without any labelled text every row is ``und``; equal cosines go to the
language that sorts first; rows that repeat are judged one by one; an empty table
gives none; other columns are ignored, and a kept column with the name of a new one
comes back with _in at the end of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textlattice.llm import kernels as K
from textlattice.llm.common import kept_columns

U = K.U
DIM = 4096
CLUSTERS = 4
#: Bound of the training sample, in documents (expected; at most twice as many are taken).
MAX_TRAIN = 2500
#: A text is rejected below REJECT_AT times the REJECT_QUANTILE of the cosines that texts of about its length reach.
REJECT_AT, REJECT_QUANTILE = 2 / 3, 0.02
ROWS = 256
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, dtype=np.uint8)
for _b in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _LETTER[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTER[_b] = _b + 32


def has_letters(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def counts(c: K.Chunk) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x DIM counts) for up to ROWS rows at a time."""
    for lo in range(0, c.n, ROWS):
        hi = min(c.n, lo + ROWS)
        data = _LETTER[c.data[c.off[lo] : c.off[hi]]]
        off = c.off[lo : hi + 1] - c.off[lo]
        n = len(data)
        rows = np.repeat(np.arange(hi - lo), np.diff(off)).astype(np.int64)
        keep = np.ones(n, dtype=bool)
        if n:
            keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (rows[1:] != rows[:-1])
        data, rows = data[keep].astype(np.uint32), rows[keep]
        out = np.zeros((hi - lo) * DIM, dtype=np.int64)
        gram = np.zeros(len(data), dtype=np.uint32)
        for k in range(3):
            if len(data) <= k:
                break
            gram = gram[: len(data) - k] * np.uint32(256) + data[k:]
            whole = rows[: len(data) - k] == rows[k:]
            h = ((gram + np.uint32(k + 1)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
            out += np.bincount(rows[: len(data) - k][whole] * DIM + h[whole], minlength=len(out))
        yield lo, out.reshape(hi - lo, DIM)


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length one, in place."""
    x /= np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # the cosine below which a text is rejected, by the binary logarithm of its grams

    def vectors(self, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n, dtype=np.float32)
        x *= self.idf
        return unit(x)

    def predict(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = self.vectors(n) @ self.centroids.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(cos)), best]
        return best, np.clip(top, 0, 1), top < self.floor[length_class(n)]


def length_class(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n.sum(axis=1), 1)).astype(np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start; the same result every time."""
    c = unit(x.mean(axis=0, keepdims=True))
    near = x @ c[0]
    picked = [int(near.argmin())]
    while len(picked) < min(k, len(x)):
        near = (x @ x[picked].T).max(axis=1)
        picked.append(int(near.argmin()))
    c = x[picked].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        c = np.stack([unit(x[at == j].mean(axis=0)) if (at == j).any() else c[j] for j in range(len(c))])
    return c, (x @ c.T).argmax(axis=1)


def centroids(x: np.ndarray, names: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each centroid's language, and the centroids."""
    langs, cs = [], []
    for lang in sorted(set(names.tolist())):
        own = x[names == lang]
        c, at = k_means(own, CLUSTERS)
        for j in range(len(c)):
            if (at == j).any():
                langs.append(lang)
                cs.append(c[j])
    return langs, np.array(cs, np.float32).reshape(-1, DIM)


def floors(top: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By length class, REJECT_AT times the low quantile of the cosines, each weighted by how near its own class is."""
    order = np.argsort(top, kind="stable")
    top, size = top[order], size[order]
    out = np.zeros(64, np.float32)
    for k in range(len(out)):
        w = np.cumsum(1 / (1 + (size - k).astype(np.float64) ** 2))
        out[k] = REJECT_AT * top[np.searchsorted(w, REJECT_QUANTILE * w[-1])]
    return out


def train(labels: list[str], n: np.ndarray) -> Model:
    """labels and rows x DIM counts of the sample."""
    idf = np.log((1 + len(n)) / (1 + (n > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(64, np.float32))
    x, names = model.vectors(n), np.array(labels)
    model.langs, model.centroids = centroids(x, names)
    if len(x):
        half, top = np.arange(len(x)) % 2 == 0, np.zeros(len(x), np.float32)
        for own in (half, ~half):  # each half against centroids of the other
            c = centroids(x[~own], names[~own])[1] if (~own).any() else model.centroids
            top[own] = (x[own] @ c.T).max(axis=1)
        model.floor = floors(top, length_class(n))
    return model


def _lower(column) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = _lower(b.column("text"))
        for c in K.chunks(text):
            for lo, n in counts(c):
                at = [np.flatnonzero(r) for r in n]
                first = c.first + lo
                yield pa.record_batch({
                    "label": b.column("label").slice(first, len(n)),
                    "at": pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                    "n": pa.array([r[a].astype(np.uint32).tobytes() for r, a in zip(n, at, strict=True)], pa.binary()),
                })


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Learns from about max_train of the usable labelled rows, picked by a hash of the id."""
    key = F.pmod(F.xxhash64(F.lit("language sample"), docs[id_col]), F.lit(1 << 30))
    lit = docs.where(usable & docs[label_col].isNotNull() & docs[text_col].rlike(r"\p{L}"))
    total = docs.where(usable & docs[label_col].isNotNull()).count()
    part = lit.where(key < int((1 << 30) * min(1.0, max_train / max(1, total)))).select(docs[label_col].cast("string").alias("label"), docs[text_col].cast("string").alias("text"))
    rows = part.mapInArrow(_sparse, "label string, at binary, n binary").limit(2 * max_train).collect()
    n = np.zeros((len(rows), DIM), dtype=np.float32)
    for i, r in enumerate(rows):
        n[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["label"], bytes(rows[i]["at"]), bytes(rows[i]["n"])))
    return train([rows[i]["label"] for i in order], n[order])


def _judged(model: Model, text: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(first row, languages, scores, which are rejected) for some rows of a column at a time."""
    text = _lower(text)
    for c in K.chunks(text):
        for lo, n in counts(c):
            first = c.first + lo
            if not model.langs:
                yield first, [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), dtype=bool)
                continue
            real = np.array([has_letters(x) for x in text.slice(first, len(n)).to_pylist()], dtype=bool)
            best, top, far = model.predict(n)
            yield first, [model.langs[j] if ok else UNKNOWN for j, ok in zip(best, real, strict=True)], np.where(real, top, 0).astype(np.float64), far | ~real


def _predict(shared, names: list[str]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, lang, score, rejected in _judged(shared.value, b.column(len(names))):
                yield pa.record_batch([x.slice(first, len(lang)) for x in b.columns[:-1]] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, *NEW])

    return f


NEW = ["lang_pred", "score", "rejected"]


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns named in keep, lang_pred, score (the largest cosine) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own, names, kinds = kept_columns(docs, keep, NEW)
    d = docs.select(*own, docs[text_col].cast("string").alias("_text"))
    return d.mapInArrow(_predict(shared, names), ", ".join([*kinds, "lang_pred string, score double, rejected boolean"]))


def _accept(shared, at: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [~rejected for *_, rejected in _judged(shared.value, pc.cast(b.column(at), pa.string()))]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return f


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language isn't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accept(shared, docs.columns.index(text_col)), docs.schema)


def held_out(id_col: Column) -> Column:
    """A quarter of the documents, by their ids, is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))
