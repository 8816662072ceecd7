"""Mixing sources to target weights by soft membership.

1. A multinomial logistic regression over hashed word and character-class features
   is fitted to a bounded sample of labelled documents and gives every document a
   posterior p over domains.
2. With t tokens per document and targets b for the domains' token totals, the rates
   r >= 0 minimise  |sum(r t p) - b|^2 / (2 B^2) + RIDGE / 2 * sum(t (r - 1)^2) / B,
   B being the sum of b and the norm that of the inverse of sum(t p p') / B, in which
   all directions are equally steep: the mix that meets the targets while it stays as
   near to the corpus as that allows. Accelerated projected-gradient steps, scaled by
   t / B, run over the distributed table; all that a step sends is the domains' totals. When
   the totals have settled, what they still miss is added to the targets that the
   steps aim at, as in iterative refinement, so that the ridge only chooses among the
   mixes that meet the targets. Tasks work out their rates from the residuals of the
   last steps; every REPLAY steps the rates are written beside the posteriors.

Defined results: a null or empty text has no tokens, takes the prior as its posterior
and gets the rate that follows from it, without any weight in the sums; labels of
documents that aren't there, and labels that are null, are ignored; with several
labels for an id the smallest domain counts; without any labels the posterior is
uniform; rows that repeat are mixed one by one; an empty table gives none; where no
rates meet the targets they come as near as the steps allow; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlattice.llm import kernels as K
from textlattice.llm.common import cut_lineage

U = K.U
WORD_DIM, SHAPE_DIM = 8192, 2048
DIM = WORD_DIM + SHAPE_DIM
#: Bound of the training sample, in documents (expected; at most twice as many are taken).
MAX_TRAIN = 2000
RIDGE, STEPS, REPLAY = 0.05, 60, 10
#: The steps end when the totals are within MISS of the targets; they have settled when a step moves them by less than SETTLED.
MISS, SETTLED = 2e-4, 1e-3
ROWS = 256

#: Domains of the labelled table and the weights that the mix should have.
DOMAINS = {"clean": 0.80, "rough": 0.19, "toxic": 0.01}

#: Character classes: lower, upper, digit, white space, above ASCII; any other byte is its own.
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 5
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 4


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null where neither label says which."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "rough")


def features(c: K.Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows x DIM unit features, tokens) for up to ROWS rows at a time."""
    raw_starts, _, raw_off = K.words(c, K.RAW_WORD)
    starts, ends, off = K.words(c, K.ALNUM_WORD)
    at = (K.word_hashes(c, starts, ends, fold=True) >> U(64 - 13)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    for lo in range(0, c.n, ROWS):
        hi = min(c.n, lo + ROWS)
        n = hi - lo
        w = slice(off[lo], off[hi])
        words = np.bincount(np.repeat(np.arange(n), np.diff(off[lo : hi + 1])) * WORD_DIM + at[w], minlength=n * WORD_DIM).reshape(n, WORD_DIM)
        b = c.off[lo : hi + 1] - c.off[lo]
        shape = _SHAPE[c.data[c.off[lo] : c.off[hi]]]
        rows = np.repeat(np.arange(n), np.diff(b))
        if len(shape) > 2:
            gram = (shape[:-2] << np.uint32(16)) | (shape[1:-1] << np.uint32(8)) | shape[2:]
            whole = rows[:-2] == rows[2:]
            h = ((gram + np.uint32(1)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
            shapes = np.bincount(rows[:-2][whole] * SHAPE_DIM + h[whole], minlength=n * SHAPE_DIM).reshape(n, SHAPE_DIM)
        else:
            shapes = np.zeros((n, SHAPE_DIM), dtype=np.int64)
        x = np.empty((n, DIM), dtype=np.float32)
        for part, source in ((x[:, :WORD_DIM], words), (x[:, WORD_DIM:], shapes)):
            np.log1p(source, out=part, dtype=np.float32)
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        yield lo, x, np.diff(raw_off[lo : hi + 1])


@dataclass
class Classifier:
    domains: list[str]
    scale: np.ndarray  # of each feature: near one where its share differs surely among the domains
    weights: np.ndarray  # DIM x domains
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = scaled(x, self.scale) @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return (z / z.sum(axis=1, keepdims=True)).astype(np.float64)


def scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """In place."""
    x *= scale
    for part in (x[:, :WORD_DIM], x[:, WORD_DIM:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def contrast(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z * z / (z * z + 25) for the largest z score of a feature's presence in one domain against the rest."""
    has, z2 = x > 0, np.zeros(DIM)
    n = len(x)
    all_of = has.sum(axis=0, dtype=np.float64)
    for k in range(y.shape[1]):
        m = float(y[:, k].sum())
        if 0 < m < n:
            own = has[y[:, k] > 0].sum(axis=0, dtype=np.float64)
            p = (all_of + 1) / (n + 2)
            d = own / m - (all_of - own) / (n - m)
            z2 = np.maximum(z2, d * d / (p * (1 - p) * (1 / m + 1 / (n - m))))
    return (z2 / (z2 + 25)).astype(np.float32)


def train(domains: list[str], labels: list[str], x: np.ndarray, steps: int = 300, decay: float = 1e-6) -> Classifier:
    """Accelerated gradient descent on the mean log loss with a small ridge."""
    k = len(domains)
    w, b = np.zeros((DIM, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    if not labels:
        return Classifier(domains, np.ones(DIM, dtype=np.float32), w, b)
    y = np.eye(k, dtype=np.float32)[[domains.index(v) for v in labels]]
    scale = contrast(x, y)
    x = scaled(x, scale)
    rate, vw, vb = np.float32(1.3), w.copy(), b.copy()
    for i in range(steps):
        z = x @ vw + vb
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = (z / z.sum(axis=1, keepdims=True) - y) / np.float32(len(x))
        nw, nb = vw - rate * (x.T @ g + np.float32(decay) * vw), vb - rate * g.sum(axis=0)
        m = np.float32(i / (i + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return Classifier(domains, scale, w, b)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in K.chunks(b.column("text")):
            for lo, x, _ in features(c):
                at = [np.flatnonzero(r) for r in x]
                yield pa.record_batch({
                    "label": b.column("label").slice(c.first + lo, len(x)),
                    "at": pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                    "x": pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary()),
                })


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Classifier:
    """labelled: (id, label). Learns from about max_train labelled documents, picked by a hash of the id."""
    lab = labelled.where(F.col("label").isin(domains) & F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    total = lab.count()
    key = F.pmod(F.xxhash64(F.lit("mixing sample"), "id"), F.lit(1 << 30))
    picked = lab.where(key < int((1 << 30) * min(1.0, max_train / max(1, total)))).orderBy("id").limit(2 * max_train)
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    part = d.join(F.broadcast(picked), "id").select("label", "text")  # at most 2 * max_train short rows are broadcast
    rows = part.mapInArrow(_sample, "label string, at binary, x binary").limit(2 * max_train).collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["x"])))
    x = np.zeros((len(rows), DIM), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return train(domains, [r["label"] for r in rows], x)


def _posteriors(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        for b in batches:
            ids, tokens, p = [], [], []
            for c in K.chunks(b.column("text")):
                for lo, x, t in features(c):
                    ids.append(b.column("id").slice(c.first + lo, len(x)))
                    tokens.append(t.astype(np.int64))
                    p.append(model.posteriors(x))
            if ids:
                flat = pa.concat_arrays(ids)
                real = flat.is_valid().to_numpy(zero_copy_only=False)
                yield pa.record_batch({
                    "ids": pa.array([flat.fill_null(0).to_numpy().tobytes()], pa.binary()),
                    "real": pa.array([real.tobytes()], pa.binary()),
                    "tokens": pa.array([np.concatenate(tokens).tobytes()], pa.binary()),
                    "p": pa.array([np.concatenate(p).tobytes()], pa.binary()),
                })

    return f


BLOCKS = "ids binary, real binary, tokens binary, p binary"
STATE = BLOCKS + ", r binary, y binary"


def _step(p: np.ndarray, residuals: list[np.ndarray], ridge: float, state: tuple | None = None, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The rates after some more steps, and the extrapolated rates where the next gradient is taken; state: both before, after the first steps."""
    r, y = state or (np.ones(len(p)), np.ones(len(p)))
    rate = 1 / (1 + ridge)
    for i, e in enumerate(residuals, first):
        nxt = np.maximum(0, y - rate * (p @ e + ridge * (y - 1)))
        y = nxt + i / (i + 3) * (nxt - r)
        r = nxt
    return r, y


def _block(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, tuple | None]]:
    """Each block's place, posteriors, and rates so far."""
    known = "r" in b.schema.names
    for i, p in enumerate(b.column("p")):
        yield i, np.frombuffer(p.as_py(), np.float64).reshape(-1, k), tuple(np.frombuffer(b.column(x)[i].as_py(), np.float64) for x in ("r", "y")) if known else None


def _moments(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for b in batches:
            for i, q, _ in _block(b, k):
                t = np.frombuffer(b.column("tokens")[i].as_py(), np.int64).astype(np.float64)
                out += (q * t[:, None]).T @ q
        yield pa.record_batch({"k": pa.array(range(k * k), pa.int32()), "m": pa.array(out.ravel())})

    return f


def _totals(residuals: list[np.ndarray], first: int, ridge: float, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, plain = np.zeros(k), np.zeros(k), np.zeros(k)
        for b in batches:
            for i, q, state in _block(b, k):
                t = np.frombuffer(b.column("tokens")[i].as_py(), np.int64).astype(np.float64)
                r, y = _step(q, residuals, ridge, state, first)
                at += (y * t) @ q
                now += (r * t) @ q
                plain += t @ q
        yield pa.record_batch({"k": pa.array(range(k), pa.int32()), "at": pa.array(at), "now": pa.array(now), "plain": pa.array(plain)})

    return f


def _advance(residuals: list[np.ndarray], first: int, ridge: float, k: int):
    """Writes the rates after the steps so far beside the posteriors."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [_step(q, residuals, ridge, state, first) for _, q, state in _block(b, k)]
            yield pa.record_batch([*(b.column(c) for c in ("ids", "real", "tokens", "p")), *(pa.array([x[j].tobytes() for x in both], pa.binary()) for j in (0, 1))], names=["ids", "real", "tokens", "p", "r", "y"])

    return f


def solve(blocks: DataFrame, weights: list[float], ridge: float = RIDGE, steps: int = STEPS) -> tuple[DataFrame, list[np.ndarray], int, dict]:
    """The blocks with the rates after the first steps, the residuals of those after them, how many were first, and how far the totals are from the targets."""
    k, first, residuals = len(weights), 0, []
    b = np.array(weights) / sum(weights)
    aim, report = b.copy(), {}
    found = {r["k"]: r["m"] for r in blocks.mapInArrow(_moments(k), "k int, m double").groupBy("k").agg(F.sum("m").alias("m")).collect()}
    moments = np.array([found.get(j, 0.0) for j in range(k * k)]).reshape(k, k)
    # a document's posteriors sum to one, so the moments sum to the tokens; directions that no document varies in are left out
    norm = np.linalg.pinv(moments / max(1.0, moments.sum()), rcond=1e-6)
    for i in range(steps + 1):
        rows = blocks.mapInArrow(_totals(residuals, first, ridge, k), "k int, at double, now double, plain double").groupBy("k").agg(*(F.sum(x).alias(x) for x in ("at", "now", "plain"))).collect()
        by_k = {r["k"]: r for r in rows}
        at, now, plain = (np.array([by_k[j][x] if j in by_k else 0.0 for j in range(k)]) for x in ("at", "now", "plain"))
        whole = plain.sum()
        if not whole:
            break
        before, report = report.get("totals"), {"totals": now / whole, "miss": now / whole - b, "steps": i}
        if i == steps or np.abs(report["miss"]).max() < MISS:
            break
        if before is not None and np.abs(report["totals"] - before).max() < SETTLED:
            aim = aim - report["miss"]
        residuals.append(norm @ (at / whole - aim))
        if len(residuals) == REPLAY:
            blocks = cut_lineage(blocks.mapInArrow(_advance(residuals, first, ridge, k), STATE))
            first, residuals = first + REPLAY, []
    return blocks, residuals, first, report


def _rates(residuals: list[np.ndarray], first: int, ridge: float, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q, state in _block(b, k):
                ids, real, tokens = (b.column(c)[i].as_py() for c in ("ids", "real", "tokens"))
                r, _ = _step(q, residuals, ridge, state, first)
                yield pa.record_batch({
                    "id": pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(real, bool)),
                    "n_tokens": pa.array(np.frombuffer(tokens, np.int64)),
                    "posteriors": pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, k), pa.int32()), pa.array(q.ravel())),
                    "rate": pa.array(r),
                })

    return f


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = DOMAINS, id_col: str = "doc_id", text_col: str = "text", ridge: float = RIDGE) -> DataFrame:
    """Per row: id_col, n_tokens, posteriors (in the order of the targets' sorted names), rate (how often to take it, expected)."""
    names = sorted(targets)
    model = fit(docs, labelled, names, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    blocks = cut_lineage(d.mapInArrow(_posteriors(shared), BLOCKS))
    blocks, residuals, first, _ = solve(blocks, [targets[n] for n in names], ridge)
    out = blocks.mapInArrow(_rates(residuals, first, ridge, len(names)), "id long, n_tokens long, posteriors array<double>, rate double")
    return out.withColumnRenamed("id", id_col)
