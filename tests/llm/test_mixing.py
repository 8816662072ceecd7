"""Mixing: the solver against a direct one, the classifier on held-out labels, odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textlattice.llm import mixing as M


def test_steps_reach_the_direct_solution():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400)
    t = rng.integers(1, 300, 400).astype(float)
    b, whole, ridge = np.array([0.5, 0.45, 0.05]), t.sum(), 0.01
    residuals = []
    for _ in range(400):
        _, y = M._step(p, residuals, ridge)
        residuals.append((y * t) @ p / whole - b)
    r, _ = M._step(p, residuals, ridge)
    # the optimum's own conditions
    grad = p @ ((r * t) @ p / whole - b) + ridge * (r - 1)
    assert (np.abs(grad[r > 1e-9]) < 1e-6).all() and (grad[r <= 1e-9] > -1e-6).all() and (r >= 0).all()
    assert np.abs((r * t) @ p / whole - b).max() < 0.05


@pytest.fixture
def corpus():
    rnd = random.Random(3)
    vocab = [f"{a}{b}" for a in ("lo", "mi", "ra", "te") for b in ("na", "ri", "so", "ke", "ul")]
    rows, labels = [], []
    for i in range(300):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 80))]
        kind = i % 3
        if kind == 2:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["idiot", "scum"])
        rows.append((i, " ".join(x + "!!" if kind == 1 else x for x in w)))
        if i % 2:
            labels.append((i, ["clean", "rough", "toxic"][kind]))
    return rows, labels


def test_operator(spark, make, corpus):
    rows, labels = corpus
    lab = spark.createDataFrame([*labels, (999, "toxic"), (1, None), (None, "clean")], "id long, label string")
    out = M.mix(make([*rows, (400, None), (401, ""), (None, "lona miri")]), lab).collect()
    names = sorted(M.DOMAINS)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 2 == 0]
    right = [names[int(np.argmax(r.posteriors))] == ["clean", "rough", "toxic"][r.doc_id % 3] for r in held]
    assert np.mean(right) > 0.95 and len(out) == 303
    t = np.array([r.n_tokens for r in out])
    p = np.array([r.posteriors for r in out])
    rate = np.array([r.rate for r in out])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    share = (rate * t) @ p / t.sum()
    assert np.abs(share - [M.DOMAINS[n] for n in names]).max() < 0.002
    assert {r.doc_id: r.n_tokens for r in out}[400] == 0
    # the rates against a solution found in one process from the same posteriors
    v, b = np.zeros(3), np.array([M.DOMAINS[n] for n in names])
    for _ in range(5000):
        v += 0.5 * ((np.maximum(0, 1 - p @ v) * t) @ p / t.sum() - b)
    assert np.average((rate - np.maximum(0, 1 - p @ v)) ** 2, weights=t) ** 0.5 < 0.05


def test_rates_equal_a_direct_solution(spark):
    """What the distributed steps settle on against one process that takes a few thousand of them."""
    rng = np.random.default_rng(4)
    p, t, weights = rng.dirichlet([0.5, 0.4, 0.3], 600), rng.integers(1, 300, 600), [0.55, 0.35, 0.1]
    b = np.array(weights)
    blocks = [(np.arange(k, k + 100).tobytes(), np.ones(100, bool).tobytes(), t[k : k + 100].astype(np.int64).tobytes(), p[k : k + 100].tobytes()) for k in range(0, 600, 100)]
    d = spark.createDataFrame([tuple(bytearray(x) for x in r) for r in blocks], M.BLOCKS)
    done, residuals, first, report = M.solve(d, weights)
    assert np.abs(report["miss"]).max() < 1e-3 and report["steps"] <= M.STEPS and len(residuals) < M.REPLAY
    rows = done.mapInArrow(M._rates(residuals, first, M.RIDGE, 3), "id long, n_tokens long, posteriors array<double>, rate double").collect()
    got = np.array([r.rate for r in sorted(rows, key=lambda r: r.id)])
    # the mix nearest to the corpus among those that meet the targets: rates max(0, 1 - p @ v) for some v
    v = np.zeros(3)
    for _ in range(20_000):
        v += 0.5 * ((np.maximum(0, 1 - p @ v) * t) @ p / t.sum() - b)
    want = np.maximum(0, 1 - p @ v)
    assert np.abs((want * t) @ p / t.sum() - b).max() < 1e-6
    assert np.abs((got * t) @ p / t.sum() - b).max() < 2e-3 and np.average((got - want) ** 2, weights=t) ** 0.5 < 0.05


def test_without_labels_and_empty(spark, make):
    none = spark.createDataFrame([], "id long, label string")
    out = M.mix(make([(1, "a b"), (2, None)]), none).collect()
    assert all(np.allclose(r.posteriors, 1 / 3) for r in out)
    assert M.mix(make([]), none).collect() == []


def test_features_are_whole_texts():
    from textlattice.llm import kernels as K

    (c,) = K.chunks(pa.array(["a " * 5000 + "idiot", None, "x"]))
    ((lo, x, t),) = M.features(c)
    assert lo == 0 and t.tolist() == [5001, 0, 1] and (x[1] == 0).all()
