"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from textlattice.llm import simhash as S


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(keys):
    """The smallest position reachable over links within 2 bits."""
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= S.BITS:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(keys))]


def test_fingerprints():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 20_000):
        t = " ".join(rnd.choice(["Ab", "c", "déf", "G"]) for _ in range(n))
        assert S.fingerprint(t.encode()) == slow_fingerprint(t)


def test_links_keep_every_component():
    rnd = random.Random(3)
    fps = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 6)):
            fps.append(x)
            for _ in range(rnd.randint(0, 2)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted({*fps, 0, 1, 3, (1 << 64) - 1})
    base = 0x123456789ABCDEF0
    fps += sorted({base ^ (rnd.getrandbits(32) << 32) for _ in range(60)} - set(fps))  # one half in common
    keys = np.array(fps, dtype=np.uint64)
    for split in (2, 2048):
        S.SPLIT = split
        try:
            sent = [b.to_pylist() for b in S._spread(3, 1)([pa.record_batch({"words": pa.array([x.tobytes() for x in keys], pa.binary())})])]
            rows = [r for part in sent for r in part]
            schema = pa.schema([("bucket", pa.int32()), ("fps", pa.binary()), ("slots", pa.binary())])
            out = [e for k in range(3) for e in S._meet(1, S.BITS)(pa.Table.from_pylist([r for r in rows if r["bucket"] == k], schema=schema)).to_pylist()]
        finally:
            S.SPLIT = 2048
        forest = S.Forest()
        at = {int(k): i for i, k in enumerate(fps)}
        for e in out:
            a, b = e["a"] & (1 << 64) - 1, e["b"] & (1 << 64) - 1
            assert (a ^ b).bit_count() <= 2
            forest.join(at[a], at[b])
        assert [forest.find(i) for i in range(len(fps))] == roots(fps)


def test_operator(make):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(12):
        w = [rnd.choice(words) for _ in range(400)]
        rows.append((3 * i, " ".join(w)))
        w[rnd.randrange(400)] = "new"
        rows.append((3 * i + 1, " ".join(w)))
        rows.append((3 * i + 2, " ".join(w).upper()))
    rows += [(50, None), (51, ""), (52, " \n"), (53, "one"), (54, "one"), (None, "one"), (54, "one")]
    fps = [slow_fingerprint(t) for _, t in rows]
    ids = [1 << 62 if i is None else i for i, _ in rows]
    group = roots(fps)
    least = {g: min(ids[k] for k in range(len(rows)) if group[k] == g) for g in group}
    want = sorted(((i if i != 1 << 62 else None, f, least[g] if least[g] != 1 << 62 else None) for i, f, g in zip(ids, fps, group, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in S.near_duplicates(make(rows)).collect()), key=repr)
    assert got == want


def test_empty(make):
    assert S.near_duplicates(make([])).collect() == []


def test_first_of_groups(make):
    rnd = random.Random(6)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a), (5, a.upper()), (5, b), (7, b), (9, c), (9, c), (None, c), (None, text()), (None, ""), (2, None), ((1 << 63) - 1, text())]
    d = make(rows)
    out = S.first_of_groups(d)
    assert out.columns == d.columns
    # 5 stands for b, although its other row goes as a copy of 3; nulls come last
    want = [(3, a), (5, b), (9, c), rows[7], (2, None), rows[10]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert S.first_of_groups(make([])).collect() == []


def test_many_fingerprints_under_one_variant():
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    near = {base}
    while len(near) < 3000:
        near.add(rnd.choice([base, *list(near)[:50]]) ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32)))
    fps = np.array(sorted(near), dtype=np.uint64).reshape(-1, 1)
    both = []
    for find in (lambda f: S._looked_up(fps, np.arange(len(fps)), f, 40), lambda f: S._links(fps, np.arange(len(fps)), f, S.BITS)):
        forest = S.Forest()
        out = find(forest)
        assert all((int(fps[a, 0]) ^ int(fps[b, 0])).bit_count() <= 2 for a, b in out)
        both.append([forest.find(i) for i in range(len(fps))])
    assert both[0] == both[1]


def test_wide_fingerprints():
    rnd = random.Random(1)
    for n in (0, 1, 3, 4, 60):
        w = [rnd.choice(["Ab", "c", "déf", "G"]) for _ in range(n)]
        text = " ".join(w).encode()
        sh = sorted({b" ".join(text.lower().split()[j : j + 3]) for j in range(max(1, n - 2))}) if n else []
        want = 0
        for k in range(S.WIDE):
            h = [int(S.K.mix(np.array([xxhash.xxh64_intdigest(x, 42) ^ (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))[0]) if k else xxhash.xxh64_intdigest(x, 42) for x in sh]
            want |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) << 64 * k
        assert S.fingerprint(text, S.WIDE) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_first_of_groups_takes_edited_copies(make, seed):
    """Of copies that share 0.8 of their 5-word shingles nine tenths go; what shares less than 0.65 with every other stays."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    shingles = lambda t: {tuple(t[j : j + 5]) for j in range(max(1, len(t) - 4))}
    texts = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(80, 400))]
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(w) // 60, len(w) // 40, len(w) // 10])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append((i, w))
    group, best = list(range(len(texts))), [0.0] * len(texts)

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a][0] == texts[b][0]:
                x, y = shingles(texts[a][1]), shingles(texts[b][1])
                share = len(x & y) / len(x | y)
                best[a], best[b] = max(best[a], share), max(best[b], share)
                if share >= 0.8:
                    p, q = top(a), top(b)
                    group[max(p, q)] = min(p, q)
    firsts = {top(k) for k in range(len(texts))}
    got = {r.doc_id for r in S.first_of_groups(make([(k, " ".join(w)) for k, (_, w) in enumerate(texts)])).collect()}
    assert {texts[k][0] for k in got} == set(range(40))  # no group vanishes
    assert len(got - firsts) <= 0.1 * (len(texts) - len(firsts))
    assert all(k in got for k in range(len(texts)) if best[k] < 0.65)


def test_every_wide_link_is_found(spark):
    """Pairs that differ in 46 bits, spread over all segments; those that differ in 47 aren't linked."""
    rnd = random.Random(12)
    fps, want = [], set()
    for n in [S.NEAR, S.NEAR + 1] * 20:
        x = rnd.getrandbits(64 * S.WIDE)
        y = x
        for k in range(n):
            y ^= 1 << 32 * (k % 12) + 8 * (k // 12) + rnd.randrange(8)
        fps += [x.to_bytes(8 * S.WIDE, "little"), y.to_bytes(8 * S.WIDE, "little")]
        a, b = S.node_of(np.frombuffer(fps[-2] + fps[-1], np.uint64).reshape(2, -1)).view(np.int64).tolist()
        if n == S.NEAR:
            want.add((min(a, b), max(a, b)))
    out = S.links(spark.createDataFrame([(bytearray(x),) for x in fps], "words binary"), len(fps), S.WIDE, S.NEAR).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in out} == want
