import hashlib
import math
import random

import numpy as np
import pytest

from jobweave.llm import balls, negatives

VECTORS = "vec_id long, embedding array<float>, label int, distance string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], VECTORS).repartition(3)


def f32(x):
    return float(np.float32(x))


def odd_rows(dims):
    nan, inf = float("nan"), float("inf")
    rows = [(900, None, 1), (901, [], 1), (902, [1.0] * (dims - 1), 1), (903, [1.0] * (dims - 1) + [None], 1), (904, [nan] * dims, 1), (905, [inf] + [0.0] * (dims - 1), 1), (906, [1e30] * dims, 1), (907, [1e38] * dims, 2)]
    return rows


def vectors(n, dims, seed=0, copies=0):
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [f32(m + rng.gauss(0, 0.4)) for m in mids[i % 4]], rng.randrange(3)) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 2) for i in range(copies)]


def brute_kmeans(rows, k, rounds, scale, dims, limit):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= limit]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            some = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if some:
                centers[j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    of = {j: sum(d for _, d, c in found if c == j) for j in range(len(centers))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, of[c], sum(of.values()), digest[c]) for i, d, c in found), key=str)


@pytest.mark.parametrize(("rows", "k", "block"), [(vectors(130, 8, copies=60) + odd_rows(8) + [(None, [0.5] * 8, 1)], 5, 16), (vectors(4, 8), 6, 2048), (odd_rows(8), 3, 2048), ([], 3, 2048)])
def test_ball_kmeans(spark, monkeypatch, rows, k, block):
    monkeypatch.setattr(balls, "BLOCK", block)
    out = balls.ball_kmeans(frame(spark, rows), k=k, rounds=4, scale=16, dims=8)
    assert sorted(map(tuple, out.collect()), key=str) == brute_kmeans(rows, k, 4, 16, 8, balls._limit(8))


def test_large_components(spark):
    rows = [(i, [f32(s * 3e4 * (i + 1)) for s in (1, -1, 1, -1)], 0) for i in range(20)] + [(50 + i, [f32(1e6 + i)] * 4, 0) for i in range(20)]
    out = balls.ball_kmeans(frame(spark, rows), k=4, rounds=3, scale=256, dims=4)
    assert sorted(map(tuple, out.collect()), key=str) == brute_kmeans(rows, 4, 3, 256, 4, balls._limit(4))


def test_assignment_does_not_depend_on_the_one_before():
    rng = np.random.default_rng(1)
    x, centers = rng.integers(-9, 9, (400, 3)), rng.integers(-9, 9, (7, 3))
    centers[5] = centers[2]  # equal centroids: the smaller number
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    for own in (np.zeros(400, np.int64), rng.integers(0, 7, 400), d.argmin(axis=1), d.argmax(axis=1)):
        nearest, best = balls.assign(x, own, centers)
        assert (nearest == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_members_of_the_core_are_not_compared(monkeypatch):
    seen = []
    plain = balls._distances
    monkeypatch.setattr(balls, "_distances", lambda x, c: seen.append(len(x)) or plain(x, c))
    near = np.array([[k % 3, k % 2] for k in range(100)])
    balls.assign(np.concatenate([near, near + 1000]), np.repeat([0, 1], 100), np.array([[1, 0], [1001, 1000], [1000, 1060]]))
    assert sum(seen) == 200 + 2 * 3  # each vector with its own centroid, and the centroids


def brute_negatives(rows, every, k, m, low, high, scale, dims_limit):
    kept = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * c) for c in v]
            if max(map(abs, x), default=0) <= dims_limit(len(x)):
                kept.append((i, x, label))
    out = []
    anchors = {(i, tuple(x), label) for i, x, label in kept if i % every == 0}
    for i, x, label in anchors:
        met = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, y, other in kept if j != i and len(y) == len(x)]
        for p, j, _ in sorted(r for r in met if r[2] == label)[:k]:
            fit = sorted(r for r in met if r[2] != label and low * -p <= 100 * -r[0] <= high * -p)[:m]
            out += [(i, j, n + 1, r[1], -p, -r[0]) for n, r in enumerate(fit)]
    return sorted(out)


NEGATIVES = vectors(160, 8, seed=2, copies=40) + [(500, [0.25] * 8, None), (None, [0.25] * 8, 1), (510, [-0.1] * 8, 1), (520, [0.0] * 8, 1), (20, [0.5] * 8, 2), (20, [0.5] * 8, 2), (33, [0.75] * 8, 1), (33, [0.75] * 8, 1)]


@pytest.mark.parametrize(("sparse", "block", "size"), [(16, 4096, 8 << 20), (1, 32, 500), (10**9, 32, 8 << 20)])
def test_hard_negatives(spark, monkeypatch, sparse, block, size):
    monkeypatch.setattr(negatives, "SPARSE", sparse)  # 1: pairs one by one from the begin; 10**9: whole planes to the end
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "SLICE_BYTES", size)  # 500: several slices
    monkeypatch.setattr(negatives, "PAIRS", 50)
    rows = NEGATIVES + odd_rows(8) + [(40 + i, [1.0, 2.0, float(i)], i % 2) for i in range(6)]
    out = negatives.hard_negatives(frame(spark, rows), "vec_id % 10 = 0", scale=16)
    assert sorted(map(tuple, out.collect())) == brute_negatives(rows, 10, 5, 5, 80, 100, 16, negatives._limit)


def test_large_products(spark):
    rows = [(i, [f32((-1) ** (i + c) * 9e4 * (i + 1)) for c in range(4)], i % 3) for i in range(60)]
    out = negatives.hard_negatives(frame(spark, rows), "vec_id % 5 = 0", positives=2, negatives=3, low=10, high=150, scale=256)
    assert sorted(map(tuple, out.collect())) == brute_negatives(rows, 5, 2, 3, 10, 150, 256, negatives._limit)


def test_without_rows(spark):
    assert negatives.hard_negatives(frame(spark, []), "vec_id % 10 = 0").collect() == []
    assert negatives.hard_negatives(frame(spark, odd_rows(8)), "vec_id % 10 = 0").collect() == []
