import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobweave.llm import simhash
from test_free import docs


def brute_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(fps, limit=3):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                top[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    top = brute_labels(fps)
    least = {}
    for (i, _), x in zip(rows, top, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return sorted(((i, f"{f:016x}", least.get(x)) for (i, _), f, x in zip(rows, fps, top, strict=True)), key=str)


def crowds(n, seed=0):
    """Fingerprints in crowds, in chains of three bits each, and alone."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for start in [0, (1 << 64) - 1, rng.getrandbits(64)]:
        for _ in range(n):
            x = start
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            out.append(x)
        for _ in range(10):
            for b in rng.sample(range(64), 3):
                start ^= 1 << b
            out.append(start)
    return out


def gray_sorted(fps):
    def rank(g):
        b = 0
        while g:
            b ^= g
            g >>= 1
        return b

    return np.array(sorted(set(fps), key=rank), np.uint64)


def same_parts(edges, fps, expected):
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[find(int(a))] = find(int(b))
    pairs = {}
    assert all(pairs.setdefault(x, find(f)) == find(f) for f, x in zip(fps, expected, strict=True))
    assert len(set(pairs.values())) == len(pairs)


@pytest.mark.parametrize("chunk", [1 << 17, 64])
def test_trees_find_every_component(chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    x = gray_sorted(crowds(120))
    fps = [int(f) for f in x]
    edges = [p for a, b in simhash.close_fingerprints(x, None, 3) for p in zip(a, b, strict=True)]
    assert len(edges) < len(x)  # a forest, not all pairs
    same_parts(edges, fps, brute_labels(fps))
    # Halves of different size against each other, and each in itself.
    one, two = x[: len(x) // 3], x[len(x) // 3 :]
    edges = [p for s in ((one, None), (two, None), (one, two)) for a, b in simhash.close_fingerprints(*s, 3) for p in zip(a, b, strict=True)]
    same_parts(edges, fps, brute_labels(fps))


def test_fingerprints(monkeypatch):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É é Z", "x\x0by\x0cz\rw", "a b c d", " ".join(f"w{i % 37}" for i in range(3000)), "long" * 300 + " " + "y" * 900 + " z q"]
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        assert [simhash.fingerprint(t and t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_gray_rank(spark):
    fps = [0, 1, 2, 3, (1 << 63), (1 << 64) - 1, 12345678901234567890]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long").select("fp", simhash.gray_rank(F.col("fp")).alias("r")).collect()
    for r in rows:
        b = (r.r + (1 << 63)) & ((1 << 64) - 1)
        assert b ^ (b >> 1) == r.fp % (1 << 64)


def near_texts(n=40):
    rng = random.Random(3)
    base = [[f"b{g}x{i}" for i in range(400)] for g in range(3)]
    rows = []
    for k in range(n):
        w = list(base[k % 3])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{k}{rng.random()}"
        rows.append((1000 - k, " ".join(w)))
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "two one"), (None, rows[0][1]), (None, "alone here now then"), (990, rows[10][1]), (990, "other text for a repeated id"), (7, "w" * 5000), (8, "v " * 40_000)]


@pytest.mark.parametrize("group", [1 << 16, 9])
def test_near_fingerprints(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # 9: many groups, and several nodes above them
    rows = near_texts()
    out = simhash.near_fingerprints(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_fingerprints(docs(spark, [])).collect() == []
    assert [tuple(r) for r in simhash.near_fingerprints(docs(spark, [(5, None)])).collect()] == [(5, "0" * 16, 5)]
