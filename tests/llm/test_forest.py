"""Vector links against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from strandloom.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n string"


def brute(rows, cosine=0.98):
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    x = [np.array(np.array(v, np.float32), float) if g else None for (_, v, _), g in zip(rows, ok)]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, n[i], c, d == c))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(d, v, l, 1, "x") for d, v, l in rows], SCHEMA)
    return sorted(map(tuple, forest.near_vectors(df).collect()), key=str)


def cloud(seed, n=500, d=32):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 5):
        c = r.standard_normal(d)
        for _ in range(int(r.integers(1, 10))):
            rows.append((c + r.standard_normal(d) * r.choice([0.0, 0.05, 0.15, 0.25])) * r.uniform(0.1, 9))
    return [(int(i), [float(v) for v in np.float32(x)], int(r.integers(0, 2))) for i, x in zip(r.permutation(10 * len(rows)), rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 40)
    rows = cloud(seed)
    assert result(spark, rows) == brute(rows)


def test_further_splits_and_blocks(spark, monkeypatch):
    for k, v in (("LEAF", 60), ("LARGEST", 50), ("SAMPLE", 60), ("BLOCK", 7)):
        monkeypatch.setattr(forest, k, v)
    rows = cloud(3, 300)
    assert result(spark, rows) == brute(rows)


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [float("nan"), 1.0, 2.0], 0), (10, [float("inf"), 1.0, 2.0], 0), (None, v, 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [1.0, 2.01], 0), (None, [9.0, -1.0, 0.0], 0)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_near_copies_never_multiply(spark, monkeypatch):
    """A group within the spill, larger than a leaf may be, beside others: no split parts it, and its rows don't double."""
    for k, v in (("LEAF", 40), ("LARGEST", 50), ("SAMPLE", 200), ("BLOCK", 30)):
        monkeypatch.setattr(forest, k, v)
    seen = []
    was = forest._leaf_links, forest.cut
    monkeypatch.setattr(forest, "cut", lambda df: seen.append((out := was[1](df)).count()) or out)
    r = np.random.default_rng(9)
    c = r.standard_normal(32)
    x = [c * s for s in r.uniform(0.1, 9, 80)] + [c + 0.01 * r.standard_normal(32) for _ in range(80)] + [c + 0.12 * r.standard_normal(32) for _ in range(40)]
    rows = [(i, [float(t) for t in np.float32(v)], 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v, _ in cloud(4, 60)]
    assert result(spark, rows) == brute(rows)
    assert max(seen) < 40 * len(rows)


def test_a_hot_group_at_full_size(spark, monkeypatch):
    """10,000 vectors of one label at about cosine 0.999, with the constants as they are: it ends, rows stay few, every link is counted."""
    seen = []
    was = forest.cut
    monkeypatch.setattr(forest, "cut", lambda df: seen.append((out := was(df)).count()) or out)
    r = np.random.default_rng(3)
    n, d = 10_000, 64
    c = r.standard_normal(d)
    x = np.float32(c + 0.0316 * np.linalg.norm(c) / np.sqrt(d) * r.standard_normal((n, d)))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": 0}), "vec_id long, embedding array<float>, label int")
    got = {v.vec_id: (v.n_links, v.component_id) for v in forest.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = np.concatenate([(u[i : i + 500] @ u.T >= 0.98).sum(1) - 1 for i in range(0, n, 500)])
    assert links.min() > n // 2
    assert got == {i: (int(links[i]), 0) for i in range(n)}
    assert max(seen) <= 40 * n
