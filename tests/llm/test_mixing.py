"""Mixing against a brute-force plan, and the laws of budgets and permutations."""

import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

from strandloom.llm import mixing


def corpus(seed, n=600):
    r = random.Random(seed)
    return [(i, " ".join("w" * r.randrange(1, 40)) if r.random() < 0.95 else r.choice([None, "", " "]), "big" if r.random() < 0.5 else r.choice(["a", "b", "c", None, "d"]), "x") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def totals(rows):
    t = Counter()
    for _, text, s, _ in rows:
        t[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return t


def test_solve_by_grid():
    t = np.array([10_000, 2_000, 500, 100])
    for share, limit in ((0.9, None), (0.95, 3.0), (None, 1.5), (0.2, 9.0)):
        p = mixing.solve(t, share, limit, int(t.sum()))
        q = t / t.sum()

        def ok(a, share=share, limit=limit, q=q):
            w = mixing.weights(q, a)
            return (limit is None or (w / q).max() <= limit * (1 + 1e-9)) and True, share is None or mixing.entropy(w) >= share * log(4) - 1e-9

        grid = [a for a in np.linspace(0, 1, 2001) if ok(a)[0]]
        want = max([a for a in grid if ok(a)[1]], default=min(grid))  # the limit goes before the entropy
        assert abs(p.exponent - want) < 1e-3
        assert abs(p.tokens.sum() - t.sum()) <= len(t)


@pytest.mark.parametrize("budget", ["same", 500, None])
def test_budgets(spark, budget):
    rows = corpus(1)
    got = mixing.mix(frame(spark, rows), 0.95, 2.5, budget).collect()
    t = totals(rows)
    keys = sorted(t, key=lambda s: "n" if s is None else "s" + s)
    n = np.array([t[k] for k in keys])
    p = mixing.solve(n, 0.95, 2.5, int(n.sum()) if budget == "same" else budget)
    size = {d: len((x or "").split()) for d, x, _, _ in rows}
    for k, full, rest in zip(keys, p.full, p.rest):
        docs = {d for d, _, s, _ in rows if s == k}
        by = defaultdict(list)
        for r in got:
            if r.source == k:
                by[r.epoch].append(r)
        for e in range(full):
            assert {r.doc_id for r in by[e]} == docs and len(by[e]) == len(docs)
        part = sorted(by.get(full, []), key=lambda r: (r.block_key, r.doc_key))
        spent = sum(size[r.doc_id] for r in part)
        assert rest <= spent < rest + max(size.values()) or (rest == 0 and spent == 0)
        # consecutive in the order given: all but the last fit
        assert len({r.doc_id for r in part}) == len(part)
        assert set(by) <= set(range(full + 1))
        orders = {tuple(r.doc_id for r in sorted(v, key=lambda r: (r.block_key, r.doc_key))) for e, v in by.items() if e < full}
        assert len(orders) == full or len(docs) < 3
    if budget is None:
        assert {r.doc_id for r in got} == {d for d, *_ in rows}


@pytest.mark.parametrize("budget", ["same", None])
def test_many_sources(spark, monkeypatch, budget):
    """More sources than the driver takes give the same rows."""
    rows = [(i, " ".join("w" * (1 + i % 23)), f"s{(i * i) % 37}", "x") for i in range(500)] + [(999, "", "empty", "x")]
    take = lambda: sorted((r.doc_id, r.epoch, round(r.weight, 9)) for r in mixing.mix(frame(spark, rows), 0.97, 3.0, budget).collect())
    want = take()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    assert take() == want and len(want) > 300


def test_columns_and_edges(spark):
    rows = corpus(2, 100)
    out = mixing.mix(frame(spark, rows), budget=None, columns=True)
    assert out.columns == ["doc_id", "text", "source", "epoch"]
    assert {tuple(r) for r in out.collect()} == set(rows)
    assert mixing.mix(frame(spark, [])).collect() == []
    same = [(1, "a b", "s", ""), (1, "a b", "s", ""), (2, None, "t", ""), (None, "c d", None, "")]
    got = mixing.mix(frame(spark, same), budget=None).collect()
    assert Counter(r.doc_id for r in got)[1] >= 2 and {r.doc_id for r in got} == {1, 2, None}
