"""Repeat removal against brute force."""

import random
import re

import pytest

from strandloom.llm import substring


def brute(rows, window):
    """rows: distinct (doc_id, text)."""
    first, docs = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if first.setdefault(key, (d, i)) != (d, i):
                gone[i : i + window] = [True] * window
        docs.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(docs, key=str)


def result(spark, rows, window):
    df = spark.createDataFrame([(d, t, 1, "m") for d, t in rows], "doc_id long, text string, lo int, marks string")
    return sorted((tuple(r)[:4] for r in substring.remove_repeats(df, window=window).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "é", "THING", *[f"w{i}" for i in range(r.choice([3, 40, 2000]))]]
    shared = [[r.choice(vocab) for _ in range(r.randrange(15, 80))] for _ in range(12)]
    texts = []
    for _ in range(150):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += r.choice(shared)[r.randrange(0, 5) :] if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        texts.append(r.choice([" ", "\n", " \t "]).join(w))
    texts += r.sample(texts, 30)
    return list(zip(r.sample(range(10_000), len(texts)), texts))


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 9), (4, 21), (5, 20)])
def test_brute_force(spark, seed, window, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 5000)
    rows = corpus(seed)
    assert result(spark, rows, window) == brute(rows, window)


def test_edge_cases(spark):
    long = " ".join(f"x{i % 7000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, long), (6, long + " tail"), (None, "q " * 30), (8, "q " * 25)]
    assert result(spark, rows, 20) == brute(rows, 20)
    assert result(spark, [], 20) == []
    # repeated rows are one document; other texts of one id are apart
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    assert [r[2] for r in result(spark, [(1, a), (1, a), (1, b)], 20)] == [0, 0, 0]
    assert sorted(r[2] for r in result(spark, [(1, a), (1, a + " z"), (2, a)], 20)) == [0, 30, 30]
