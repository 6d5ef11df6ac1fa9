"""Statistics against brute force, and rules on separable data."""

import random
import re
from collections import Counter

import numpy as np

from strandloom.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    hit = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(set(w)), max(Counter(w).values(), default=0)


def texts():
    r = random.Random(3)
    out = [None, "", " ", "\n\n", "é", "a b c d e f g h", "x " * 30, "l\nl\n l\nl \nl", "#" * 5, "w " * 100_000]
    for _ in range(150):
        words = [r.choice(["a", "bé", "C", "#x", "1|2", "漢字"]) for _ in range(r.randrange(0, 90))]
        out.append("".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in words))
        base = [f"q{r.randrange(500)}" for _ in range(r.randrange(5, 40))]
        out.append(" ".join(base + [f"z{r.randrange(99)}"] + base[: r.randrange(0, 20)]))
    return out


def test_statistics(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.judge(df, []).collect()}
    for i, t in rows:
        g, b = got[i], brute(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.n_distinct_words, g.n_top_word) == b, t
        assert g.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and g.kept == (not g.base_failed)
    assert quality.judge(df.limit(0), []).collect() == []


def test_rules_separate():
    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.RATIOS)))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.7) & (x[:, 6] <= 0.2))
    rules = quality.learn(x, bad)
    found = np.zeros(len(x), bool)
    for rule in rules:
        found |= rule.covers(x)
    assert (found == bad).mean() > 0.97 and len(rules) <= 6


def test_training_and_columns(spark):
    good, poor = "plain words of a text that goes on " * 1, "%%% a%% %b% $$ c$ "
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + " " + (poor * 3 if i % 4 == 0 else good)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(120)] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    rules = quality.train(docs, labels)
    assert rules
    assert all(r.kept == (r.doc_id % 4 != 0) for r in quality.judge(docs, rules).collect())
    assert quality.train(docs, labels.limit(0)) == []
