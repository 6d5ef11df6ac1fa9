"""Near-duplicates against brute force."""

import random
import re

from strandloom.llm import minhash

SCHEMA = "doc_id long, text string, kept string, node long"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["the", "OF", "é", "thing", "and", *[f"w{i}" for i in range(300)]]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 90))) for _ in range(n)]
    for _ in range(2 * n):
        w = r.choice(texts).split()
        for _ in range(r.randrange(0, 4)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w) if r.random() < 0.7 else "\t".join(w).upper())
    ids = r.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts))


def test_brute_force(spark):
    rows = corpus(3)
    assert result(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP", 2)
    rows = corpus(4, 40)
    assert result(spark, rows) == brute(rows)


def test_a_line_that_unlike_documents_share(spark, monkeypatch):
    """A list of unlike members parts by further coordinates; near copies among them are found all the same."""
    monkeypatch.setattr(minhash, "BLOCK", 12)
    r = random.Random(7)
    line = " ".join(f"common{i}" for i in range(40))
    rows = []
    for i in range(160):
        own = " ".join(f"v{r.randrange(10**6)}" for _ in range(r.randrange(15, 60)))
        rows.append((i, own + " " + line))
        if i % 8 == 0:
            rows.append((1000 + i, own + " " + line + " end"))
    assert result(spark, rows) == brute(rows)


def test_representatives(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(6, a, "x", 1), (6, b, "x", 2), (6, a, "x", 1), (7, a + " z", "y", 3), (3, b + " z", "y", 4), (8, None, "n", 5), (9, "", "n", 6), (None, "", "n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __own string, __fp long")
    out = minhash.representatives(df)
    assert out.columns == df.columns
    # 6 and 3 stand for the two texts; b of 6 is a copy of 3's, which has the least id
    assert sorted((r.doc_id, r[3]) for r in out.collect() if r.doc_id is not None) == [(3, 4), (6, 1), (8, 5), (9, 6)] and out.count() == 5
    assert minhash.representatives(df.limit(0)).collect() == []


def test_edge_cases(spark):
    long = " ".join(f"x{i % 7000}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (6, "two words"), (7, None), (None, "a b c d"), (None, "A b c d"), (9, "a b c d"), (None, "lone text here"), (11, long), (12, long + " y"), (6, "other text of the same id")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
