"""The automaton against brute-force edit distance, context, and held-out accuracy."""

import itertools
import random

from strandloom.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    terms = [("idiot", False, 1.0), ("scum", False, 1.0), ("trash", False, 1.0), ("idiom", False, 1.0), ("réeux", True, 1.0)]
    auto = tx.Automaton(terms, frozenset(["thrash"]))
    r = random.Random(1)
    words = ["idiot", "IDIOT", "1d10t", "thrash", "scums", "scum", "réeux", "réeuxa", "réeuxment", "zzzz", "tras", "rash"]
    for t, _, _ in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(w) + 1)
                op = r.random()
                if op < 0.33:
                    w.insert(k, r.choice("abiotré"))
                elif w and k < len(w):
                    w[k : k + 1] = [] if op < 0.66 else [r.choice("abiotré")]
            if w:
                words.append("".join(w))
    text = " ".join(words)
    import numpy as np

    starts, ends, final = auto.run(auto.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)])
    assert [text[a:b] for a, b in zip(starts, ends)] == words
    for w, s in zip(words, final):
        t = tx.tokens(w)[0]
        want = None
        if t.startswith("réeux") and len(t) > 5:
            want = 0
        elif t != "thrash":
            if t in ("idiot", "scum", "trash", "idiom"):
                want = 0
            elif any(distance(t, x) == 1 for x in ("idiot", "trash", "idiom")):
                want = 1
        assert (auto.edits[s] if auto.term[s] >= 0 else None) == want, w


def hits(auto, text):
    return tx.features([text], auto)[0, :3].tolist()


def test_terms_of_any_script():
    """A term of letters beyond U+3000 is found like any other; an ideographic space parts words."""
    terms = [("愚か者達奴", False, 1.0), ("바보멍청이", False, 1.0), ("scumbag", False, 1.0)]
    auto = tx.Automaton(terms)
    for t, _, _ in terms:
        exact, has, fuzzy = hits(auto, f"a {t} b\u3000{t}, c {t[:-1]}")
        assert has == 1 and exact > 1 and fuzzy > 0, t
    assert hits(auto, "ＳＣＵＭＢＡＧ") == [0, 0, 0]  # full-width letters are letters of their own


def test_no_bound_on_near_misses():
    """Every word that is to be left alone is, however many there are."""
    r = random.Random(3)
    stop = set()
    while len(stop) < 2500:
        w = list("abominable")
        w[r.randrange(10)] = chr(0x4E00 + r.randrange(300))
        stop.add("".join(w))
    auto = tx.Automaton([("abominable", False, 1.0)], frozenset(stop))
    assert hits(auto, " ".join(sorted(stop))) == [0, 0, 0]
    assert hits(auto, "abominible")[2] > 0


def test_lexicon_keeps_every_term():
    rows = [(f"wterm{i:04d}x", 50, 0) for i in range(1500)]
    assert len(tx.lexicon(rows, 100, 1000)) == 1500
    got = tx.lexicon([("svilwor", 90, 0), ("wvilword", 60, 0), ("wvil", 60, 0)], 100, 1000)
    assert ("vilword", False) in [(t, s) for t, s, _ in got]  # a stem matches to the letter alone
    auto = tx.Automaton(got)
    assert hits(auto, "vilword vilwords")[0] > 0 and hits(auto, "vilwird")[2] > 0


def corpus(seed, n):
    r = random.Random(seed)
    plain = [f"{a}{b}{c}" for a, b, c in itertools.product(["ba", "lo", "mi", "ru"], ["ne", "ta", "su", "vo"], ["", "k", "n"])]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randrange(10, 120))]
        y = int(r.random() < 0.15)
        if y:
            for _ in range(max(3, len(w) // 40)):
                w.insert(r.randrange(len(w)), r.choice(["vilword", "nastling", "grubhead"]))
        docs.append((i, " ".join(w), "toxic"))
        labels.append((i, y))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(4, 1200)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    model = tx.train(d, lab, use=lambda c: c % 3 != 0)
    got = {r.doc_id: r for r in tx.score(d, model).collect()}
    held = [(got[i].predicted, y) for i, y in labels if i % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # misspelled terms count, quoted ones less
    text = "bane lota misu ruvo " * 5
    rows = [(1, text + "vilwrod nastlng grubheads viilword nastlin"), (2, text), (3, text + "nastling vilword grubhead"), (4, text + '"nastling vilword grubhead" ' + text), (5, None), (6, ""), (6, ""), (None, "x")]
    s = {r.doc_id: r.score for r in tx.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert s[3] > s[4] and s[3] > 0.5 > s[2] and s[1] > s[2]
    assert len(s) == 7 and s[5] == s[6]
    assert tx.score(d.limit(0), model).collect() == []
    kept = tx.keep(d, model).collect()
    assert {r.doc_id for r in kept} == {i for i, r in got.items() if not r.predicted} and len(kept[0]) == 3


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in tx.score(d, tx.train(d, lab)).collect()] == [0]
