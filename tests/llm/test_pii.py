"""Base spans against plain regular expressions, the field's labels, and masking."""

import random
import re

import numpy as np

from strandloom.llm import pii

PLAIN = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and max(map(int, m.group().split("."))) > 255 or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(2)
    parts = ["a.b", "@", "x-1.co", ".", "+1", " ", "(974)", "555-3436", "10.0.0.1", "300", "4111 1111 1111 1111", "4111111111111111", "-", "é", "\n", "%", "0", "a@b.c", "@@", "..", "+", "+1 (974) 555-3436"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000, "@" * 100_000, "a at " * 60_000, "(" * 100_000):
        pii.base_spans(t)
        pii.candidates(t, [])


def field():
    w = np.zeros((pii.NODE, pii.OTHER + 1))
    w[0, pii.OTHER] = 2.0
    return pii.Field(w, np.array([8.0, 6.0]))


def test_chain_labels_distant_repeats():
    t = "call +1 (974) 555-3436 now. " + "words " * 50 + "again 974-555-3436 or 1 974 555 3436, not 888-111-2222."
    got = [(t[a:b], k) for a, k, b in pii.added(t, field(), 0.9)]
    assert got == [("974-555-3436", 3), ("1 974 555 3436", 3)]
    assert pii.added("no base: 974-555-3436 and 974-555-3436", field(), 0.9) == []
    t = "jo@ex.org wrote; later jo [at] ex [dot] org"
    assert [(t[a:b], k) for a, k, b in pii.added(t, field(), 0.9)] == [("jo [at] ex [dot] org", 0)]


def test_beliefs_on_a_tree_are_exact():
    r = np.random.default_rng(3)
    f = pii.Field(r.normal(size=(2, pii.OTHER + 1)), np.array([1.3, 0.7]), rounds=200, damping=0.3)
    x, edges, held = r.normal(size=(4, 2)), [(0, 1, 0), (1, 2, 1), (1, 3, 0)], np.array([2, -1, -1, -1])
    k = pii.OTHER + 1
    p = np.zeros((4, k))
    for y in np.ndindex(*[k] * 4):
        if y[0] == 2:
            s = np.exp(sum((x[i] @ f.node)[y[i]] for i in range(1, 4)) + sum(f.edge[e] * (y[a] == y[b]) for a, b, e in edges))
            for i in range(4):
                p[i, y[i]] += s
    assert np.allclose(f.beliefs(x, held, edges), p / p.sum(1, keepdims=True), atol=1e-4)


def test_beliefs_on_rings_against_plain_messages():
    """The same messages, one by one from their definition, on graphs with rings."""
    r = np.random.default_rng(5)
    k = pii.OTHER + 1
    for n, edges in ((3, [(0, 1, 0), (1, 2, 1), (0, 2, 0)]), (5, [(0, 1, 0), (1, 2, 0), (2, 3, 1), (0, 3, 1), (3, 4, 0)])):
        f = pii.Field(r.normal(size=(2, k)), np.array([1.1, 0.6]), rounds=12, damping=0.5, near=r.normal(size=(2, pii.BESIDE, k)))
        x, held, words = r.normal(size=(n, 2)), np.full(n, -1), r.integers(0, pii.BESIDE, (n, 2))
        own = [[float((x[i] @ f.node)[y] + f.near[0, words[i, 0], y] + f.near[1, words[i, 1], y]) for y in range(k)] for i in range(n)]
        links = {(a, b): e for a, b, e in edges} | {(b, a): e for a, b, e in edges}
        msg = {p: [0.0] * k for p in links}
        for _ in range(12):
            new = {}
            for (a, b), e in links.items():
                out = []
                for y in range(k):
                    out.append(np.log(sum(np.exp(own[a][z] + sum(msg[c, d][z] for c, d in links if d == a and c != b) + f.edge[e] * (y == z)) for z in range(k))))
                new[a, b] = [v - max(out) for v in out]
            msg = {p: [0.5 * u + 0.5 * v for u, v in zip(msg[p], new[p])] for p in links}
        want = np.array([[own[i][y] + sum(msg[c, d][y] for c, d in links if d == i) for y in range(k)] for i in range(n)])
        want = np.exp(want - want.max(1, keepdims=True))
        assert np.allclose(f.beliefs(x, held, edges, words), want / want.sum(1, keepdims=True), atol=1e-6)


def planted(seed, n):
    """Documents with distant reformatted repeats, beside a base span or not, and with numbers that are nothing; what is to be found."""
    r = random.Random(seed)
    words = lambda: " ".join(r.choice(["lorem", "bane", "tal", "miro", "sunt"]) for _ in range(r.randrange(3, 40)))
    rows, want = [], {}
    for i in range(n):
        a, b, c = (str(r.randrange(10 ** (k - 1), 10**k)) for k in (3, 3, 4))
        user, host = f"u{r.randrange(999)}.x", f"h{r.randrange(99)}.org"
        base = [f"+1 ({a}) {b}-{c}", f"{user}@{host}"]
        other = [[f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"1 {a} {b} {c}", f"{a}{b}{c}"], [f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} at {host.replace('.', ' dot ')}"]]
        none = [f"{r.randrange(1950, 2030)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", str(r.randrange(10**7, 10**8)), str(r.randrange(10**9, 10**10)), f"{r.randrange(1, 9)}.{r.randrange(100, 999)}.{r.randrange(100, 999)}"]
        kind = i % 4
        parts, spans = [words()], []
        which = r.randrange(2)
        if kind == 0:  # a base span and its repeats
            parts += [base[which], words()]
        if kind in (0, 1):
            many = other[which][: 3 if kind else 4]
            r.shuffle(many)
            spans = many[:2]
        elif kind == 2:  # numbers that repeat
            x = r.choice(none)
            parts += [x, words(), x, words(), x]
        for x in spans:
            parts += [words(), x]
        rows.append((i, " ".join([*parts, words()])))
        want[i] = set(spans)
    return rows, want


def test_repeats_are_found_by_their_chains(spark):
    """What message passing gains over the same potentials without edges."""
    rows, _ = planted(1, 600)
    f = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    rows, want = planted(2, 400)
    alone = pii.Field(f.node, np.zeros(pii.EDGE), near=f.near)
    total = sum(map(len, want.values()))

    def found(field):
        got = {i: {t[a:b] for a, _, b in pii.added(t, field, 0.9)} for i, t in rows}
        return sum(len(got[i] & want[i]) for i in want) / total, sum(len(got[i] - want[i]) for i in want)

    recall, wrong = found(f)
    before, _ = found(alone)
    assert recall > 0.9 and wrong == 0 and before < recall - 0.4, (recall, wrong, before)


def test_rows(spark):
    text = "a@b.co 10.0.0.1, 4111111111111111, +1 (974) 555-3436 then 974-555-3436 " + "filler " * 5
    rows = [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "clean", "s"), (4, "clean", "s"), (None, "x@y.zz", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    f = pii.train(df)
    got = pii.find(df, f).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert [(s["kind"], s["from"], s["to"]) for s in by[1].base] == [(pii.KINDS[k], a, b) for a, k, b in brute(text)]
    assert by[2].base == by[3].base == by[4].base == [] and len(by[None].base) == 1
    masked = {r.doc_id: r.text for r in pii.mask(df, field()).collect()}
    assert masked[2] is None and masked[4] == "clean" and masked[None] == "[EMAIL]"
    assert masked[1].startswith("[EMAIL] [IP], [CARD], [PHONE] then [PHONE] filler")
    assert pii.find(df.limit(0), f).collect() == []
