"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from exact patterns and always stay. Looser patterns propose further candidates: digit
groups and written-out addresses. The candidates and base spans of a document, in text order, are the nodes of
a graph. Its skip edges join each token to the next one, however distant, with the same content (the same
digits, the same address) or similar content (the same last seven digits, the same local part), so a
repeated token is a chain and never all pairs. Node potentials are a softmax over shape features and the
log odds of the words beside a token; edge potentials are the agreement of labels that joined tokens show. Loopy
belief propagation with base nodes held fixed labels the rest, and a candidate becomes a span if its label's
probability reaches `least`.

What is fitted comes from all documents, without labels by hand: base spans, other spellings of each (whose label is
known), plain numbers, and candidates, which have the label of a base span in their chain or, with weight
`unlabelled`, none. As a token that only looks like an entity may be anything, other spellings count as no entity
with weight `doubt`. A lone token so stays below `least` unless the words beside it speak for it; repeats in a document
support each other, and one base span settles its chain.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._text import lean

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_loose = re.compile(r"(?<![A-Za-z0-9+.])\+?\(?[0-9]++(?:[ ().\-/]{1,3}[0-9]++)*+(?![A-Za-z_])")
_spelled = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,64}+)+", re.I)
_word = re.compile(r"[^\W\d_]+")
NODE, EDGE, BESIDE = 17, 2, 256  # features of a node; kinds of edge: same, similar; buckets of the words before and after
#: numbers that are no personal data, as examples of shapes that a corpus may lack
PLAIN = ["1234567", "20240115", "2024-01-15", "15/01/2024", "15.01.2024", "1234567890", "123456789012", "1234567890123456", "1.234.567", "12 345 678", "978-3-16-148410-0", "3.14159265", "4821-775520", "1999-2004", "1.000.000.000"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(_digit.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; leftmost non-overlapping matches of each kind, failing ones dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:  # each address has one @, and starts where the run of its local part does
        lo = at
        while lo > done and text[lo - 1] in _local:
            lo -= 1
        if lo < at and (m := _domain.match(text, at + 1)):
            out.append((lo, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            d = digits_of(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= len(digits_of(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Looser spans that overlap no base span and no earlier candidate."""
    found = []
    if "@" in text or "dot" in (low := text.lower()) and "at" in low:
        found += [m.span() for m in _spelled.finditer(text) if "@" in m.group() or "dot" in m.group().lower()]
    if _digit.search(text):
        found += [m.span() for m in _loose.finditer(text) if len(digits_of(m.group())) >= 7]
    out, taken = [], sorted((a, b) for a, _, b in base)
    i, end = 0, 0
    for a, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            out.append((a, b))
            end = b
    return out


def address(s: str) -> str:
    s = re.sub(r" ?(?:\[at\]|\(at\)| at ) ?", "@", s.lower())
    return re.sub(r" ?(?:\[dot\]|\(dot\)| dot ) ?", ".", s).replace(" ", "")


def keys(s: str) -> tuple[str, str]:
    """What the same and what similar tokens share."""
    if "@" in (a := address(s)):
        return "m" + a, "l" + a.split("@")[0]
    d = digits_of(s)
    return "d" + d, "s" + d[-7:]


def shape(s: str) -> list[float]:
    d = digits_of(s)
    n, groups = len(d), [len(g) for g in re.findall(r"[0-9]+", s)]
    mail = "@" in address(s)
    if mail:
        return [1.0, 1.0, *[0.0] * (NODE - 3), address(s).count("@") == 1 and "." in address(s).split("@")[-1]]
    four = len(groups) == 4 and s.count(".") == 3
    date = groups in ([4, 2, 2], [2, 2, 4], [1, 2, 4], [2, 1, 4], [4, 4])
    return [1.0, 0.0, s.startswith("+"), "(" in s, four, 12 <= n <= 19, 9 <= n <= 15, 7 <= n < 9, n > 19, len(groups) == 1, "-" in s or " " in s, luhn(d) if 12 <= n <= 19 else 0.0, groups[-3:] == [3, 3, 4], groups == [4, 4, 4, 4] or groups == [4, 6, 5], date, four and all(int(g) <= 255 for g in re.findall(r"[0-9]+", s) if len(g) < 5), 0.0]


def beside(text: str, a: int, b: int) -> tuple[int, int]:
    """Buckets of the words before and after a span, 0 where there is none."""
    before, after = _word.findall(text[max(0, a - 24) : a]), _word.findall(text[b : b + 24])
    bucket = lambda w: 1 + zlib.crc32(w.lower().encode()) % (BESIDE - 1)
    return bucket(before[-1]) if before else 0, bucket(after[0]) if after else 0


def spellings(kind: int, s: str) -> list[str]:
    """Other ways to write a base span, none of which the patterns of its kind take."""
    if kind == 0:
        local, domain = s.split("@", 1)
        return [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} at {domain.replace('.', ' dot ')}"]
    d = digits_of(s)
    if kind == 1:
        return [s.replace(".", " . ")]
    if kind == 2:
        parts = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [".".join(parts), "/".join(parts)]
    tail = [d[-10:-7], d[-7:-4], d[-4:]]
    if not tail[0]:
        return [d]
    head = [d[:-10]] if d[:-10] else []
    return ["-".join(tail), " ".join(head + tail), f"({tail[0]}) {tail[1]}-{tail[2]}", ".".join(tail), "".join(tail)]


def chains(tokens: list[str]) -> list[tuple[int, int, int]]:
    """Skip edges (a, b, kind): each token and the next with its content, else the next with similar content."""
    edges, last = [], ({}, {})
    for i, t in enumerate(tokens):
        for kind, k in enumerate(keys(t)):
            if k in last[kind]:
                j = last[kind][k]
                if kind == 0 or keys(tokens[j])[0] != keys(t)[0]:
                    edges.append((j, i, kind))
            last[kind][k] = i
    return edges


class Field:
    """Node weights (features x labels, and words beside x labels) and edge weights (agreement by kind)."""

    def __init__(self, node: np.ndarray, edge: np.ndarray, rounds: int = 15, damping: float = 0.5, near: np.ndarray | None = None):
        self.node, self.edge, self.rounds, self.damping = node, edge, rounds, damping
        self.near = np.zeros((2, BESIDE, OTHER + 1)) if near is None else near

    def beliefs(self, x: np.ndarray, held: np.ndarray, edges: list[tuple[int, int, int]], words: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of each node by loopy sum-product; held is a label or -1."""
        n, k = len(x), OTHER + 1
        unary = x @ self.node
        if words is not None:
            unary = unary + self.near[0, words[:, 0]] + self.near[1, words[:, 1]]
        fixed = held >= 0
        unary[fixed] = -30.0
        unary[fixed, held[fixed]] = 0.0
        if edges:
            e = np.array(edges)
            src, dst, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([e[:, 2], e[:, 2]])
            m = len(e)
            back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
            gain = np.exp(self.edge[kind])[:, None]
            msg = np.zeros((2 * m, k))
            for _ in range(self.rounds):
                total = unary.copy()
                np.add.at(total, dst, msg)
                out = total[src] - msg[back]
                p = np.exp(out - out.max(1, keepdims=True))
                new = np.log(p.sum(1, keepdims=True) + (gain - 1) * p)
                new -= new.max(1, keepdims=True)
                if np.abs(new - msg).max() < 1e-6:
                    break
                msg = self.damping * msg + (1 - self.damping) * new
            unary = unary.copy()
            np.add.at(unary, dst, msg)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def nodes(text: str) -> tuple[list[tuple[int, int]], np.ndarray, list[str]]:
    """Base spans and candidates of a text in order, with the label that the patterns give (-1: none), and the strings."""
    base = base_spans(text)
    all_ = sorted([(a, b, k) for a, k, b in base] + [(a, b, -1) for a, b in candidates(text, base)])
    return [(a, b) for a, b, _ in all_], np.array([k for _, _, k in all_], np.int64), [text[a:b] for a, b, _ in all_]


def tops(n: int, edges: list[tuple[int, int, int]]) -> list[int]:
    """The first node of each node's chain."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, _ in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def added(text: str, field: Field, least: float) -> list[tuple[int, int, int]]:
    where, held, strings = nodes(text)
    if not (held < 0).any():
        return []
    p = field.beliefs(np.array([shape(s) for s in strings], float), held, chains(strings), np.array([beside(text, a, b) for a, b in where]))
    best = p[:, :OTHER].argmax(1)
    return [(a, int(best[i]), b) for i, (a, b) in enumerate(where) if held[i] < 0 and p[i, best[i]] >= least]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (what, x, label): nodes and other spellings by features, words beside, and edges by kind and agreement."""
    for b in batches:
        count: Counter = Counter()
        for text in b.column(0):
            text = text.as_py() or ""
            where, held, strings = nodes(text)
            if not strings:
                continue
            edges = chains(strings)
            top = tops(len(strings), edges)
            kinds = {top[i]: int(k) for i, k in reversed(list(enumerate(held))) if k >= 0}
            for i, (s, k) in enumerate(zip(strings, held)):
                y = int(k) if k >= 0 else kinds.get(top[i], OTHER)
                count["node", " ".join(f"{v:g}" for v in shape(s)), y] += 1
                for side, w in enumerate(beside(text, *where[i])):
                    count["beside", f"{side} {w}", y] += 1
                for other in spellings(y, s) if k >= 0 else ():
                    count["spelled", " ".join(f"{v:g}" for v in shape(other)), y] += 1
            for i, j, kind in edges:
                if held[i] >= 0 and held[j] >= 0:  # as held tokens say: a pair with a free one is no disagreement
                    count["edge", str(kind), int(held[i] == held[j])] += 1
        rows = list(count.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["what", "x", "y", "n"])


def train(docs: DataFrame, text_col: str = "text", doubt: float = 0.2, unlabelled: float = 0.1, penalty: float = 1.0) -> Field:
    """Fit the potentials to the base labels of all documents.

    The driver receives counts of feature combinations, whose number doesn't depend on the input. Null and empty texts,
    and empty tables, count nothing; without base spans no candidate becomes one.
    """
    ship(docs.sparkSession)
    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_tally), "what string, x string, y int, n long").groupBy("what", "x", "y").agg(F.sum("n").alias("n")).orderBy("what", "x", "y").collect()
    # before anything is counted: tokens of the same content nearly always agree, similar ones mostly
    agree, near = np.array([[1.0, 50.0], [1.0, 10.0]]), np.zeros((2, BESIDE, OTHER + 1))
    xs, ys, ns = [], [], []

    def example(x: list[float], y: int, n: float) -> None:
        xs.append(x)
        ys.append(y)
        ns.append(n)

    for r in got:
        if r.what == "edge":
            agree[int(r.x), r.y] += r.n
        elif r.what == "beside":
            side, w = map(int, r.x.split())
            near[side, w, r.y] += r.n
        else:
            x = [float(v) for v in r.x.split()]
            if r.what == "spelled":
                example(x, r.y, (1 - doubt) * r.n)
                example(x, OTHER, doubt * r.n)
            else:
                example(x, r.y, r.n if r.y != OTHER else unlabelled * r.n)
    w = np.zeros((NODE, OTHER + 1))
    if any(y != OTHER for y in ys):
        each = sum(n for n, y in zip(ns, ys) if y != OTHER) / len(PLAIN)
        for number in PLAIN:
            example([float(v) for v in shape(number)], OTHER, each)
        x, y, n = np.array(xs), np.eye(OTHER + 1)[ys], np.array(ns, float)
        for _ in range(3000):  # weighted softmax regression by gradient steps
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = (x.T @ (n[:, None] * (y - p)) - penalty * w) / n.sum()
            w += step
            if np.abs(step).max() < 1e-6:
                break
    else:
        w[0, OTHER] = 10.0
    # log odds of a word given the label against any label; few counts say little
    whole = near.sum(2, keepdims=True) + 1.0
    whole /= whole.sum(1, keepdims=True)
    share = (near + 50 * whole) / (near.sum(1, keepdims=True) + 50)
    log_odds = np.clip(np.log(share / whole), -1.5, 1.5)
    # k labels agree by chance once in k
    edge = np.log(agree[:, 1] / agree[:, 0] * OTHER)
    return Field(w, np.clip(edge, 0.0, 12.0), near=log_odds)


def _find(field: Field, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for text in b.column(1):
                text = text.as_py() or ""
                x = base_spans(text)
                base.append([(KINDS[k], a, e) for a, k, e in x])
                more.append([(KINDS[k], a, e) for a, k, e in added(text, field, least)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))
            as_rows = lambda v: [[{"kind": k, "from": a, "to": e} for k, a, e in r] for r in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_rows(base), kind), pa.array(as_rows(more), kind)], names=["doc_id", "base", "added"])

    return run


SPANS = "array<struct<kind:string,`from`:int,`to`:int>>"


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """(doc_id, base, added) for every row: spans in code points, end exclusive.

    Null and empty texts have none. Rows are independent, so repeats and ties don't matter; other columns of
    any name are ignored. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_find(field, least)), f"doc_id {kind}, base {SPANS}, added {SPANS}")


def _mask(field: Field, least: float, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(text_at):
                text = t.as_py()
                if text:
                    base = base_spans(text)
                    spans = sorted((a, e, k) for a, k, e in [*base, *added(text, field, least)])
                    if spans:
                        parts, at, label = [], 0, None
                        for a, e, k in spans:  # overlapping spans are masked as one, under the first's name
                            if a >= at:
                                parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                            at = max(at, e)
                        text = "".join(parts) + text[at:]
                out.append(text)
            yield b.set_column(text_at, b.schema.field(text_at), pa.array(out, b.schema.field(text_at).type))

    return run


def mask(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """docs with every span in text_col replaced by its kind in brackets.

    Null stays null and empty texts empty; rows are independent; other columns of any name are kept. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    return docs.mapInArrow(lean(_mask(field, least, docs.columns.index(text_col))), docs.schema)


def joined(spans: str) -> Column:
    """kind:from:to by start, then by kind as listed, joined by commas."""
    order = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> struct(x.`from` as a, {order} as b, x.`to` as c, x.kind as d))), y -> concat(y.d, ':', y.a, ':', y.c)), ',')")


def digest(text: str) -> str:
    """The base digest of one text, for tests."""
    return sha256(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in base_spans(text)).encode()).hexdigest()
