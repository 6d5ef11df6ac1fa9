"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from labelled rows: words, and stems that mark every longer word they begin, whose
frequency among toxic rows exceeds that among clean ones. The trie of the lexicon is intersected
with the Levenshtein automaton of distance 1 (for words of LEAST_FUZZY letters or more) and made
deterministic; the result is one transition table. All tokens of a batch run through it at once, one letter a
step, and leave when they reach the dead state. Digits that stand for letters are read as those letters.

Every hit is looked at in its context window: hits between quotation marks or after words of reporting
count apart from plain ones. Counts, rates and weights go to a logistic score.

What is fitted uses at most `most_rows` labelled rows, chosen by a hash of the doc_id; scoring takes
every row's whole text and nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._text import lean

LEAST_FUZZY = 5
STEM = range(3, 9)
MOST = 4  # occurrences in one document that count as evidence
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
QUOTES = "\"“”„«»‹›‘’"
REPORTS = frozenset("said says quote quoted quotes called wrote writes word term zitat sagte schrieb dit écrit dijo escribió".split())
WINDOW = 6  # tokens to either side
CHUNK = 1 << 20
FEATURES = 9
_letters = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return [t for t in _letters.findall(text.lower().translate({ord(k): v for k, v in LEET.items()}))]


@lru_cache(None)
def spellings() -> dict[str, list[int]]:
    """The code points that each letter is written with, in either case or as a digit that stands for it."""
    out: dict[str, list[int]] = {}
    for cp in range(0x110000):
        c = chr(cp)
        c = LEET.get(c, c.lower() if len(c.lower()) == 1 else c)
        if c.isalnum():
            out.setdefault(c, []).append(cp)
    return out


@lru_cache(None)
def letters() -> np.ndarray:
    """1 for every code point that is a letter or digit, or stands for one."""
    out = np.zeros(0x110000, np.uint8)
    out[[cp for many in spellings().values() for cp in many]] = 1
    return out


class Automaton:
    """The determinised intersection. Accepting: (term number, edits); stems accept once a longer word is sure."""

    def __init__(self, terms: list[tuple[str, bool, float]], stop: frozenset[str] = frozenset()):
        self.terms = terms
        self.weight = np.array([w for _, _, w in terms] or [0.0])
        kids: list[dict[str, int]] = [{}]
        word, stem, far = {}, {}, {}

        def add(text: str, root: int) -> int:
            n = root
            for c in text:
                if c not in kids[n]:
                    kids[n][c] = len(kids)
                    kids.append({})
                n = kids[n][c]
            return n

        kids.append({})  # node 1 is the root of the words that may be misspelled
        for i, (t, is_stem, _) in enumerate(terms):
            (stem if is_stem else word)[add(t, 0)] = i
            if not is_stem and len(t) >= LEAST_FUZZY:
                far[add(t, 1)] = i
        clean = {add(t, 0) for t in stop}
        alphabet = sorted({c for t, _, _ in terms for c in t} | {c for t in stop for c in t})
        place = {c: i + 2 for i, c in enumerate(alphabet)}
        self.code = letters().astype(np.uint8 if len(alphabet) < 254 else np.uint16 if len(alphabet) < 65534 else np.uint32)  # 0: no letter, 1: a letter of no term
        for c, k in place.items():
            for cp in spellings().get(c, ()):
                self.code[cp] = k
        size = len(alphabet) + 2

        def close(s: set[tuple[int, int]]) -> frozenset:
            more = list(s)
            while more:
                n, e = more.pop()
                if e == 0 and n in fuzzy:
                    for k in kids[n].values():
                        if (k, 1) not in s:
                            s.add((k, 1))
                            more.append((k, 1))
            return frozenset(s)

        fuzzy, more = {1}, [1]
        while more:
            for k in kids[more.pop()].values():
                fuzzy.add(k)
                more.append(k)
        names: dict[object, int] = {frozenset(): 0}  # state 0 is dead
        for i in stem.values():
            names[("stem", i)] = len(names)  # absorbing
        start = close({(0, 0), (1, 0)})
        names[start] = self.start = len(names)
        table, accept, todo = {}, {}, [start]

        def step(s: frozenset, letter: str | None) -> int:
            to: set[tuple[int, int]] = set()
            for n, e in s:
                if letter in kids[n]:
                    to.add((kids[n][letter], e))
                if e == 0 and n in fuzzy:
                    to.add((n, 1))
                    to |= {(k, 1) for k in kids[n].values()}
            t = close({x for x in to if not (x[1] == 1 and (x[0], 0) in to)})
            if t not in names:
                names[t] = len(names)
                todo.append(t)
            return names[t]

        for i in stem.values():
            table[names[("stem", i)]] = np.full(size, names[("stem", i)], np.int64)
            table[names[("stem", i)]][0] = 0
            accept[names[("stem", i)]] = (i, 0)
        while todo:
            s = todo.pop()
            over = next((stem[n] for n, e in s if e == 0 and n in stem), None)
            if over is not None:
                row = np.full(size, names[("stem", over)], np.int64)
                row[0] = 0
            else:  # letters that no node of the state has lead where an unknown one does
                row = np.full(size, step(s, None), np.int64)
                row[0] = 0
                for letter in {c for n, _ in s for c in kids[n]}:
                    row[place[letter]] = step(s, letter)
            table[names[s]] = row.astype(np.uint32)
            at = {n: e for n, e in sorted(s, key=lambda x: -x[1])}
            if not any(n in clean and e == 0 for n, e in s):
                best = [(0, word[n]) for n in at if n in word and at[n] == 0] or [(at[n], far[n]) for n in at if n in far]
                if best:
                    e, i = min(best)
                    accept[names[s]] = (i, e)
        table[0] = np.zeros(size, np.int64)
        kind = np.uint16 if len(names) < 65536 else np.uint32
        self.table = np.array([table[i].astype(kind) for i in range(len(names))])
        self.term = np.full(len(names), -1, np.int32)
        self.edits = np.zeros(len(names), np.int8)
        for s, (i, e) in accept.items():
            self.term[s], self.edits[s] = i, e

    def run(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token starts, token ends and final states over letter codes."""
        letter = code > 0
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        final = np.zeros(len(starts), self.table.dtype)
        live = np.arange(len(starts))
        at, state = starts.copy(), np.full(len(starts), self.start, self.table.dtype)
        stems = len([1 for t in self.terms if t[1]])
        while len(live):
            state = self.table[state, code[at]]
            at += 1
            over = (at == ends[live]) | (state <= stems)
            final[live[over]] = state[over]
            keep = ~over
            live, at, state = live[keep], at[keep], state[keep]
        return starts, ends, final


def features(texts: list[str], auto: Automaton, seen: Counter | None = None) -> np.ndarray:
    """One row of FEATURES numbers for each text, and its own hits in context."""
    out = np.zeros((len(texts), FEATURES))
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) < CHUNK):
            n += len(texts[j]) + 1
            j += 1
        joined = "\n".join(texts[i:j])
        code = auto.code[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts, ends, final = auto.run(code)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        first = np.searchsorted(starts, begin)
        words = np.diff(first)
        hit = np.flatnonzero(auto.term[final] >= 0)
        out[i:j, 8] = np.log1p(words)
        doc = np.searchsorted(begin, starts[hit], "right") - 1
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for d in np.unique(doc):
            mine = hit[cut[d] : cut[d + 1]]
            term, edits = auto.term[final[mine]], auto.edits[final[mine]]
            quoted = np.zeros(len(mine), bool)
            for k, h in enumerate(mine):  # the context window
                lo, hi = max(h - WINDOW, first[d]), min(h + WINDOW, first[d + 1] - 1)
                before, after = joined[starts[lo] : starts[h]], joined[ends[h] : ends[hi]]
                quoted[k] = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES) or any(w in REPORTS for w in before.lower().split())
            plain = ~quoted
            kinds = len({joined[starts[h] : ends[h]].lower() for h in mine[plain]})
            if seen is not None:
                for h in mine[(edits > 0) & plain]:
                    seen[joined[starts[h] : ends[h]].lower().translate({ord(a): b for a, b in LEET.items()})] += 1
            exact, fuzzy = (plain & (edits == 0)).sum(), (plain & (edits > 0)).sum()
            value = auto.weight[term[plain]] * np.where(edits[plain] > 0, 0.7, 1.0)
            out[i + d, :8] = (np.log1p(exact), exact > 0, np.log1p(fuzzy), np.log1p(quoted.sum()), np.log1p(100 * (exact + fuzzy) / words[d]), np.log1p(kinds), np.log1p(value.sum()), value.max() if len(value) else 0)
        i = j
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: mean, scale, weights (bias last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


class Model:
    def __init__(self, auto: Automaton, mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
        self.auto, self.mean, self.scale, self.w = auto, mean, scale, w

    def score(self, texts: list[str]) -> np.ndarray:
        z = (features(texts, self.auto) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word (w...) and each proper stem (s...) by label, MOST in a document at most."""
    for b in batches:
        bad, good = Counter(), Counter()
        for text, y in zip(b.column(0), b.column(1)):
            own: Counter = Counter()
            for t, n in Counter(tokens(text.as_py() or "")).items():
                if len(t) >= 3:
                    own["w" + t] += n
                for k in STEM:
                    if k >= len(t):
                        break
                    own["s" + t[:k]] += n
            to = bad if y.as_py() else good
            for k, n in own.items():
                to[k] += min(n, MOST)
        keys = [*(bad | good)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())], names=["entry", "bad", "good"])


def lexicon(rows: list[tuple[str, int, int]], n_bad: int, n_good: int, ratio: float = 6.0) -> list[tuple[str, bool, float]]:
    """Terms by decreasing evidence (occurrences times log odds).

    Of stems none that another one covers or spans; a word that a stem covers stays if it is long enough to be
    misspelled, as stems are matched to the letter.
    """
    scored = []
    for entry, bad, good in rows:
        odds = ((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1))
        if odds >= ratio and bad * log(odds) >= max(20, n_bad / 15):
            scored.append((-bad * log(odds), entry[0] == "s", entry[1:], log(odds)))
    out: list[tuple[str, bool, float]] = []
    words, stems = set(), set()
    for _, is_stem, t, w in sorted(scored):
        if (is_stem or len(t) < LEAST_FUZZY) and any(t[:k] in stems and (k < len(t) or is_stem) for k in range(1, len(t) + 1)):
            continue
        if is_stem and any(x.startswith(t) for x in words | stems):
            continue
        (stems if is_stem else words).add(t)
        out.append((t, is_stem, w))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", use: Callable[[Column], Column] | None = None, most_rows: int = 8000) -> Model:
    """Fit on labelled rows, `most_rows` at most.

    Labels other than 0 and 1, and rows without a document, don't count; an id with several labels takes the
    greatest. With no row of one of the classes the score is constant.
    """
    spark = docs.sparkSession
    ship(spark)
    picked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if use is not None:
        picked = picked.where(use(F.col(id_col)))
    picked = picked.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = picked.orderBy(F.crc32(F.concat(F.lit("pick"), F.col("doc_id").cast("string"))), "doc_id").limit(most_rows)
    chosen = picked.collect()
    ids = spark.createDataFrame(chosen, picked.schema)
    # most_rows ids at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    n_bad = sum(r.y for r in chosen)
    n_good = len(chosen) - n_bad
    if not n_bad or not n_good:
        flat = 0.0 if not n_bad else 1.0
        return Model(Automaton([]), np.zeros(FEATURES), np.ones(FEATURES), np.array([0.0] * FEATURES + [3.0 if flat else -3.0]))
    counts = rows.select("text", "y").mapInArrow(lean(_entries), "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    least = max(6, n_bad // 100)
    found = counts.where((F.col("bad") >= least) & (F.col("bad") * n_good >= 6 * F.col("good") * n_bad)).orderBy(F.desc("bad"), "entry")
    # entries of most_rows texts at most
    terms = lexicon([tuple(r) for r in found.collect()], n_bad, n_good)
    first = Automaton(terms)

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for y in (0, 1):
                features([t.as_py() or "" for t, k in zip(b.column(0), b.column(1)) if k.as_py() == y], first, seen[y])
            keys = [*(seen[0] | seen[1])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names=["word", "good", "bad"])

    # near misses that clean rows use more are words of their own
    near = rows.select("text", "y").mapInArrow(lean(misses), "word string, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    stop = frozenset(r.word for r in near.where(F.col("good") * n_bad > F.col("bad") * n_good).collect())
    auto = Automaton(terms, stop) if stop else first

    # the texts of hits reach the driver as numbers only
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t.as_py() or "" for t in b.column(0)], auto)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], names=["x", "y"])

    measured = rows.select("text", "y").mapInArrow(lean(measure), "x binary, y int").collect()
    x = np.array([np.frombuffer(r.x) for r in measured])
    return Model(auto, *fit(x, np.array([r.y for r in measured], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row.

    Null and empty texts score as texts without words; equal texts score equally, so ties and repeated rows don't
    matter. Ids may be null. An empty table gives no rows; other columns of any name are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the lexicon's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score([t.as_py() or "" for t in b.column(1)]) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns of whatever names, whose text scores under 0.5.

    Null and empty texts score as texts without words; of repeated rows all stay or none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield b.filter(pa.array(shared.value.score([t.as_py() or "" for t in b.column(at)]) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
