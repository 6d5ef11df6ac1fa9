"""Quality rules: learned decision lists.

Statistics of whole texts are counted in one vectorised pass. From labelled rows' statistics, sequential
covering grows conjunctions of threshold tests by information gain on one part of the rows, prunes each on the
other part, keeps a rule if its precision there is high, and takes away the rows it covers. The rules, in the
order found, become one Spark CASE expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T

SPAN = 8
SYMBOLS, UPPER, DIGIT, MARKS, LEAD = 1, 2, 4, 8, 16
KIND = np.zeros(256, np.uint8)
KIND[list(b"#*$%&|<>")] |= SYMBOLS
KIND[65:91] |= UPPER
KIND[48:58] |= DIGIT
KIND[list(b"!?")] |= MARKS
for _b in range(256):
    if _b & 0xC0 != 0x80 and not T.WS[_b]:
        KIND[_b] |= LEAD
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct_words", "n_top_word")
#: what rules test: name, numerator, denominator
RATIOS = (
    ("words", "n_words", None), ("word_length", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"), ("marks", "n_marks", "n_words"), ("line_words", "n_words", "n_lines"), ("distinct", "n_distinct_words", "n_words"), ("top_word", "n_top_word", "n_words"),
)


def ratio(num: np.ndarray, den: np.ndarray | None) -> np.ndarray:
    return num.astype(float) if den is None else np.where(den > 0, num / np.maximum(den, 1), 0.0)


def ratio_column(num: str, den: str | None) -> Column:
    c = F.col(num).cast("double")
    return c if den is None else F.when(F.col(den) > 0, c / F.col(den)).otherwise(0.0)


def measure(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    n = len(off) - 1
    out = np.zeros((n, len(STATS)), np.int64)
    h, first = T.words(data, off)
    out[:, 0] = np.diff(first)
    kind = KIND[data]
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for col, bit in ((1, LEAD), (2, SYMBOLS), (5, UPPER), (6, DIGIT), (7, MARKS)):
            out[some, col] = np.add.reduceat(((kind & bit) != 0).astype(np.int64), off[some])
    for i in some:
        lines, seen = data[off[i] : off[i + 1]].tobytes().split(b"\n"), set()
        for line in lines:
            if line.strip():
                out[i, 8] += 1
                if line in seen:
                    out[i, 3] += 1
                else:
                    seen.add(line)
    if len(h):
        bits = np.uint64(max(n - 1, 0).bit_length())

        def keyed(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
            return (x >> bits) | (doc.astype(np.uint64) << (np.uint64(64) - bits)) if bits else x

        doc = T.owner(first)
        w = np.sort(keyed(h, doc))
        new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        count = np.diff(np.concatenate([new, [len(w)]]))
        whose = np.searchsorted(np.cumsum(out[:, 0]), new, "right")
        out[:, 9] = np.bincount(whose, minlength=n)
        np.maximum.at(out[:, 10], whose, count)
        at = T.whole(first, SPAN)
        if len(at):
            key = keyed(T.mix(T.roll(h, SPAN)[at]), doc[at])
            order = np.argsort(key)
            s = key[order]
            twice = np.zeros(len(s), bool)
            twice[1:] = s[1:] == s[:-1]
            twice[:-1] |= s[1:] == s[:-1]
            hit = at[order[twice]]
            if len(hit):
                cover = np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + SPAN, minlength=len(h) + 1)
                cover = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(h)] > 0)])
                out[:, 4] = cover[first[1:]] - cover[first[:-1]]
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = T.column(b, "text")
        for i, j in T.slices(off):
            x = measure(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c) for c in np.ascontiguousarray(x.T))], names=["doc_id", *STATS])


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATS) for every row; null is an empty text, whose statistics are all zero."""
    ship(df.sparkSession)
    kind = dict(df.select(id_col).dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(T.lean(_stats), f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATS))


@dataclass(frozen=True)
class Rule:
    tests: tuple[tuple[int, bool, float], ...]  # feature, whether above, threshold

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, above, t in self.tests:
            hit &= x[:, f] > t if above else x[:, f] <= t
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            c = ratio_column(*RATIOS[f][1:])
            out = out & (c > t if above else c <= t)
        return out

    def tightest(self) -> Rule:
        """The same rule with one test for each feature and direction."""
        kept: dict[tuple[int, bool], float] = {}
        for f, above, t in self.tests:
            kept[f, above] = t if (f, above) not in kept else (max if above else min)(kept[f, above], t)
        return Rule(tuple((f, above, t) for (f, above), t in kept.items()))

    def __str__(self) -> str:
        return " and ".join(f"{RATIOS[f][0]} {'>' if above else '<='} {t:.4g}" for f, above, t in self.tests)


def _grow(x: np.ndarray, y: np.ndarray, most_tests: int, cuts: int) -> list[tuple[int, bool, float]]:
    tests, on = [], np.ones(len(x), bool)
    while len(tests) < most_tests:
        p0, n0 = y[on].sum(), (~y[on]).sum()
        if not n0 or not p0:
            break
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            v = x[on, f]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1])):
                for above in (True, False):
                    hit = v > t if above else v <= t
                    p, n = (hit & y[on]).sum(), (hit & ~y[on]).sum()
                    if p:
                        gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, above, float(t)), hit)
        if best[1] is None:
            break
        at = np.flatnonzero(on)
        f, above, t = best[1]
        v = x[at, f]  # the middle of the gap, which the rows at hand can't tell from t
        tests.append((f, above, float((v[v <= t].max() + v[v > t].min()) / 2) if (v <= t).any() and (v > t).any() else t))
        on = np.zeros(len(x), bool)
        on[at[best[2]]] = True
    return tests


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, least: int = 3, cuts: int = 40, seed: int = 5) -> list[Rule]:
    """Ordered rules that mark bad rows. x: ratios in RATIOS order."""
    rules: list[Rule] = []
    rng = np.random.Generator(np.random.PCG64(seed))
    part = rng.random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(rules) < most_rules:
        g, p = left & part, left & ~part
        if bad[g].sum() < least:
            break
        tests = _grow(x[g], bad[g], most_tests, cuts)
        if not tests:
            break

        def worth(r: Rule) -> float:
            hit = r.covers(x[p])
            a, b = (hit & bad[p]).sum(), (hit & ~bad[p]).sum()
            return (a - b) / (a + b) if a + b else -1.0

        options = [Rule(tuple(tests[:k])) for k in range(len(tests), 0, -1)]
        rule = max(options, key=worth)
        hit = rule.covers(x) & left
        good, found = (hit & ~bad).sum(), (hit & bad).sum()
        if found < least or found < precision * (found + good):
            break
        rules.append(rule.tightest())
        left &= ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> list[Rule]:
    """Rules from at most `most_rows` labelled rows, chosen by a hash of the id. No usable labels give no rules."""
    spark = docs.sparkSession
    picked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    picked = picked.orderBy(F.crc32(F.concat(F.lit("pick"), F.col("doc_id").cast("string"))), "doc_id").limit(most_rows)
    ids = spark.createDataFrame(picked.collect(), picked.schema)  # most_rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids.select("doc_id")), "doc_id")
    got = statistics(rows).join(F.broadcast(ids), "doc_id").select("y", *STATS).orderBy("y", *STATS).limit(2 * most_rows).toPandas()
    if not len(got):
        return []
    x = np.column_stack([ratio(got[n].to_numpy(), got[d].to_numpy() if d else None) for _, n, d in RATIOS])
    return learn(x, got["y"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """False for rows that some rule marks, in the order of the list."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def which(rules: list[Rule]) -> Column:
    """The rule that decided, or 'none'."""
    out = None
    for r in rules:
        out = F.when(r.column(), str(r)) if out is None else out.when(r.column(), str(r))
    return F.lit("none") if out is None else out.otherwise("none")


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATS, base_failed, kept, rule) for every row. Null, empty and blank texts fail the base; repeated rows fare alike."""
    s = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules), "rule": which(rules)})
