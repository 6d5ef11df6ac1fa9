"""Temperature mixing of sources to target weights.

Source token shares q are raised to an exponent a and normalised. The exponent is bisected: entropy falls as
a rises, and so does the number of epochs that the most repeated source needs. The result is the greatest a
whose entropy reaches the target, raised as far as the repetition limit asks. A token budget then gives every
source its tokens, realised as whole epochs, each a permutation of the source's blocks, and a partial epoch:
blocks in permuted order until the budget is met, the last of them by document.

Totals are kept by (source, block), so a source that holds a third of all rows is summed, joined and numbered
in `BLOCKS` pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCKS = 1024
MOST_SOURCES = 100_000  # totals of so many sources are solved on the driver; those of more stay where they are
SECTIONS = 31  # exponents that one pass over such totals tries


def tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def weights(shares: np.ndarray, a: float) -> np.ndarray:
    w = np.exp(a * np.log(shares) - (a * np.log(shares)).max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w * np.log(w)).sum())


def _bisect(ok: Callable[[np.ndarray], np.ndarray], lo: float, hi: float, sections: int = 1) -> float:
    """The greatest x in [lo, hi] with ok(x), where ok holds up to some point; lo if none is. ok is asked of `sections` points at once."""
    if ok(np.array([hi]))[0]:
        return hi
    while hi - lo > 1e-15 * max(1.0, abs(hi)):
        xs = lo + (hi - lo) * np.arange(1, sections + 1) / (sections + 1)
        n = int(np.asarray(ok(xs)).sum())
        new = (xs[n - 1] if n else lo), (xs[n] if n < sections else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return float(lo)


def exponent(moments: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], sources: int, total: int, least: int, most: int, entropy_share: float | None, most_epochs: float | None, budget: int | None, sections: int = 1) -> float:
    """The exponent that the limits leave, from the extremes of the totals and moments(a): the log of the sum of share ** a, and the entropy of the weights."""

    def few(a: np.ndarray) -> np.ndarray:
        # the least source is repeated most as long as a is at most 1
        if budget is None:
            return (a - 1) * log(least / most) <= log(most_epochs) + 1e-12
        return (a - 1) * log(least / total) - moments(a)[0] + log(budget / total) <= log(most_epochs) + 1e-12

    a = 1.0
    if entropy_share is not None and sources > 1:
        a = _bisect(lambda x: moments(x)[1] >= entropy_share * log(sources), 0.0, 1.0, sections)
    if most_epochs is not None and not few(np.array([a]))[0]:
        a = 1 - _bisect(lambda x: few(1 - x), 0.0, 1 - a, sections) if few(np.array([1.0]))[0] else 1.0
    return a


@dataclass(frozen=True)
class Plan:
    exponent: float
    weight: np.ndarray
    tokens: np.ndarray  # of each source, in the mix
    full: np.ndarray  # whole epochs
    rest: np.ndarray  # tokens of the partial epoch


def solve(totals: np.ndarray, entropy_share: float | None, most_epochs: float | None, budget: int | None) -> Plan:
    """totals: positive token totals. entropy_share: of the greatest entropy, log n.

    Without a budget, the least one that takes every source once in full is used; most_epochs then bounds the
    epochs of the most repeated source under that budget. A limit that no exponent in [0, 1] meets leaves 1,
    the sources' own shares.
    """
    q = totals / totals.sum()
    logs = np.log(q)

    def moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = a[:, None] * logs
        top = z.max(1, keepdims=True)
        e = np.exp(z - top)
        norm = np.log(e.sum(1)) + top[:, 0]
        return norm, norm - (e / e.sum(1, keepdims=True) * z).sum(1)

    a = exponent(moments, len(q), int(totals.sum()), int(totals.min()), int(totals.max()), entropy_share, most_epochs, budget)
    w = weights(q, a)
    e = w / q
    e = e / e.min() if budget is None else e * budget / totals.sum()
    want = np.floor(e * totals * (1 + 1e-12)).astype(np.int64)
    full = want // totals
    return Plan(a, w, want, full, want - full * totals)


def solve_far(totals: DataFrame, entropy_share: float | None, most_epochs: float | None, budget: int | str | None) -> DataFrame:
    """The plan (key, weight, full, rest) of totals (key, n) of any number of sources: solve's exponent, by passes that return sums."""
    some = totals.where("n > 0")
    r = some.agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    none = totals.where("n = 0").select("key", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    if not r.c:
        return none
    budget = r.t if budget == "same" else budget
    share = F.log(F.col("n") / F.lit(float(r.t)))
    top, bottom = log(r.hi / r.t), log(r.lo / r.t)

    def moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # terms are scaled by the greatest one
        peak = [x * (top if x >= 0 else bottom) for x in a]
        cells = [[F.sum(F.exp(share * float(x) - p)).alias(f"z{i}"), F.sum(F.exp(share * float(x) - p) * share * float(x)).alias(f"h{i}")] for i, (x, p) in enumerate(zip(a, peak))]
        got = some.agg(*[c for pair in cells for c in pair]).first()
        z = np.array([got[f"z{i}"] for i in range(len(a))])
        norm = np.log(z) + np.array(peak)
        return norm, norm - np.array([got[f"h{i}"] for i in range(len(a))]) / z

    a = exponent(moments, r.c, r.t, r.lo, r.hi, entropy_share, most_epochs, budget, SECTIONS)
    norm = float(moments(np.array([a]))[0][0])
    weight = F.exp(share * a - norm)
    epochs = F.exp(share * (a - 1) - (a - 1) * top) if budget is None else F.exp(share * (a - 1) - norm) * F.lit(budget / r.t)
    x = some.select("key", weight.alias("weight"), "n", F.floor(epochs * F.col("n") * F.lit(1 + 1e-12)).alias("want"))
    return x.select("key", "weight", F.expr("want div n").alias("full"), F.expr("want % n").alias("rest")).union(none)


def mix(docs: DataFrame, entropy_share: float | None = 0.95, most_epochs: float | None = 4.0, budget: int | str | None = "same", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, columns: bool = False) -> DataFrame:
    """One row for every document and epoch that takes it: (doc_id, source, n_tokens, weight, epoch, block_key, doc_key).

    In the order (epoch, block_key, doc_key) the documents of a source form its block permutations. budget is a
    number of tokens, "same" for as many as the input has, or None for the least that takes all once. With
    `columns` the input's columns come out instead, once for each epoch.

    A null source is a source of its own. Documents without tokens cost nothing: they come once if their source
    has no tokens, else as their block does. Documents are ordered by a hash of id and text, so equal rows are
    interchangeable. An empty table gives no rows. Other columns of any name are ignored or passed through.
    """
    spark = docs.sparkSession
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if columns else []
    base = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), tokens(text).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("doc_key"), *keep)
    base = base.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "block": F.pmod(F.xxhash64("doc_key"), F.lit(BLOCKS)).cast("int")})
    blocks = cut(base.groupBy("key", "block").agg(F.sum("n_tokens").alias("n")))
    sums = blocks.groupBy("key").agg(F.sum("n").alias("n"))
    totals = sums.orderBy("key").limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        plan = cut(solve_far(cut(sums), entropy_share, most_epochs, budget))
    else:
        some = [r for r in totals if r.n > 0]
        rows = [(r.key, 0.0, 1, 0) for r in totals if r.n == 0]
        if some:
            n = np.array([r.n for r in some], np.int64)
            p = solve(n, entropy_share, most_epochs, int(n.sum()) if budget == "same" else budget)
            rows += [(r.key, float(w), int(f), int(x)) for r, w, f, x in zip(some, p.weight, p.full, p.rest)]
        plan = spark.createDataFrame(rows, "key string, weight double, full long, rest long")
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), F.lit("partial"), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    # BLOCKS rows for each source
    status = blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(plan, "key").select("key", "block", "weight", "full", "rest", "before")
    within = Window.partitionBy("key", "block").orderBy("doc_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(status, ["key", "block"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = out.withColumn("times", F.col("full") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)).where("times > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    if columns:
        return out.select("__row.*")
    # the partial epoch is the last; its permutation is the one that the budget was cut by
    block_key = F.when(F.col("epoch") < F.col("full"), F.xxhash64(F.lit(seed), F.col("epoch"), "block")).otherwise(F.xxhash64(F.lit(seed), F.lit("partial"), "block"))
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", block_key.alias("block_key"), "doc_key")
