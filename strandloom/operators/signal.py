"""Coverage, per-base projections, metagene profiles and density estimates.

Runs of equal depth are never exploded to bases: profiles place each run's part of a feature in slots by
closed forms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec
from ..session import cut, ship
from .intervals import overlap_join, point_join
from .tabular import quantiles

MIN_DEPTH = 5


def on_scaffolds(features: DataFrame, others: DataFrame) -> DataFrame:
    """Features of the scaffolds that others have. Names go along with the tasks: parted by scaffold, a few tasks would have all features."""
    return features.join(F.broadcast(others.select("scaffold").distinct()), "scaffold", "left_semi")


def coverage_bed(features: DataFrame, bed: DataFrame, feature_type: str, filter_zeros: bool = False, per_feature: bool = False) -> DataFrame:
    """(scaffold, feature_idx, value): covered share for each fragment of `feature_type` with an interval.

    All features of the intervals' scaffolds come out, those of other types or without a fragment with 0.0. With
    per_feature, the shares of a feature are summed.
    """
    frags = overlap_join(features.where(F.col("feature_type") == feature_type).select("feature_idx", "scaffold", "start_pos", "end_pos"), bed.select("scaffold", "start_pos", "end_pos"))
    frags = frags.select("feature_idx", (F.col("frag_end") - F.col("frag_start") + 1).alias("n"))
    if per_feature:
        frags = frags.groupBy("feature_idx").agg(F.sum("n").alias("n"))
    here = on_scaffolds(features, bed)
    x = here.join(frags, "feature_idx", "left").select("scaffold", "feature_idx", (F.coalesce("n", F.lit(0)) / (F.col("end_pos") - F.col("start_pos") + 1)).alias("value"))
    return x.where("value <> 0") if filter_zeros else x


def coverage_calls(features: DataFrame, calls: DataFrame, feature_type: str, filter_zeros: bool = False) -> DataFrame:
    """(scaffold, feature_idx, value): summed methylated fractions over the feature's length, sites without depth aside."""
    mine = features.where(F.col("feature_type") == feature_type).select("feature_idx", "scaffold", "start_pos", "end_pos")
    hits = point_join(mine, calls.where(codec.get_depth("payload") > 0).select("scaffold", "pos", codec.get_percent_code("payload").alias("code")))
    sums = hits.groupBy("feature_idx").agg(F.sum("code").alias("code"))  # whole numbers: no order of summation
    here = on_scaffolds(mine, calls)
    x = here.join(sums, "feature_idx", "left").select("scaffold", "feature_idx", (F.coalesce("code", F.lit(0)) / F.lit(255.0) / (F.col("end_pos") - F.col("start_pos") + 1)).alias("value"))
    return x.where("value <> 0") if filter_zeros else x


def region(features: DataFrame, flank: int, clip: bool) -> DataFrame:
    lo = F.col("start_pos") - flank
    return features.withColumns({"r_lo": F.greatest(lo, F.lit(1)) if clip else lo, "r_hi": F.col("end_pos") + flank})


def regions(features: DataFrame, feature_type: str, flank: int = 500) -> DataFrame:
    """Features of a type, padded by flank and clipped at base 1: (feature_idx, scaffold, strand, start_pos, end_pos, region_len)."""
    f = region(features.where(F.col("feature_type") == feature_type), flank, True).select("feature_idx", "scaffold", "strand", F.col("r_lo").alias("start_pos"), F.col("r_hi").alias("end_pos"))
    return f.withColumn("region_len", F.col("end_pos") - F.col("start_pos") + 1)


def runs_along(f: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of depth along `regions`, 5' to 3': (feature_idx, region_len, rel_start, rel_end, count). They come as the join has them, not moved by feature."""
    x = overlap_join(f, runs.where("count > 0"))
    rev = F.col("strand") == codec.REV
    a, b = F.col("frag_start") - F.col("start_pos") + 1, F.col("frag_end") - F.col("start_pos") + 1
    n = F.col("region_len")
    return x.select("feature_idx", "region_len", F.when(rev, n + 1 - b).otherwise(a).alias("rel_start"), F.when(rev, n + 1 - a).otherwise(b).alias("rel_end"), "count")


def project_runs(features: DataFrame, runs: DataFrame, feature_type: str, flank: int = 500) -> DataFrame:
    """`runs_along` the regions of a type; a feature without depth has one row with null run, for which all rows move by feature."""
    f = regions(features, feature_type, flank)
    return f.select("feature_idx", "region_len").join(runs_along(f, runs).drop("region_len"), "feature_idx", "left")


def explode_bases(projected: DataFrame) -> DataFrame:
    """Projected runs by base: (feature_idx, rel_base, count)."""
    return projected.where("count is not null").select("feature_idx", F.explode(F.sequence("rel_start", "rel_end")).alias("rel_base"), "count")


def levels_along(features: DataFrame, calls: DataFrame, feature_type: str, flank: int = 500, min_depth: int = MIN_DEPTH, context: int | None = codec.CPG, parts: int | None = None) -> DataFrame:
    """Levels along features, 5' to 3': (feature_idx, region_len, rel_base, level FLOAT, weight); calls of one base are pooled by depth.

    Regions aren't clipped. Bases are pooled before they meet features, so the pairs need not move. They meet in `parts` tasks, if given.
    """
    f = region(features.where(F.col("feature_type") == feature_type), flank, False).select("feature_idx", "scaffold", "strand", "r_lo", "r_hi")
    c = calls.select("scaffold", "pos", codec.get_depth("payload").alias("depth"), codec.get_percent_code("payload").alias("code"), codec.get_context("payload").alias("c")).where(F.col("depth") >= max(min_depth, 1))
    if context is not None:
        c = c.where(F.col("c") == context)
    c = c.groupBy("scaffold", "pos").agg(F.sum(F.col("code") * F.col("depth")).alias("s"), F.sum("depth").alias("weight"))
    c = c.select("scaffold", "pos", (F.col("s") / F.lit(255.0) / F.col("weight")).cast("float").alias("level"), "weight")
    x = point_join(f, c, "r_lo", "r_hi", parts)
    rel = F.when(F.col("strand") == codec.REV, F.col("r_hi") - F.col("pos") + 1).otherwise(F.col("pos") - F.col("r_lo") + 1)
    return x.select("feature_idx", (F.col("r_hi") - F.col("r_lo") + 1).alias("region_len"), rel.alias("rel_base"), "level", "weight")


def project_calls(features: DataFrame, calls: DataFrame, feature_type: str, flank: int = 500, min_depth: int = MIN_DEPTH, context: int | None = codec.CPG) -> DataFrame:
    """`levels_along` features; those of scaffolds without calls are left out, and a feature without calls has one row with null base, for which
    all rows move by feature."""
    x = levels_along(features, calls, feature_type, flank, min_depth, context).drop("region_len")
    f = region(on_scaffolds(features.where(F.col("feature_type") == feature_type), calls), flank, False)
    return f.select("feature_idx", (F.col("r_hi") - F.col("r_lo") + 1).alias("region_len")).join(x, "feature_idx", "left")


SLOT = "array<struct<slot:bigint,v:double>>"


def _slot(at: Column, v: Column) -> Column:
    return F.struct(at.cast("long").alias("slot"), v.cast("double").alias("v"))


def _if(cond: Column, slots: Column) -> Column:
    return F.when(cond, slots).otherwise(F.array().cast(SLOT))


def _zones(x: DataFrame, flank: int, bins: int) -> tuple[DataFrame, Column, Column, Column]:
    """Runs of features long enough, with the body's length L and their part of it, bases a to z from 0; whether they reach the flank before, the
    one after, and the body."""
    if bins < 2:
        raise ValueError("bins must be 2 or more")
    x = x.where((F.col("region_len") >= 2 * flank + 2) & F.col("count").isNotNull()).withColumn("L", F.col("region_len") - 2 * flank)
    up, down = F.col("rel_start") <= flank, F.col("rel_end") > F.col("region_len") - flank
    inside = (F.col("rel_end") > flank) & (F.col("rel_start") <= F.col("region_len") - flank)
    return x.withColumns({"a": F.greatest(F.col("rel_start") - flank - 1, F.lit(0)), "z": F.least(F.col("rel_end") - flank - 1, F.col("L") - 1)}), up, down, inside


def profile_runs(projected: DataFrame, n: int, flank: int, bins: int) -> DataFrame:
    """(feature_idx, slot, value): depth / n in flank + bins + flank slots of every feature of length 2 * flank + 2 or more.

    Flanks go base by base; the body is interpolated linearly at `bins` evenly spaced points (two or more). Slots
    without depth have no row.
    """
    x, up, down, inside = _zones(projected, flank, bins)
    # point k lies at x = k (L - 1) / (bins - 1); a run over [a, z] gives it count * clamp(min(x - a + 1, z + 1 - x))
    x = x.withColumns({"lo": F.expr(f"greatest(0, ceil((a - 1) * {bins - 1} / (L - 1)))").cast("long"), "hi": F.expr(f"least({bins - 1}, floor((z + 1) * {bins - 1} / (L - 1)))").cast("long")})
    at = lambda k: k * (F.col("L") - 1) / F.lit(float(bins - 1))
    share = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(k) - F.col("a") + 1, F.col("z") + 1 - at(k)))
    body = _if(inside & (F.col("lo") <= F.col("hi")), F.transform(F.sequence("lo", F.greatest("lo", "hi")), lambda k: _slot(k + flank + 1, F.col("count") * share(k))))
    first = F.greatest("rel_start", F.col("region_len") - flank + 1)
    before = _if(up, F.transform(F.sequence("rel_start", F.greatest("rel_start", F.least("rel_end", F.lit(flank).cast("long")))), lambda b: _slot(b, F.col("count"))))
    after = _if(down, F.transform(F.sequence(first, F.greatest(first, F.col("rel_end"))), lambda b: _slot(b - F.col("L") + bins, F.col("count"))))
    slots = x.select("feature_idx", F.inline(F.concat(before, body, after)))
    return slots.groupBy("feature_idx", "slot").agg((F.sum("v") / n).alias("value")).where("value <> 0")


def weigh(depth: Column, transform: Callable[[Column], Column] | None, by_depth: bool = True) -> Column:
    """The weight of a base: its depth, transformed; one without by_depth. Negative or non-finite weights are an error."""
    if not by_depth:
        return F.lit(1.0)
    w = depth.cast("double")
    if transform is None:
        return w
    w = transform(w)
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    return F.when(bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(w)


def _weighted(projected: DataFrame, flank: int, bins: int, by_depth: bool, transform: Callable[[Column], Column] | None) -> DataFrame:
    """(feature_idx, slot, level, w): the bases of features long enough that have weight."""
    x = projected.where((F.col("region_len") >= 2 * flank + 2) & F.col("rel_base").isNotNull()).withColumn("L", F.col("region_len") - 2 * flank)
    b = F.col("rel_base")
    slot = F.when(b <= flank, b).when(b > F.col("region_len") - flank, b - F.col("L") + bins).otherwise(flank + F.expr(f"((rel_base - {flank}) * {bins} + L - 1) div L"))
    return x.select("feature_idx", slot.alias("slot"), F.col("level").cast("double").alias("level"), weigh(F.col("weight"), transform, by_depth).alias("w")).where("w > 0")


def profile_calls(projected: DataFrame, flank: int, bins: int, by_depth: bool = True, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """(feature_idx, slot, level, weight): weighted mean levels in slots that hold weight."""
    x = _weighted(projected, flank, bins, by_depth, transform)
    return x.groupBy("feature_idx", "slot").agg((F.sum(F.col("level") * F.col("w")) / F.sum("w")).alias("level"), F.sum("w").alias("weight"))


def _slots(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(1, n + 1).select(F.col("id").alias("slot"))


def mean_profile_runs(projected: DataFrame, n: int, flank: int, bins: int, exclude: DataFrame | None = None) -> DataFrame:
    """(slot, value): mean profile of all features of sufficient length, zeros included; exclude: a table of feature_idx."""
    x = projected if exclude is None else projected.join(exclude, "feature_idx", "left_anti")
    return _mean_of_runs(x, x.select("feature_idx", "region_len").distinct(), n, flank, bins)


def metagene_runs(features: DataFrame, runs: DataFrame, feature_type: str, n: int, flank: int, bins: int, exclude: DataFrame | None = None) -> DataFrame:
    """mean_profile_runs of the features of a type: runs are summed by slot where they meet features, and only the sums move.

    Runs may overlap, as depth is their sum: stacked intervals, each with count 1, need no sweep. A bin has many features and many runs, which a
    merge join pairs faster than a broadcast one.
    """
    f = regions(features if exclude is None else features.join(exclude, "feature_idx", "left_anti"), feature_type, flank)
    return _mean_of_runs(runs_along(f.hint("merge"), runs), f.select("feature_idx", "region_len"), n, flank, bins)


STEP = "array<struct<slot:bigint,jump:bigint,slope:bigint>>"


def _mean_of_runs(x: DataFrame, features: DataFrame, n: int, flank: int, bins: int) -> DataFrame:
    """A run gives slots a function that is linear but for a few breaks, where it jumps and its slope changes. The breaks are summed by slot and
    added up along the slots, so neither bases nor points are listed and pairs are met once. All is counted in whole (bins - 1)ths.
    """
    genes = features.where(F.col("region_len") >= 2 * flank + 2).agg(F.count("*").alias("genes")).scalar()
    x, up, down, inside = _zones(x, flank, bins)
    m, run = F.lit(bins - 1), F.col("L") - 1
    # body point k lies at base k run / m: in whole runs it has c; within a base before a or after z, c (1 - distance)
    x = x.withColumns({"c": F.col("count").cast("long"), "p0": F.expr(f"if(a = 0, 0, (a - 1) * {bins - 1} div (L - 1) + 1)"), "p1": F.expr(f"(a * {bins - 1} + L - 2) div (L - 1)")})
    x = x.withColumns({"p2": F.expr(f"z * {bins - 1} div (L - 1) + 1"), "p3": F.expr(f"least({bins}, ((z + 1) * {bins - 1} - 1) div (L - 1) + 1)")})
    c, p0, p1, p2, p3 = (F.col(k) for k in ("c", "p0", "p1", "p2", "p3"))
    rise = lambda p: p * run - (F.col("a") - 1) * m
    fall = lambda p: (F.col("z") + 1) * m - p * run
    at = lambda slot, jump, slope=F.lit(0): F.struct(slot.cast("long").alias("slot"), jump.cast("long").alias("jump"), slope.cast("long").alias("slope"))
    body = F.array(at(p0 + flank + 1, c * rise(p0), c * run), at(p1 + flank + 1, c * (m - rise(p1)), -c * run), at(p2 + flank + 1, c * (fall(p2) - m), -c * run), at(p3 + flank + 1, -c * fall(p3), c * run))
    end, first = F.least("rel_end", F.lit(flank)), F.greatest("rel_start", F.col("region_len") - flank + 1)
    shift = F.lit(bins) - F.col("L")
    before, after = F.array(at(F.col("rel_start"), c * m), at(end + 1, -c * m)), F.array(at(first + shift, c * m), at(F.col("rel_end") + 1 + shift, -c * m))
    some = lambda cond, steps: F.when(cond, steps).otherwise(F.array().cast(STEP))
    # at most one row a slot
    steps = x.select(F.inline(F.concat(some(up, before), some(inside, body), some(down, after)))).groupBy("slot").agg(F.sum("jump").alias("jump"), F.sum("slope").alias("slope"))
    w = W.orderBy("slot")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    full = _slots(x, 2 * flank + bins).join(steps, "slot", "left").fillna(0, ["jump", "slope"]).withColumn("slope", F.sum("slope").over(upto))
    full = full.withColumns({"s": F.sum("jump").over(upto) + F.coalesce(F.sum("slope").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "genes": genes})
    return full.select("slot", F.when(F.col("genes") > 0, F.col("s") / m / n / F.greatest("genes", F.lit(1))).otherwise(0.0).alias("value"))


def mean_profile_calls(projected: DataFrame, flank: int, bins: int, by_depth: bool = True, transform: Callable[[Column], Column] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(slot, value): weighted mean over the features measured at each slot, NaN where none is."""
    x = projected if exclude is None else projected.join(exclude, "feature_idx", "left_anti")
    # the mean over features of their means, all weighted, is that over bases
    sums = _weighted(x, flank, bins, by_depth, transform).groupBy("slot").agg((F.sum(F.col("level") * F.col("w")) / F.sum("w")).alias("v"))
    return _slots(x, 2 * flank + bins).join(sums, "slot", "left").select("slot", F.coalesce("v", F.lit(float("nan"))).alias("value"))


def _smooth(points: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        head, mass = pdf.iloc[0], np.zeros(points)
        np.add.at(mass, pdf["k"].to_numpy(), pdf["c"].to_numpy())
        step = (head["hi"] - head["lo"] + 8 * head["h"]) / (points - 1)
        z = np.arange(1 - points, points) * (step / head["h"])
        kernel = np.exp(-0.5 * z * z)
        k = np.arange(points)
        out = pd.DataFrame({"k": k.astype("int32"), "x": head["lo"] - 4 * head["h"] + k * step, "density": np.convolve(mass, kernel)[points - 1 : 2 * points - 1] / (head["n"] * head["h"] * math.sqrt(2 * math.pi))})
        for i, c in enumerate(pdf.columns[6:]):
            out.insert(i, c, head[c])
        return out

    return f


def kde(values: DataFrame, points: int = 2048, by: tuple[str, ...] = ("scaffold",), value: str = "value") -> DataFrame:
    """(by, k, x, density): Gaussian kernel estimate on `points` grid points over [min - 4h, max + 4h].

    h = 0.9 min(sd, IQR / 1.34) n^-0.2. Each value is shared linearly by its two grid points, and the grid is smoothed, so
    one task holds `points` numbers of a group whatever its size. A group whose spread is zero, or of one value, has no
    estimate. `by` names one column at least.
    """
    ship(values.sparkSession)
    v = cut(values.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(*by, F.col(value).cast("double").alias("__v")))  # asked three times
    stats = v.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("__v").alias("sd"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    stats = stats.join(F.broadcast(quantiles(v, list(by), "__v", [0.25, 0.75])), list(by))
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    stats = stats.select(*by, "n", "lo", "hi", (F.lit(0.9) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h")).where("h > 0")
    stats = F.broadcast(stats)  # a row for each group: parted by group, a few tasks would have all values
    x = v.join(stats, list(by)).withColumn("__x", F.expr(f"(__v - lo + 4 * h) / ((hi - lo + 8 * h) / {points - 1})")).withColumn("__k", F.floor("__x"))
    part = F.col("__x") - F.col("__k")
    shares = F.inline(F.array(F.struct(F.col("__k").alias("k"), (1 - part).alias("c")), F.struct((F.col("__k") + 1).alias("k"), part.alias("c"))))
    grid = x.select(*by, shares).groupBy(*by, "k").agg(F.sum("c").alias("c")).where(F.col("k").between(0, points - 1))
    grid = grid.join(stats, list(by)).select("k", "c", "n", "lo", "hi", "h", *by)
    kinds = dict(values.dtypes)
    return grid.groupBy(*by).applyInPandas(_smooth(points), ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", k int, x double, density double")
