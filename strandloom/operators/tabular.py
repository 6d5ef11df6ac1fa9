"""Quantile bins of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from ..sources.gff import number


def mean_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """(by…, q): type-7 quantiles of a column that holds no null, exact however many values there are.

    Equal values are counted first. Distinct ones are ranged over tasks; the counts of the ranges tell which of them
    hold a wanted rank, and only those are ranked value by value.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(parts, *keys, "__v").withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.sum("__c").alias("__s"))  # at most a row for each group and range
    whole = W.partitionBy(*keys)
    sizes = sizes.withColumns({"__e": F.sum("__s").over(whole.orderBy("__p")), "__n": F.sum("__s").over(whole)})
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("x")) for i, p in enumerate(probs)]))
    wanted = sizes.select("*", at.alias("__w")).select("*", F.explode(F.array_distinct(F.array(F.floor("__w.x"), F.ceil("__w.x")))).alias("__r"))
    wanted = wanted.where("__r >= __e - __s and __r < __e")
    ranks = ranged.join(wanted.select(*keys, "__p", (F.col("__e") - F.col("__s")).alias("__b")).distinct(), [*keys, "__p"])
    ranks = ranks.withColumn("__to", F.col("__b") + F.sum("__c").over(W.partitionBy(*keys, "__p").orderBy("__v")))
    hit = ranks.join(wanted.select(*keys, "__p", "__w", "__r"), [*keys, "__p"]).where("__r < __to and __r >= __to - __c")
    low, high = F.min("__v"), F.max("__v")
    one = hit.groupBy(*keys, F.col("__w.i").alias("__i")).agg((low + (high - low) * (F.max("__w.x") - F.min("__r"))).alias("__q"))
    out = one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda s: s["__q"]).alias("q"))
    return out.withColumnsRenamed(dict(zip(keys, by)))


def quantile_bins(t: DataFrame, values: list[str], q: int = 4, merge: Callable[[list[Column]], Column] = mean_of) -> DataFrame:
    """Matched rows with `merged` and `bin`: the first of q bins whose upper edge, a type-7 quantile, reaches it."""
    if q < 1:
        raise ValueError("quantiles must be 1 or more")
    x = t.where("feature_idx is not null").withColumn("merged", merge([F.col(v).cast("double") for v in values]))
    if q == 1:
        return x.withColumn("bin", F.lit(1))
    edges = quantiles(x.where("merged is not null"), [], "merged", [i / q for i in range(1, q)])
    x = x.withColumn("__edges", edges.select("q").scalar())
    return x.withColumn("bin", (F.size(F.filter("__edges", lambda e: F.col("merged") > e)) + 1).cast("int")).drop("__edges")


def quantile_rank(t: DataFrame, ranking: list[str], q: int, row_idx: str = "row_idx") -> DataFrame:
    """Rows with `bin` = ceil(rank * q / n), rank by the named columns and then row_idx.

    The rank comes from a range-partitioned count, so that no single task orders all rows.
    """
    if q < 1:
        raise ValueError("quantiles must be 1 or more")
    if not ranking or set(ranking) - set(t.columns):
        raise ValueError(f"unknown ranking: {ranking}")
    keys = [f"__r{i}" for i in range(len(ranking))]
    x = t.withColumns({k: F.when(F.col(r).isNull() | F.isnan(F.col(r).cast("double")), float("nan")).otherwise(F.col(r).cast("double")) for k, r in zip(keys, ranking)})
    x = number(x, *keys, row_idx) if "feature_idx" not in t.columns else number(x.withColumnRenamed("feature_idx", "__f"), *keys, row_idx)
    x = x.withColumnRenamed("feature_idx", "__rank")
    if "__f" in x.columns:
        x = x.withColumnRenamed("__f", "feature_idx")
    x = x.withColumn("__n", t.agg(F.count("*")).scalar())
    return x.withColumn("bin", F.expr(f"cast((__rank * {q} + __n - 1) div __n as int)")).drop("__rank", "__n", *keys)


def quantiles_by_rank(t: DataFrame, ranking: list[str], q: int = 4) -> DataFrame:
    """quantile_rank of a table's matched rows."""
    return quantile_rank(t.where("feature_idx is not null"), ranking, q)


def quantile_pairs(pairs: DataFrame, ranking: list[str], row_idx: str, q: int = 4) -> DataFrame:
    """Pairs with their `quantile`; row_idx gives the rows' order."""
    return quantile_rank(pairs, ranking, q, row_idx).withColumnRenamed("bin", "quantile")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
