"""Rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair draws u in (0, 1) from an MD5; the record goes to the shard of least -ln(u) / weight. A
new shard only ever wins records for itself, a removed one only gives its own away, and shares follow the
weights. All of it is row-local SQL: no record moves to be placed.

Slots number the records of a shard without gaps. Records of a shard are ordered by a fixed bucket of
their key, then by key and content; bucket sizes (shards x BUCKETS numbers at most, whatever the input) give
every bucket its first slot, and a window per (shard, bucket) counts on from there. So neither a shard nor
a hot key is numbered by one task, unless its rows are wholly equal; those stream through a window that
needs no buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
UNIT = float(2**52)


def cost(key: Column, shard: str, weight: float) -> Column:
    """-ln(u) / weight for u of 52 bits."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(UNIT)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float], names: Sequence[str] | None = None) -> Column:
    """Number of the shard that key belongs to. A null key is the key of no text, distinct from the empty one."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    key = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    names = names or [str(i) for i in range(len(weights))]
    costs = F.array(*[cost(key, n, w) for n, w in zip(names, weights)])
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def shard(df: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size is the UTF-8 length plus one; text_crc32 is unsigned; null texts count as empty. grown_shard is the shard
    under the weights `grown` (one more by default). Rows with one key share a shard; slots number equal rows
    too, in any order among themselves. An empty table gives no rows; other columns of any name are ignored.
    """
    grown = list(grown) if grown else [*weights, weights[-1]]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col(id_col), weights).alias("shard"), rendezvous(F.col(id_col), grown).alias("grown_shard"),
    )
    tag = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(tag, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    # at most len(weights) * BUCKETS rows
    rows = rows.join(F.broadcast(begin), ["shard", "bucket"])
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    slot = F.col("begin") + F.row_number().over(within) - 1
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", slot.cast("long").alias("slot"), "grown_shard")
