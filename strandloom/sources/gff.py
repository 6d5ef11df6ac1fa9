"""GFF3 annotations as a features table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec, ontology
from ..session import cut


def _attribute(name: str) -> Column:
    """The value of an attribute if it has exactly one, else 'NA'."""
    v = F.try_element_at(F.col("attrs"), F.lit(name))
    return F.when(v.isNull() | (v == "") | v.contains(","), "NA").otherwise(F.try_url_decode(F.regexp_replace(v, r"\+", "%2B")))


def parse(lines: DataFrame, dim: DataFrame | None = None, sanitize: bool = True, line: str = "value") -> DataFrame:
    """Features of GFF3 lines; other columns of `lines` pass through. Comments and short lines go.

    With an ontology, types that it doesn't have go; without one every type stays, and `term` is null where the
    built-in dimension has none.
    """
    known = ontology.terms(lines.sparkSession) if dim is None else dim
    rest = [c for c in lines.columns if c != line]
    x = lines.where(~F.col(line).startswith("#")).withColumn("f", F.split(line, "\t", -1)).where(F.size("f") >= 9)
    pairs = F.filter(F.split(F.col("f")[8], ";"), lambda p: F.contains(p, F.lit("=")))
    x = x.withColumn("attrs", F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))), lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)) == k), lambda p: F.regexp_replace(p, "^[^=]*=", "")), ",").alias("value")))))
    raw_id = _attribute("ID")
    x = x.select(
        *rest, F.col("f")[0].alias("scaffold"), F.col("f")[3].cast("long").alias("start_pos"), F.col("f")[4].cast("long").alias("end_pos"), codec.strand_code(F.col("f")[6]).alias("strand"), F.col("f")[2].alias("feature_type"),
        (codec.sanitize_id(raw_id) if sanitize else raw_id).alias("id"), F.when(F.col("f")[1].isin(".", ""), "NA").otherwise(F.col("f")[1]).alias("source"), _attribute("gene_biotype").alias("biotype"),
    )
    known = F.broadcast(known.select(F.col("label").alias("feature_type"), F.col("short_id").alias("term")))  # the ontology
    return x.join(known, "feature_type", "left" if dim is None else "inner")


def number(features: DataFrame, *order: str) -> DataFrame:
    """features with a dense 1-based feature_idx in the given order.

    Rows are counted by range of the order, so no single task numbers them all.
    """
    spark = features.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = features.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__n", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    ranged = cut(ranged)
    # one row a partition
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    return ranged.join(F.broadcast(offsets), "__p").withColumn("feature_idx", F.col("__o") + F.col("__n") + 1).drop("__p", "__n", "__o")


def read_gff(spark: SparkSession, paths: str | list[str], dim: DataFrame | None = None, sanitize: bool = True) -> DataFrame:
    """Features of GFF3 files, gzipped or not, numbered in file order over the kept records."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return number(parse(lines, dim, sanitize), "__file", "__block", "__line").drop("__file", "__block", "__line")
