"""BED and narrowPeak intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """1-based closed intervals; other columns pass through. Without a strand column the strand is NA."""
    rest = [c for c in lines.columns if c != line]
    x = lines.withColumn("f", F.split(line, "\t", -1)).where((F.size("f") >= 3) & ~F.col(line).rlike("^(#|track|browser)"))
    strand = F.when(F.size("f") < 6, codec.NA).otherwise(codec.strand_code(F.try_element_at("f", F.lit(6))))
    return x.select(*rest, F.col("f")[0].alias("scaffold"), (F.col("f")[1].cast("long") + 1).alias("start_pos"), F.col("f")[2].cast("long").alias("end_pos"), strand.alias("strand"))


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Intervals of BED files, gzipped or not, with the file's path."""
    return parse(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path")))
