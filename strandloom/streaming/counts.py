"""Call files as a stream: running site counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..sources import calls


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines of the call files that arrive in a folder, with their path."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def site_counts(lines: DataFrame) -> DataFrame:
    """Counts by site over all files so far; the strand comes from the file name. For update or complete output.

    The state is one row for each site seen; sites don't expire.
    """
    x = calls.parse_reads(lines).withColumn("strand", codec.infer_strand("path"))
    return x.groupBy(*calls.SITE).agg(F.sum(F.col("methylated").cast("long")).alias("meth"), F.sum((~F.col("methylated")).cast("long")).alias("unmeth"))
