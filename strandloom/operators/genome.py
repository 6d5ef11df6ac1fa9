"""Feature lookups over (feature_idx, scaffold, start_pos, end_pos, strand, feature_type, id, source, biotype)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, ontology
from ..sources import gff

@dataclass(frozen=True)
class Species:
    """A name with its genome, a features table."""

    name: str
    taxon_id: str = ""
    features: DataFrame | None = None

    def with_annotation(self, spark: SparkSession, paths: str | list[str], dim: DataFrame | None = None, sanitize: bool = True) -> Species:
        """The species with the features of GFF3 files after those it has, numbered on."""
        more = gff.read_gff(spark, paths, dim, sanitize)
        if self.features is not None:
            more = more.withColumn("feature_idx", F.col("feature_idx") + self.features.agg(F.coalesce(F.max("feature_idx"), F.lit(0))).scalar())
            more = self.features.unionByName(more)
        return Species(self.name, self.taxon_id, more)


ORDER = ("scaffold", "start_pos", "end_pos", "feature_idx")


def of_type(features: DataFrame, feature_type: str, scaffold: str | None = None) -> DataFrame:
    x = features.where(F.col("feature_type") == feature_type)
    return x if scaffold is None else x.where(F.col("scaffold") == scaffold)


def types_used(features: DataFrame) -> DataFrame:
    return features.select("feature_type").distinct().orderBy("feature_type")


def by_id(features: DataFrame, feature_id: str) -> DataFrame:
    """The first feature of that id."""
    return features.where(F.col("id") == feature_id).orderBy(*ORDER).limit(1)


def by_ids(features: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """All features whose id is among ids, a list or a table with an id column."""
    if isinstance(ids, list):
        return features.where(F.col("id").isin(ids))
    return features.join(ids.select("id"), "id", "left_semi").select(features.columns)


def by_index(features: DataFrame, index: int) -> DataFrame:
    return features.where(F.col("feature_idx") == index)


def with_code(features: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """features with the packed code of index, strand and term, 0 for a type that the ontology doesn't have."""
    x = features.withColumn("__term", ontology.short_id("feature_type")) if dim is None else ontology.find(features, dim, "feature_type", "label", "short_id", "__term")
    return x.withColumn("code", codec.pack_metadata("feature_idx", "strand", F.coalesce("__term", F.lit(0)))).drop("__term")


def record(intervals: DataFrame, features: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Intervals (scaffold, start_pos, end_pos, code) with what their code says; '' where nothing is known."""
    meta = features.select("feature_idx", "id", "source", "biotype")
    x = intervals.withColumns({"feature_idx": codec.parse_index("code"), "__term": codec.parse_term("code")}).join(meta, "feature_idx", "left")
    x = x.withColumn("__type", ontology.label_of("__term")) if dim is None else ontology.find(x, dim, "__term", "short_id", "label", "__type")
    return x.select("scaffold", "start_pos", "end_pos", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("__type", F.lit("")).alias("feature_type"), codec.parse_strand("code").alias("strand"), F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.array("id", "source", "biotype")).alias("metadata"))


def metadata(features: DataFrame) -> DataFrame:
    return features.select("feature_idx", F.array("id", "source", "biotype").alias("metadata"))


def metadata_id(indices: DataFrame, features: DataFrame) -> DataFrame:
    """indices (feature_idx, …) with the id behind each, null out of range."""
    return indices.join(features.select("feature_idx", "id"), "feature_idx", "left")


def summary(features: DataFrame) -> DataFrame:
    return features.groupBy("scaffold").agg(F.count("*").alias("n_features"), F.countDistinct("feature_type").alias("n_types"), F.max("end_pos").alias("last_pos"))
