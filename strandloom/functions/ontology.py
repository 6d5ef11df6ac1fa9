"""The sequence-ontology dimension: short id, full id, label, definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a small dimension of our own; short ids of gene (46) and exon (53) are fixed, the others are this table's
TERMS = [
    (46, 704, "gene", "A region that holds the unit of a heritable function."), (53, 147, "exon", "A part of a transcript that is kept by splicing."), (47, 234, "mRNA", "A transcript that codes for protein."),
    (48, 316, "CDS", "The part of a transcript that is translated."), (49, 673, "transcript", "A product of transcription."), (50, 204, "five_prime_UTR", "Untranslated region before the coding part."),
    (51, 205, "three_prime_UTR", "Untranslated region after the coding part."), (52, 188, "intron", "A part of a transcript that splicing removes."), (54, 253, "tRNA", "A transfer RNA."), (55, 252, "rRNA", "A ribosomal RNA."),
    (56, 336, "pseudogene", "A sequence like a gene that has lost its function."), (57, 655, "ncRNA", "A transcript that is not translated."), (58, 167, "promoter", "A region at which transcription starts."), (59, 165, "enhancer", "A region that raises transcription."),
]
SCHEMA = "short_id int, so_id int, label string, definition string"
GRAPHS = "graphs array<struct<nodes array<struct<id string, lbl string, meta struct<definition struct<val string>>>>>>"


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, SCHEMA)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """The dimension from an OBO-graph JSON file, or a folder of them; short ids number the SO nodes in order of appearance, files by path.

    A task holds a file at a time, so a large ontology comes in several.
    """
    from ..sources.gff import number  # which needs this module

    nodes = spark.read.schema(GRAPHS).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.col("graphs")[0]["nodes"]).alias("pos", "n"))
    kept = nodes.select("file", "pos", F.regexp_extract(F.col("n.id"), r"SO_([0-9]+)$", 1).alias("id"), F.col("n.lbl").alias("label"), F.col("n.meta.definition.val").alias("definition")).where("id <> ''")
    return number(kept, "file", "pos").selectExpr("cast(feature_idx as int) as short_id", "cast(id as int) as so_id", "label", "definition")


def lookup(df: DataFrame, dim: DataFrame, key: str, by: str = "label") -> DataFrame:
    """df with the term columns that its key matches, null where unknown. by: label, short_id or so_id."""
    return df.join(F.broadcast(dim.withColumnRenamed(by, "__k")), F.col(key) == F.col("__k"), "left").drop("__k")


def find(df: DataFrame, dim: DataFrame, key: str, by: str, out: str, name: str) -> DataFrame:
    """df with `name`: the least `out` of the terms whose `by` is df's key, null where unknown. A join, for an ontology of any size."""
    pairs = dim.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__k")).agg(F.min(out).alias(name))
    return df.join(pairs, F.col(key).cast(dict(dim.dtypes)[by]) == F.col("__k"), "left").drop("__k")


def _built_in(x: Column | str, by: int, out: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.try_element_at(F.create_map(*[F.lit(v) for t in TERMS for v in (t[by], t[out])]), c)


def _loaded(dim: DataFrame, x: Column | str, by: str, out: str) -> Column:
    """A look-up in a loaded dimension, which goes along as one map that is searched from end to end: for a few thousand terms; `find` takes any number."""
    c = F.col(x) if isinstance(x, str) else x
    pairs = dim.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(out).alias(out))
    return F.try_element_at(pairs.agg(F.map_from_entries(F.collect_list(F.struct(by, out)))).scalar(), c.cast(dict(dim.dtypes)[by]))


def short_id(label: Column | str, dim: DataFrame | None = None) -> Column:
    """Short id of a label of the dimension, the built-in one unless given; null if unknown."""
    return _built_in(label, 2, 0) if dim is None else _loaded(dim, label, "label", "short_id")


def label_of(short: Column | str, dim: DataFrame | None = None) -> Column:
    """Label of a short id, likewise."""
    if dim is not None:
        return _loaded(dim, short, "short_id", "label")
    return _built_in((F.col(short) if isinstance(short, str) else short).cast("int"), 0, 2)
