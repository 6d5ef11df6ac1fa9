"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as
the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import minhash, mixing, pieces, pii, queries, toxicity
from strandloom.session import shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, all columns.

    Null and empty texts score as texts without words. Repeated rows all stay or none; an empty table gives no rows.
    """
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, all columns: the one of the least doc_id.

    Null, empty and blank texts are no copies of each other; rows with one doc_id and one text are one document. A null
    doc_id comes after all others.
    """
    return minhash.representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by kind; n_chars, if there is one, follows the text.

    A null text stays null, and so is its n_chars.
    """
    out = pii.mask(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, small sources up to twice; a null source is a source of its own."""
    return mixing.mix(docs, entropy_share=0.95, most_epochs=2.0, budget=None, columns=True)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, and the digest of what they decode to; a null text is an empty one."""
    out = pieces.encode(docs, queries.tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("near-duplicates", drop_near_copies), ("personal data", mask_personal_data), ("mixing", mix_sources), ("encoding", to_pieces)]
#: learned scores and hashes have no SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages, tables in the folder that spark.checkpoint.dir names; each goes when the
    next one is written, and the last, which the result reads, stays."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                old = folder(f"{at}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
