"""Per-site methylation calls: parsing, counting, merging and storing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec

SITE = ("scaffold", "pos", "context", "strand")


def _kept(parsed: DataFrame, rest: list[str], fields: list[str], *needed: str) -> DataFrame:
    """`rest` and `fields` of parsed lines with a scaffold and all that is needed.

    Rows are dropped by a generator: a filter would be pushed below the parsing and repeat it for each condition.
    """
    good = F.filter(F.array(F.struct(*fields)), lambda r: reduce(lambda x, y: x & y, [r[n].isNotNull() for n in needed], r["scaffold"] != ""))
    return parsed.select(*rest, F.inline(good))


def parse_reads(lines: DataFrame, line: str = "value") -> DataFrame:
    """(…, scaffold, pos, context, methylated) of per-read call lines; lines that don't parse go."""
    rest = [c for c in lines.columns if c != line]
    x = lines.select(*rest, F.split(line, "\t", -1).alias("__f"))
    at = lambda i: F.get("__f", F.lit(i))
    context, meth = codec.decode_call(F.substring(at(4), 1, 1))
    x = x.select(*rest, at(2).alias("scaffold"), codec.parse_uint32(at(3)).alias("pos"), context.alias("context"), meth.alias("methylated"))
    return _kept(x, rest, ["scaffold", "pos", "context", "methylated"], "pos", "context")


def count_reads(reads: DataFrame, strand: Column | int = codec.NA) -> DataFrame:
    """Sites with counts of methylated and other calls."""
    x = reads.withColumn("strand", F.lit(strand) if isinstance(strand, int) else strand)
    return x.groupBy(*SITE).agg(F.sum(F.col("methylated").cast("long")).alias("meth"), F.sum((~F.col("methylated")).cast("long")).alias("unmeth"))


def parse_coverage(lines: DataFrame, line: str = "value") -> DataFrame:
    """(…, scaffold, pos, meth, unmeth) of coverage lines: columns 1, 2, 5 and 6; lines that don't parse go."""
    rest = [c for c in lines.columns if c != line]
    x = lines.select(*rest, F.split(F.regexp_replace(line, "\r$", ""), "\t", -1).alias("__f"))
    at = lambda i: codec.parse_uint32(F.get("__f", F.lit(i)))
    x = x.select(*rest, F.get("__f", F.lit(0)).alias("scaffold"), at(1).alias("pos"), at(4).alias("meth"), at(5).alias("unmeth"))
    return _kept(x, rest, ["scaffold", "pos", "meth", "unmeth"], "pos", "meth", "unmeth")


def pack(sites: DataFrame) -> DataFrame:
    """Sites with counts to sites with a payload."""
    rest = [c for c in sites.columns if c not in ("meth", "unmeth")]
    return sites.select(*rest, codec.pack_payload("meth", "unmeth", F.col("context"), F.col("strand")).alias("payload"))


def load_coverage(lines: DataFrame, by: list[str] | None = None, context: Column | int = codec.CPG, strand: Column | int = codec.NA, line: str = "value", parts: int | None = None) -> DataFrame:
    """Call sets of coverage lines: repeated positions are summed before they are packed. `by`: columns that part the sets.

    With `parts`, lines go to that many tasks by position as they are, and sums over sites that follow need not move them again: the task that
    reads lines would else hold about all of its sites at once, as positions repeat little.
    """
    x = parse_coverage(lines, line).withColumns({"context": F.lit(context) if isinstance(context, int) else context, "strand": F.lit(strand) if isinstance(strand, int) else strand})
    if parts:
        x = x.repartition(parts, "scaffold", "pos")
    return pack(x.groupBy(*(by or []), *SITE).agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth")))


def read_coverage(spark: SparkSession, paths: str | list[str], context: Column | int = codec.CPG, strand: Column | int | None = None) -> DataFrame:
    """Coverage files as one call set; the strand comes from the file name unless given."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    sets = load_coverage(lines, ["path"], context, codec.infer_strand("path") if strand is None else strand)
    return merge(sets, "path")


def read_reads(spark: SparkSession, paths: str | list[str], strand: Column | int | None = None) -> DataFrame:
    """Per-read call files as one call set."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    x = parse_reads(lines).withColumn("strand", codec.infer_strand("path") if strand is None else F.lit(strand))
    sets = x.groupBy("path", *SITE).agg(F.sum(F.col("methylated").cast("long")).alias("meth"), F.sum((~F.col("methylated")).cast("long")).alias("unmeth"))
    return merge(pack(sets), "path")


def merge(sets: DataFrame, order: str, exact_fold: bool = False) -> DataFrame:
    """One call set from many (scaffold, pos, context, strand, payload, order).

    Counts are rebuilt from the payloads, summed and packed again; a site of one set keeps its payload. With
    `exact_fold` sets are folded one by one in `order`, packing at each step, as deep sites may then round
    otherwise.
    """
    x = sets.withColumns({"m": codec.get_meth("payload"), "u": codec.get_unmeth("payload")})
    if not exact_fold:
        g = x.groupBy(*SITE).agg(F.count("*").alias("n"), F.first("payload").alias("one"), F.sum("m").alias("m"), F.sum("u").alias("u"))
        return g.select(*SITE, F.when(F.col("n") == 1, F.col("one")).otherwise(codec.pack_payload("m", "u", F.col("context"), F.col("strand"))).alias("payload"))
    # one entry for each set that has the site
    g = x.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "payload"))).alias("all"))
    step = lambda acc, p: codec.pack_payload(codec.get_meth(acc) + codec.get_meth(p["payload"]), codec.get_unmeth(acc) + codec.get_unmeth(p["payload"]), codec.get_context(acc), codec.get_strand(acc))
    return g.select(*SITE, F.aggregate(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), F.col("all")[0]["payload"], step).alias("payload"))


def in_range(calls: DataFrame, lo: int, hi: int, scaffold: str | None = None) -> DataFrame:
    """Sites with lo <= pos <= hi; the filter reaches a partitioned, sorted store's row groups."""
    x = calls.where(F.col("pos").between(lo, hi))
    return x if scaffold is None else x.where(F.col("scaffold") == scaffold)


def write(calls: DataFrame, path: str, compression: str = "zstd") -> None:
    """One folder for each scaffold, rows sorted by position. Positions spread a large scaffold over tasks."""
    x = calls.repartition("scaffold", F.floor(F.col("pos") / (1 << 24))).sortWithinPartitions("scaffold", "pos", "context", "strand")
    x.write.mode("overwrite").option("compression", compression).partitionBy("scaffold").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored call set; scaffold names are kept as written whatever they look like."""
    df = spark.read.schema("pos long, context int, strand int, payload long, scaffold string").parquet(path)
    missing = {"pos", "payload"} - set(df.columns)
    if missing:
        raise ValueError(f"not a call set, {sorted(missing)} missing: {path}")
    return df


def create(spark: SparkSession, scaffold: str, pos: list[int], payload: list[int]) -> DataFrame:
    """A call set from positions and payloads of one scaffold; their numbers must agree."""
    if len(pos) != len(payload):
        raise ValueError(f"{len(pos)} positions, {len(payload)} payloads")
    x = spark.createDataFrame(list(zip(pos, payload)), "pos long, payload long")
    return x.select(F.lit(scaffold).alias("scaffold"), "pos", codec.get_context("payload").cast("int").alias("context"), codec.get_strand("payload").cast("int").alias("strand"), "payload")


def aggregated(rows: DataFrame) -> DataFrame:
    """A call set from counts (scaffold, pos, meth, unmeth, context, strand), one site a row."""
    return pack(rows.select(*SITE, "meth", "unmeth"))


def summary(calls: DataFrame) -> DataFrame:
    """Sites, depth and methylated calls by scaffold."""
    return calls.groupBy("scaffold").agg(F.count("*").alias("n_sites"), F.sum(codec.get_depth("payload")).alias("depth"), F.sum(codec.get_meth("payload")).alias("meth"))
