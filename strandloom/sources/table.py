"""Expression tables and experiments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bed


def load(table: DataFrame, features: DataFrame, id_col: str, row_idx: str, values: list[str]) -> DataFrame | None:
    """Rows of a table matched to features: (row_idx, sample_id, feature_idx, scaffold, start_pos, end_pos, *values).

    Of repeated sample ids the last row matches; of features with one id the first in (scaffold, start, end, idx).
    Without a string id column or numeric values: None.
    """
    kinds = dict(table.dtypes)
    if kinds[id_col] != "string" or any(kinds[v] not in ("int", "bigint", "double", "float", "smallint", "tinyint") and not kinds[v].startswith("decimal") for v in values):
        return None
    first = features.groupBy("id").agg(F.min(F.struct("scaffold", "start_pos", "end_pos", "feature_idx")).alias("f"))
    last = W.partitionBy(id_col).orderBy(F.desc(row_idx))
    x = table.select(F.col(row_idx).alias("row_idx"), F.col(id_col).alias("sample_id"), *values, (F.row_number().over(last) == 1).alias("__last"))
    x = x.join(first, (F.col("sample_id") == F.col("id")) & F.col("__last"), "left")
    return x.select("row_idx", "sample_id", "f.feature_idx", "f.scaffold", "f.start_pos", "f.end_pos", *values)


def sample_ids(t: DataFrame) -> DataFrame:
    """(row_idx, id) of the features behind the rows, null where none matches."""
    return t.select("row_idx", F.when(F.col("feature_idx").isNotNull(), F.col("sample_id")).alias("id"))


def by_id(t: DataFrame, feature_id: str) -> DataFrame:
    return t.where(F.col("feature_idx").isNotNull() & (F.col("sample_id") == feature_id)).orderBy("row_idx").limit(1)


def by_ids(t: DataFrame, ids: list[str]) -> DataFrame:
    return t.where(F.col("feature_idx").isNotNull() & F.col("sample_id").isin(ids)).orderBy("row_idx")


def choose(t: DataFrame, values: list[str], wanted: list[str]) -> DataFrame | None:
    """The wanted value columns in table order; None if there is none."""
    found = [v for v in values if v in set(wanted)]
    return t.select(*[c for c in t.columns if c not in values], *found) if found else None


def to_frame(t: DataFrame, values: list[str]) -> DataFrame:
    return t.select("row_idx", F.when(F.col("feature_idx").isNotNull(), F.col("sample_id")).alias("ID"), *values)


@dataclass(frozen=True)
class Variable:
    """A node of an experiment's tree: a value with either covariates below it or the data of one sample."""

    value: str
    covariates: dict[str, Variable] | None = None
    data: DataFrame | None = None

    def __post_init__(self) -> None:
        if (self.covariates is None) == (self.data is None):
            raise ValueError("exactly one of covariates and data")


def _located(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, itself or those in a folder, as the scan's file_path column has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    files = [s.getPath() for s in fs.listStatus(p) if s.isFile()]
    return [f.toUri().toString() for f in files if not f.getName().startswith(("_", "."))]


def experiment(spark: SparkSession, sheet: DataFrame) -> DataFrame:
    """Samples of a sheet, whose last column holds paths and whose others are levels, as one table with level columns.

    `.bed` files give intervals, all others CSV tables whose columns from the second on are numbers; tables of one sheet
    have the same columns. A path may be a folder, whose files make the sample. A sheet may hold both: each kind is one scan over all its files, and columns that a kind
    doesn't have are null.
    """
    cols = sheet.columns
    if len(cols) < 2:
        raise ValueError("a sheet needs a level column and a path column")
    rows = sheet.collect()  # one row a file
    paths, levels = [r[-1] for r in rows], [tuple(None if v is None else str(v) for v in r[:-1]) for r in rows]
    if len(set(paths)) < len(paths):
        raise ValueError("paths repeat")
    if len(set(levels)) < len(levels):
        raise ValueError("levels repeat")
    at = {p: _located(spark, p) for p in paths}
    where = spark.createDataFrame([(f.replace("file:///", "file:/"), *v) for p, v in zip(paths, levels) for f in at[p]], ", ".join(["__at string", *(f"`{c}` string" for c in cols[:-1])]))
    beds = [p for p in paths if p.lower().endswith(".bed")]
    tables = [p for p in paths if not p.lower().endswith(".bed")]
    found = []
    if beds:
        found.append(bed.read_bed(spark, beds).withColumnRenamed("path", "__at"))
    if tables:
        x = spark.read.csv(tables, header=True, enforceSchema=False)
        names = x.columns
        found.append(x.select(F.col("_metadata.file_path").alias("__at"), f"`{names[0]}`", *[F.col(f"`{c}`").cast("double").alias(c) for c in names[1:]]))
    if not found:
        raise ValueError("an empty sheet")
    rows_of = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    rows_of = rows_of.withColumn("__at", F.regexp_replace("__at", "^file:///", "file:/"))
    out = rows_of.join(F.broadcast(where), "__at")  # a row for each file: parted by path, a few tasks would have all rows
    return out.select(*[f"`{c}`" for c in cols[:-1]], *[f"`{c}`" for c in rows_of.columns if c != "__at"])


def variables(spark: SparkSession, sheet: DataFrame) -> dict[str, Variable]:
    """The tree of an experiment's levels; each leaf holds its sample's rows, as a filter of the one table."""
    data, cols = experiment(spark, sheet), sheet.columns[:-1]

    def below(rows: list[tuple], k: int, df: DataFrame) -> dict[str, Variable]:
        out = {}
        for v in dict.fromkeys(r[k] for r in rows):
            mine, part = [r for r in rows if r[k] == v], df.where(F.col(f"`{cols[k]}`").eqNullSafe(F.lit(v)))
            out[v] = Variable(v, data=part) if k == len(cols) - 1 else Variable(v, covariates=below(mine, k + 1, part))
        return out

    return below([tuple(None if v is None else str(v) for v in r) for r in sheet.select(*[f"`{c}`" for c in cols]).collect()], 0, data)


def level_counts(sheet: DataFrame, levels: list[str]) -> DataFrame:
    """Leaves under each prefix of the levels (the trie's nodes): level columns, null below the prefix, and n."""
    sets = ", ".join("(" + ", ".join(levels[: k + 1]) + ")" for k in range(len(levels)))
    sheet.createOrReplaceTempView("__sheet")
    return sheet.sparkSession.sql(f"select {', '.join(levels)}, count(*) as n from __sheet group by grouping sets ({sets})")
