"""Call sets as Arrow IPC files, for exchange with other tools; Parquet is the store.

A folder holds a file for each scaffold, more for a large one, and a manifest, `scaffolds.tsv`, of name and file.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec
from ..session import ship

MANIFEST = "scaffolds.tsv"
SCHEMA = pa.schema([("pos", pa.uint32()), ("payload", pa.uint32())])


MOST, BIN = 1 << 24, 1 << 20  # sites of a scaffold in one file, about; bases that are not parted


def _written(folder: str, stems: dict[str, str], compression: str | None) -> Callable:
    """Batches sorted by (scaffold, part, site) to one file for each (scaffold, part), named when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, done = None, None, []
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != now:
                    if out:
                        done.append((*now, out.close()))
                    now = keys[i]
                    out = _File(folder, f"{stems[now[0]]}{'' if now[1] == 0 else f'.{now[1]}'}.arrow", compression)
                out.add(b.slice(i, j - i))
                i = j
        if out:
            done.append((*now, out.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["scaffold", "part", "file"])

    return run


class _File:
    def __init__(self, folder: str, name: str, compression: str | None):
        self.at, self.name = Path(folder, name), name
        self.own = Path(folder, f".{name}.{uuid.uuid4().hex}")  # a second attempt of a task writes its own
        self.sink = pa.OSFile(str(self.own), "wb")
        self.out = pa.ipc.new_file(self.sink, SCHEMA, options=pa.ipc.IpcWriteOptions(compression=compression))

    def add(self, b: pa.RecordBatch) -> None:
        self.out.write_batch(pa.RecordBatch.from_arrays([b.column(k).cast(pa.uint32()) for k in (2, 3)], schema=SCHEMA))

    def close(self) -> str:
        self.out.close()
        self.sink.close()
        os.replace(self.own, self.at)
        return self.name


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            table = pa.ipc.open_file(io.BytesIO(content.as_py()))
            if missing := {"pos", "payload"} - set(table.schema.names):
                raise ValueError(f"not a call file, {sorted(missing)} missing: {path.as_py()}")
            for k in range(table.num_record_batches):
                x = table.get_batch(k)
                cols = [x.column(x.schema.get_field_index(c)).cast(pa.int64()) for c in ("pos", "payload")]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(x), pa.string()), *cols], names=["path", "pos", "payload"])


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, pos, payload) of call files, each read by one task."""
    ship(spark)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_rows, "path string, pos long, payload long")


def write_folder(calls: DataFrame, folder: str, compression: str | None = "zstd", most: int = MOST) -> None:
    """Files of each scaffold in order of name, with unique stems of harmless letters, and the manifest.

    Executors write the files, in a folder that all of them share: one of a scaffold, and one more for each `most` sites
    that it has over. The driver keeps the names.
    """
    ship(calls.sparkSession)
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    names = [r.scaffold for r in calls.select("scaffold").distinct().orderBy("scaffold").collect()]  # scaffolds are few
    stems: dict[str, str] = {}
    for name in names:
        stem = base = re.sub(r"[^A-Za-z0-9._-]", "_", name)
        k = 1
        while stem in stems.values():
            k += 1
            stem = f"{base}_{k}"
        stems[name] = stem
    # a row for each scaffold and BIN: where it begins tells its file
    span = min(BIN, most)
    x = calls.select("scaffold", F.floor(F.col("pos") / span).alias("bin"), "pos", "payload")
    before = W.partitionBy("scaffold").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    parts = x.groupBy("scaffold", "bin").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most)).drop("n")
    x = x.join(parts, ["scaffold", "bin"]).select("scaffold", "part", "pos", "payload")
    x = x.repartition("scaffold", "part").sortWithinPartitions("scaffold", "part", "pos", codec.get_context("payload"), codec.get_strand("payload"))
    files = x.mapInArrow(_written(str(at), stems, compression), "scaffold string, part long, file string").collect()
    (at / MANIFEST).write_text("".join(f"{r.scaffold}\t{r.file}\n" for r in sorted(files, key=lambda r: (r.scaffold, r.part))))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The call set of a folder: (scaffold, pos, context, strand, payload). Without a manifest: an error."""
    manifest = Path(folder) / MANIFEST
    if not manifest.exists():
        raise FileNotFoundError(str(manifest))
    rows = [line.split("\t") for line in manifest.read_text().splitlines() if line]
    if not rows:
        return spark.createDataFrame([], "scaffold string, pos long, context int, strand int, payload long")
    names = spark.createDataFrame([(n, f) for n, f in rows], "scaffold string, file string")
    x = read_files(spark, [str(Path(folder) / f) for _, f in rows]).withColumn("file", F.element_at(F.split("path", "/"), -1))
    x = x.join(F.broadcast(names), "file")  # the manifest
    return x.select("scaffold", "pos", codec.get_context("payload").cast("int").alias("context"), codec.get_strand("payload").cast("int").alias("strand"), "payload")
