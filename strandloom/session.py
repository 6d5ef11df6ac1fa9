"""Session set-up shared by the operators."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
}
#: bytes of an Arrow batch that goes to Python, where the session names none: rows are texts of any length
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    b = SparkSession.builder.master(master).appName("strandloom").config("spark.driver.memory", memory)
    for k, v in CONF.items():
        b = b.config(k, v)
    return b.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for its Arrow functions."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:
        z = Path(d, f"{root.name}.zip")
        with zipfile.ZipFile(z, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        data = z.read_bytes()
    keep = Path(tempfile.mkdtemp(prefix="strandloom-ship-"), f"{root.name}.zip")
    keep.write_bytes(data)
    spark.sparkContext.addPyFile(str(keep))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, where all executors read and write. Local mode without one gets a temporary folder; elsewhere that is an error."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _folders:
        _folders[sc.applicationId] = tempfile.mkdtemp(prefix="strandloom-")
    return _folders[sc.applicationId]


def _shuffles(plan, found: set[int]) -> set[int]:
    """Ids of the shuffles that an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffles(plan.executedPlan(), found)
    if kind.endswith("QueryStageExec"):
        return _shuffles(plan.plan(), found)
    if kind == "ShuffleExchangeExec":
        found.add(plan.shuffleId())
    for many in (plan.children(), plan.subqueries()):
        for i in range(many.size()):
            _shuffles(many.apply(i), found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, and remove the shuffle files that only its plan has."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    # they would else stay until the driver collects the plan; whoever runs df again computes it again
    if (cleaner := sc._jsc.sc().cleaner()).isDefined():
        for i in _shuffles(df._jdf.queryExecution().executedPlan(), set()):
            cleaner.get().doCleanupShuffle(i, False)
    return out


def parted(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df checkpointed by hash of keys and sorted by them, so that joins on these keys move and sort only their other side.

    Adaptive plans don't tell how they end up partitioned; this one is planned without.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        spark.conf.set(name, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
