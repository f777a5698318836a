"""Sessions, and getting this package to the executors' Python."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", memory: str = "8g", name: str = "quire") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that functions run in their Python find it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quire-ship-")) / "quire.zip"
        with zipfile.ZipFile(target, "w") as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(top.parent))
        context.addPyFile(str(target))
    return spark


#: Bytes of a batch of rows to the executors' Python, where the session sets none (Spark's own limits are 10,000 rows and 64 MB).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """From now on the session's batches to Python hold ``BATCH_BYTES`` (and a row more), unless it has a limit of its own. An executor holds a batch of each of its tasks in Spark
    and again in Python, and neither gives the memory back; with whole texts in the rows a batch is as large as the task's share of the input."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder. Where none is set, one of our own is, but for a local master only: on a cluster no other machine would see it."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, readable after an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
