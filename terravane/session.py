"""Session helpers: shipping the package to executors and shared intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Rows of a batch, at most, on the way to a Python worker and in a Parquet scan: batches of very long texts must fit in memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.parquet.columnarReaderBatchSize": 512}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, once per application, and limit the batches of this session to BATCHES (smaller numbers of the user's stay)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="ship-")
        path = os.path.join(folder, f"{top.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    for name, most in BATCHES.items():
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terravane-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # for discard()
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by materialize() that nothing will read again; others are left alone."""
    for df in tables:
        if (written := getattr(df, "_written", None)) is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession, groups: int | None = None) -> int:
    """Tasks for groups that take long for their few bytes, which Spark would put together by size: one for each group, or four a core, at least as many as shuffles have."""
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return most if groups is None else max(1, min(groups, 4 * most))


def bounded(df: DataFrame, most: int = 20_000) -> DataFrame:
    """The table, marked to be sent to all tasks if it has at most `most` rows; else Spark chooses how to join it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
