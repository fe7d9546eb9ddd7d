"""Session helpers: shared folders, table reading, and worker import paths."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Paths that ``scratch`` gave out, for each open ``step``.
_steps: list[list[str]] = []


#: Bytes in memory for a byte in a Parquet file: columns of ids and names, which number rows, shrink so much and more.
UNPACKED = 16


def honest_sizes(spark: SparkSession) -> None:
    """Let Spark take tables for what they are in memory where it decides on broadcasts; a user's own setting stays.

    Spark takes the size of a file for the size of its rows, so a column of ids of under 10 MB is broadcast though
    it is a hash table of hundreds of MB in each task.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) == 1.0:
        spark.conf.set(key, str(float(UNPACKED)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset (tests on a local master) a temporary folder becomes the setting; on a cluster
    that would be a folder which other machines can't see, so it raises there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oriel-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_root(spark)}/oriel/{label}-{uuid.uuid4().hex[:12]}"
    for made in _steps:
        made.append(path)
    return path


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: what was made of them is itself written."""
    for t in tables:
        discard(t.sparkSession, t._scratch)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder through Hadoop's file system API."""
    if not path.startswith(f"{shared_root(spark)}/oriel/"):
        raise ValueError(f"not a scratch path: {path}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what is written to the shared folder inside, but for the tables that are put into the list.

    The JVM is asked to collect garbage too: Spark deletes the shuffle files of finished queries once it notices
    that nothing refers to them, which in a driver with memory to spare may be long after.
    """
    kept: list[DataFrame] = []
    made: list[str] = []
    _steps.append(made)
    try:
        yield kept
    finally:
        _steps[:] = [m for m in _steps if m is not made]
    for path in set(made) - {t._scratch for t in kept}:
        discard(spark, path)
    gc.collect()
    spark._jvm.System.gc()
