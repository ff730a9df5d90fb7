"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a local session gets a folder for tests; a cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not configured and held.isDefined():
        configured = held.get()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def run_dir(spark: SparkSession) -> str:
    """A folder of this application within the shared one; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/joulegrid-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, whatever store it is in; nothing if the session has ended."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Written once to the shared folder; what follows starts from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tasks_per_core: int | None = 4) -> DataFrame:
    """Like ``settle``, as Parquet: small parts are read together, and sizes are known to the planner.

    Neighbouring partitions are written together by ``tasks_per_core`` tasks for each core of the cluster at most, as
    every file costs its creation, and tiny ones cost no less. None keeps partitions as they are, for rows that much
    work goes into.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    kept = df if tasks_per_core is None else df.coalesce(tasks_per_core * spark.sparkContext.defaultParallelism)
    kept.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
