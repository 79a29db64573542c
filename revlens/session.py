"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings for a cluster session; a caller may override any of them.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keeps the seen keys of a long feed on disk instead of in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Lets the group limit run before the shuffle for quotas above the default of 1000.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


_LOCAL: list[tempfile.TemporaryDirectory] = []


def build_session(master: str | None = None, app: str = "revlens", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.TemporaryDirectory(prefix="revlens-")  # goes when the process ends
    _LOCAL.append(local)
    spark.conf.set("spark.checkpoint.dir", local.name)
    return local.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:10]}"


def materialised(df, name: str):
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(cleanup, "false")
    df.sparkSession.conf.set(cleanup, "true")  # what was shuffled for the table goes when it is written
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df) -> None:
    """Remove what ``materialised`` wrote; the table must not be read again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
