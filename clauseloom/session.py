"""Session helpers: checkpoint folder, scratch folder, table reads."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    a machine-local folder would lose data with its executor, so that is an error.
    """
    global _local_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="clauseloom-", dir="/tmp")
    return _local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table written and read back."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run inside leave no shuffle files: Spark removes them when a query ends.

    For results that are written or collected, which nobody reads by their shuffles again.
    """
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written once as parquet in the shared folder and read back.

    For results that several later steps use: they read only the columns they
    need, and a lost executor costs a re-read instead of a recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The input dealt out by a key, if ``spark.clauseloom.readPartitions`` says to how many partitions.

    For small files with few splits and CPU-heavy work; unset, the file splits stay as they are.
    """
    wanted = df.sparkSession.conf.get("spark.clauseloom.readPartitions", None)
    return df.repartition(int(wanted), key) if wanted else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt out for CPU-heavy work: three tasks a core, or as many as ``spark.clauseloom.readPartitions`` says.

    A number of its own, as a small file has few splits and adaptive execution would merge small partitions.
    """
    spark = df.sparkSession
    wanted = spark.conf.get("spark.clauseloom.readPartitions", None)
    return df.repartition(int(wanted) if wanted else 3 * spark.sparkContext.defaultParallelism, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
