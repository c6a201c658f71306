"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folder, below the application's own, of the tables that the running stage settles.
_STAGE: ContextVar[str | None] = ContextVar("stage", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets a
    scratch folder of its own. On a cluster a missing setting is an error,
    because a driver-local folder would be invisible to the executors.
    """
    folder = spark.conf.get(_CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(_CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused between calls."""
    stage = _STAGE.get()
    folder = f"{_own_folder(spark)}/{stage}" if stage else _own_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end, but for those settled with ``keep``.

    DataFrames that read a deleted table must not be used any more.
    """
    stage = f"stage-{uuid.uuid4().hex}"
    before = _STAGE.set(stage)
    try:
        yield
    finally:
        _STAGE.reset(before)
        folder, files = hadoop_file(spark, f"{_own_folder(spark)}/{stage}")
        files.delete(folder, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/runledger/{spark.sparkContext.applicationId}"


def hadoop_file(spark: SparkSession, path: str):
    """A file or folder in any store, and the file system that holds it."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clean_up(spark: SparkSession) -> None:
    """Delete every table that this application has settled.

    Call it once all results are written: DataFrames built before read from there.
    """
    folder, files = hadoop_file(spark, _own_folder(spark))
    files.delete(folder, True)


def settle(
    df: DataFrame, label: str, partition_by: list[str] | None = None, keep: bool = False
) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    This cuts the lineage of an iterative job, survives the loss of executors,
    and gives the next step true file sizes, so Spark itself decides whether a
    frontier is small enough to broadcast. With ``keep`` the table outlives the
    stage (:func:`passing_tables`) that it is settled in.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}" if keep else scratch_path(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
