"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a scratch folder of this machine; on a cluster a missing
    setting is an error, because executors could not read what others wrote.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_scratch(spark.sparkContext.applicationId)


@cache
def _local_scratch(application: str) -> str:
    return tempfile.mkdtemp(prefix="embergrid-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that survive executor loss, keeps column pruning and filter pushdown,
    and gives Catalyst the true size, so that a join broadcasts a side only after its size is known.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder of any file system Spark reads; none if it does not exist."""
    at, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables this application wrote. DataFrames that read them are of no use afterwards."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def utc(spark: SparkSession) -> SparkSession:
    """All dates in this library are UTC calendar dates."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
