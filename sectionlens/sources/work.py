"""The folder that the driver and all executors share for tables in between."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine whose session names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder, under the one that all executors share, for one run of an operator.

    It goes when the driver's JVM ends, since results may read it until then.  On a cluster
    a session without ``spark.checkpoint.dir`` is an error: no other folder is surely shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def written(df: DataFrame, folder: str) -> DataFrame:
    """The rows of a frame as a written table: its lineage ends here and its tasks have run once."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, folder: str) -> None:
    """Removes a folder of ``work_dir`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder or file of the shared store, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
