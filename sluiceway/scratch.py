"""Tables and files that are written once and reread: lineage is cut by them, never by a local checkpoint."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; it goes when the session's JVM ends.

    It lies below ``spark.checkpoint.dir`` where that is set.  Otherwise a local session gets a
    folder of its own, and a cluster one below its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[")
        base = os.path.join(tempfile.gettempdir(), "sluiceway") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system that it lies on, which may be local, distributed or an object store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to a path and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
