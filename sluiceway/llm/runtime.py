"""Shared plumbing of the operators: shipping code, scratch tables, reading inputs."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes (about) of a batch of rows that a Python worker gets at a time, where the session does not say otherwise.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 23


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application, and bound what their workers get at a time."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        root = os.path.dirname(package)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        target = os.path.join(tempfile.mkdtemp(prefix="sluiceway-"), "sluiceway.zip")
        with open(target, "wb") as f:
            f.write(buffer.getvalue())
        spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where that is set.  Otherwise a local session
    gets a folder of its own and a cluster one below its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local["):
            named = os.path.join(tempfile.gettempdir(), f"sluiceway-{spark.sparkContext.applicationId}")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/") + "/" + spark.sparkContext.applicationId


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_MADE: list[Scratch] = []


def made() -> int:
    """How many scratch folders there have been."""
    return len(_MADE)


def release(since: int) -> None:
    """Delete the scratch folders made since; nothing may read them any more."""
    for x in _MADE[since:]:
        fs, p = _hadoop_path(x.spark, x.base)
        fs.delete(p, True)
    del _MADE[since:]


class Scratch:
    """Tables written to the shared folder.  ``drop`` removes those no longer read, ``release``
    whole folders; the rest go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        fs, p = _hadoop_path(spark, self.base)
        fs.deleteOnExit(p)
        self.n = 0
        _MADE.append(self)

    def keep(self, df: DataFrame, label: str = "t", partition_by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back, which cuts its lineage."""
        self.n += 1
        path = f"{self.base}/{self.n}-{label}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path = getattr(f, "_scratch_path", None)
            if path:
                fs, p = _hadoop_path(self.spark, path)
                fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
