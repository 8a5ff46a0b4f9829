"""Sending this package's source to the executors, where functions of it run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package, once for each application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    package = os.path.dirname(os.path.abspath(__file__))
    if app in _SHIPPED:
        return
    if os.path.isdir(package):  # else it came as an archive already
        target = os.path.join(tempfile.mkdtemp(prefix="sluiceway-"), "sluiceway.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
