"""Send this package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the application, once for each application; returns spark."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        _sent.add(sc.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="tidegate-src-"), "tidegate-src.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("tidegate", os.path.relpath(path, here)))
        sc.addPyFile(archive)
    return spark
