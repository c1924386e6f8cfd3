"""Gives executors this package, for the Python functions that run there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip through Spark's own file distribution, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="corollary-")), f"{here.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
