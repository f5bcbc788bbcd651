"""Session settings, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "finlattice", master: str | None = None, **more: str) -> SparkSession:
    """A session with the settings that the operators expect; master only for local runs."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="finlattice-"), "finlattice_sources.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
