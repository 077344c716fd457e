"""Brings the package to the executors' Python workers where it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(place))
    _SHIPPED.add(application)
