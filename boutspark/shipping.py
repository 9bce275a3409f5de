"""Sends this package to the executors, so that functions over partitions can import it there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's sources to every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    folder = tempfile.mkdtemp(prefix=f"{_PACKAGE.name}-")
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)
