"""Making this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

import winnow
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors with ``addPyFile``, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(winnow.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="winnow-modules-"), "winnow_modules.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("winnow", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
