"""Makes the package importable in Python workers, for the operators that run Python on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# The folders of the archives, which go when the process ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Hands the package to the executors once per application; Spark's file server distributes it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    kept = tempfile.TemporaryDirectory(prefix="leaksieve-package-", ignore_cleanup_errors=True)
    archive = os.path.join(kept.name, "leaksieve.zip")
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.join("leaksieve", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _shipped[context.applicationId] = kept
