"""This package for Python workers that don't have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package: Spark sends its source files to them, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves the file as long as it runs; nothing but the driver reads this folder.
    folder = tempfile.mkdtemp(prefix="shardloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "shardloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
