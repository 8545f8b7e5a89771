"""Sends this package's sources to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add the sources to the context's Python files, once a context."""
    context = spark.sparkContext
    if getattr(context, "_tracegraph_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tracegraph-src-"), "tracegraph_sources.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tracegraph", os.path.relpath(path, top)))
    context.addPyFile(target)
    context._tracegraph_shipped = True
