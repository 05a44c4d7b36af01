"""Sending this package to Python workers that have another search path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the context, once; executors fetch them from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_cellscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="cellscope-zip-"), "cellscope_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("cellscope", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._cellscope_shipped = True
