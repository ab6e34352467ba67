"""This package on the executors, wherever they are."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_NAME = "reviewloom-package.zip"


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once per application, as ``--py-files`` would.

    Functions that run in tasks are looked up by module there; without this
    they are found only where the repository happens to be on the path.
    """
    sc = spark.sparkContext
    if any(f.endswith(f"/{_NAME}") for f in sc.listFiles):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), _NAME)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("reviewloom", os.path.relpath(full, top)))
    sc.addPyFile(path)
