"""The package for executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import mdframes

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors of the application, once; the numerical kernels
    travel by module name and need them there. Not needed where the package is installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(mdframes.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="mdframes-"), "mdframes"), "zip", root, "mdframes")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
