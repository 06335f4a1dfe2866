"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, once per application.

    A cluster job may pass it with ``--py-files`` or install it instead.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="run-"), "leaguestats")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), "leaguestats"))
        _shipped.add(application)
