"""Shipping this package to executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.scratch import scratch

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, for those that cannot import it from a path of their own."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).resolve().parent.parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='kilnwork-')}/{package.name}", "zip", package.parent, package.name))


__all__ = ["scratch", "ship"]
