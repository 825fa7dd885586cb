"""Send this package to the executors, so that functions of Python tasks can be imported there."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package's sources as a zip file that Spark hands to every executor."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="ratingloom-zip-"), "ratingloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(target)
    _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run
