"""What a Spark application needs to run the library's Python code on its executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the application's executors, once, so that their Python workers can import it."""
    _ship(spark.sparkContext)
    return spark


@functools.cache
def _ship(context) -> None:
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="citespark-"), "citespark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
    context.addPyFile(path)
