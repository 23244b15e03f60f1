"""Send the package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import netsieve

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the application, once; Spark serves it to every executor."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(netsieve.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="netsieve-ship-"), "netsieve_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "netsieve")):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
