"""Give executors this code, so that a session started anywhere can run it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package and what it imports to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "training_data.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for package in ("llm", "framevitals"):
            for folder, _, names in os.walk(os.path.join(ROOT, package)):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        bundle.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    _DONE.add(context.applicationId)


#: Bytes of an Arrow batch, unless the session says otherwise: texts may be long, and rows alone do not bound a batch.
BATCH = 8 << 20


def shipped(query):
    """``query(spark, ...)`` with the code shipped first, and Arrow batches bounded by bytes."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return query(spark, *args)

    return run
