"""The package for Python workers that can't import it from their own path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of rows that a Python function gets at a time, unless the session says otherwise: rows may be long texts.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ensure_shipped(spark: SparkSession) -> None:
    """Send the package's source to the executors, once a session, unless PYTHONPATH already holds it; bound their batches."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_helixmill_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="helixmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "helixmill_source.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for where, _, names in os.walk(os.path.join(root, "helixmill")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._helixmill_shipped = True
