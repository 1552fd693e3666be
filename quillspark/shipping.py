"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
BATCH_ROWS, BATCH_BYTES = 1_000, 8_000_000  # of an Arrow batch of whole texts, where the session does not set them


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application, and keep Arrow batches small: by rows, and by
    bytes for long texts.  What the session itself has set for them stays."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, str(value))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="quillspark-code-"), "quillspark_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("quillspark", os.path.relpath(full, root)))
        context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
