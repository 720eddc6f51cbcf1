"""Bring this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows that go to Python at once. An executor holds each such batch several times over, on its way out and back, and whole texts are large.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once; the code of array operators runs in executors that may lack it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="assayer-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """From now on at most ``BATCH_ROWS`` rows at once go to Python; a smaller bound of the session's own stays."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return spark
