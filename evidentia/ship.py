"""Makes this package importable on executors, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Arrow batches hold whole texts, so they are kept smaller than Spark's defaults (10,000 rows, 64 MB or more).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8m")}


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once for each Spark context, and bounds its
    Arrow batches where the session has Spark's defaults."""
    context = spark.sparkContext
    for key, (default, value) in BATCH.items():
        if default is None or spark.conf.get(key) == default:
            try:
                spark.conf.set(key, value)
            except Exception:  # a Spark version without this setting
                continue
    if getattr(context, "_evidentia_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it runs from a zip that was shipped already
        path = Path(tempfile.mkdtemp(prefix="evidentia-")) / "evidentia.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
    context._evidentia_shipped = True
