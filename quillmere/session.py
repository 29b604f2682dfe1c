"""Makes this package importable in Python workers that do not see the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch: texts can be long, and a worker holds a batch and what is made of it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once for each application, unless PYTHONPATH already leads to it."""
    for name, most in BATCH.items():  # only where the defaults stand
        if spark.conf.get(name, None) in (None, "10000"):
            spark.conf.set(name, most)
    home = Path(__file__).resolve().parent
    if str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _SHIPPED:
        return
    at = Path(tempfile.mkdtemp(prefix="quillmere-")) / "quillmere.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in home.rglob("*.py"):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(spark.sparkContext.applicationId)
