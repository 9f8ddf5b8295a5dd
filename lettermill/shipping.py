"""Sends this package to the executors, for sessions that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: What a batch of rows for Python holds at most, unless the session was started with another limit; a longer row is a batch of its own.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Lets workers give freed memory back: what is free at the end beyond 64 MB goes, few arenas are kept, and Arrow takes its memory the same way. Pieces of a few MB are taken again without a fault for each page.
FREEING = {"MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_TRIM_THRESHOLD_": "67108864", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application. Spark serves it from the driver.

    Rows go to Python in batches of a few megabytes, so that long texts do not meet by the thousand. What runs Python beside the driver, for streams with state, looks at the path in the environment instead.
    """
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lettermill-")) / "lettermill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    environment = spark.sparkContext.environment
    environment.update({k: v for k, v in FREEING.items() if k not in environment})
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), environment.get("PYTHONPATH")]))
    _sent.add(app)
