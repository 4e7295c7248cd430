"""Sends the package's code to the executors, so that a cluster needs no installation of it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

_sent: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"  # else ten thousand rows of any length travel at once


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the application's Python files, once for each application, and bounds the bytes of
    the batches that tasks exchange with Python where the session has no bound of its own."""
    if spark.conf.get(BATCH) == spark.newSession().conf.get(BATCH):
        spark.conf.set(BATCH, "8m")  # a value of the caller's own stays
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="orrery-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # Spark keeps a copy of its own
    path = os.path.join(made, "orrery_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def dealt(cells: DataFrame, *keys: str) -> GroupedData:
    """Groups of few heavy cells for tasks of their own: a numbered partitioning, which the adaptive planner leaves as it is
    where it would put so few bytes into one task."""
    return cells.repartition(max(1, min(2 * cells.count(), 4096)), *keys).groupBy(*keys)


def apart(spark: SparkSession, cells: list, kinds: str, grouped: bool = False) -> GroupedData:
    """Cells (or groups of cells) by `place`, each in a partition of its own, in their order: hashes would put several heavy
    ones into one task and none into others."""
    groups = cells if grouped else [[c] for c in cells]
    rows = [(place, *c) for place, g in enumerate(groups) for c in g]
    n = max(1, len(groups))
    frame = spark.createDataFrame(rows, f"place int, {kinds}")
    return frame.repartitionById(n, F.col("place")).groupBy("place")
