"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ours: set[str] = set()
_local: dict[str, str] = {}  # by application: the folder of a local session without a shared one
_paths: dict[int, tuple[DataFrame, str]] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, deleted when the application ends. Where that setting is
    missing, a local session (driver and workers on one machine) gets a temporary folder; a cluster gets an error, for
    its executors could not read what others wrote into a folder of their own."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {sc.master} it must name a folder that driver and executors share")
        top = _local.get(sc.applicationId) or _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="orrery-"))
    path = f"{top.rstrip('/')}/orrery-{sc.applicationId}"
    if path not in _ours:
        _ours.add(path)
        atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """Writes df once and reads it back: the plan's lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)  # holds the frame, so that its number stays its own
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables that `written` returned, once nothing that is still to run reads them."""
    for df in frames:
        _, path = _paths.pop(id(df), (None, None))
        if path:
            delete(df.sparkSession, path)
