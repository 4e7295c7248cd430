"""Sinks: Parquet by period, single CSV tables, JSON payloads, append by grid cell, well-known-binary geometry."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """Parquet; with `by` partitioned on disk, its rows dealt by the same keys so that files stay few."""
    if by:
        df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_result(df: DataFrame, path: str, digits: int | None = None, compressed: bool = False, mode: str = "error") -> None:
    """A small result table as one CSV file, floats rounded half-even if asked for."""
    if digits is not None:
        df = df.withColumns({c: F.bround(c, digits) for c, t in df.dtypes if t in ("double", "float")})
    df.coalesce(1).write.mode(mode).option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def append_cell(df: DataFrame, path: str, cell: str) -> None:
    """One grid cell's rows into a growing result: a cell that is written again replaces itself and nothing else."""
    df.withColumn("cell", F.lit(cell)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)


def dump(payload, path: str) -> None:
    """Compact UTF-8 JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, separators=(",", ":"))


def payload(df: DataFrame, key: str) -> dict:
    """A small table as {key: {column: value}} for a web page."""
    return {str(r[key]): {c: v for c, v in r.asDict().items() if c != key} for r in df.collect()}


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """Well-known binary of a polygon, for a binary column that any GeoParquet reader knows."""
    out = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return out


def summary(df: DataFrame, name: str, digits: int = 3, rows: int = 20) -> str:
    """The first rows of a result as text for the console: names and values in columns, and how many rows there are."""
    shown = [tuple(r) for r in df.limit(rows).collect()]
    text = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    table = [df.columns, *([text(v) for v in r] for r in shown)]
    width = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in table]
    return "\n".join([f"{name} ({df.count()} rows)", *lines])
