"""Sinks. None of them overwrites an existing output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write to a new folder; an existing one is refused."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}; choose one of {FORMATS}")
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def write_submission(scores: DataFrame, path: str, key: str, score: str, target: str = "TARGET") -> str:
    """Two-column CSV ``(key, target)``."""
    return write_new(scores.select(F.col(key), F.col(score).alias(target)), path, "csv")


def write_vector(cells: DataFrame, path: str, position: str = "position", value: str = "value") -> int:
    """Write flat vector cells as a range-sorted one-column CSV, return the element count."""
    write_new(cells.orderBy(position).select(F.col(value).alias("value")), path, "csv")
    return cells.sparkSession.read.option("header", True).csv(path).count()
