"""Materialised stages: data first, then a completion record that vouches for it.

The record also names the slot layout the stage was made for (slots and layout
fingerprint), so that stages of different layouts are never put together: the
same index would mean different entities.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from entityloom.operators.validate import coverage_check, layout_fingerprint

RECORD = (
    "stage string, data string, schema string, slots bigint, layout string, "
    "rows bigint, hash_sum string, hash_xor string"
)


def content_fingerprint(df: DataFrame) -> Row:
    """Row count and order-free content hash, from one aggregation.

    Each row is hashed as a text with its column names, in which a missing value
    and an empty one differ.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)
    added = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    crossed = F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(added.cast("decimal(28,0)")).cast("string"), F.lit("0")).alias("hash_sum"),
        F.coalesce(F.bit_xor(crossed).cast("string"), F.lit("0")).alias("hash_xor"),
    ).first()


def layout_seal(layout: DataFrame | None, index: str, key: str) -> dict:
    """``slots`` and ``layout`` of a completion record; both missing without a layout."""
    if layout is None:
        return {"slots": None, "layout": None}
    found = layout_fingerprint(layout, index, key).first()
    return {"slots": found["slots"], "layout": found["fingerprint"]} if found else {"slots": 0, "layout": ""}


def write_stage(df: DataFrame, path: str, name: str, seal: Mapping | None = None) -> DataFrame:
    """Write one stage and its completion record; returns the stored table.

    ``seal`` is the ``layout_seal`` of the slots the table refers to. A stage
    that is already complete is refused. Data of an attempt that never reached
    its completion record is ignored, not overwritten.
    """
    spark = df.sparkSession
    if read_completion(spark, path) is not None:
        raise FileExistsError(f"stage is already complete: {path}")
    data = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{data}")
    stored = spark.read.parquet(f"{path}/{data}")
    sealed = dict(seal or layout_seal(None, "", "")) | content_fingerprint(stored).asDict()
    fields = {"stage": name, "data": data, "schema": stored.schema.json(), **sealed}
    values = tuple(fields[c.split()[0]] for c in RECORD.split(", "))
    spark.createDataFrame([values], RECORD).write.mode("errorifexists").json(f"{path}/complete")
    return stored


def read_completion(spark: SparkSession, path: str) -> Row | None:
    try:
        return spark.read.json(f"{path}/complete", schema=RECORD).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_stage(spark: SparkSession, path: str, seal: Mapping | None = None) -> DataFrame:
    """The stage's table, after its content (and its layout, if given) has been checked."""
    record = read_completion(spark, path)
    if record is None:
        raise FileNotFoundError(f"stage is not complete: {path}")
    if seal is not None and any(record[f] != seal[f] for f in ("slots", "layout")):
        raise ValueError(f"stage was made for another slot layout: {path}")
    stored = spark.read.parquet(f"{path}/{record['data']}")
    found = content_fingerprint(stored)
    same = all(found[f] == record[f] for f in ("rows", "hash_sum", "hash_xor"))
    if not same or stored.schema.json() != record["schema"]:
        raise ValueError(f"stage content does not match its completion record: {path}")
    return stored


def resume_stage(
    spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame], seal: Mapping | None = None
) -> tuple[DataFrame, bool]:
    """Load a complete stage or build it; the flag tells whether it was loaded."""
    if read_completion(spark, path) is not None:
        return load_stage(spark, path, seal), True
    return write_stage(make(), path, name, seal), False


def stage_summary(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The completion records of several stages as one table."""
    found = {name: read_completion(spark, path) for name, path in paths.items()}
    absent = sorted(name for name, record in found.items() if record is None)
    if absent:
        raise FileNotFoundError(f"stages are not complete: {absent}")
    return spark.createDataFrame([tuple(r) for r in found.values()], RECORD)


def finalise(
    spark: SparkSession,
    paths: Mapping[str, str],
    index: str = "app_index",
    expected: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """All stages of long features as one table with a ``function`` column.

    Every stage is checked against its completion record, all must have been
    made for one slot layout, and every output must cover every slot exactly
    once. ``expected`` lists the intended ``(component_id, feature, operation)``
    per stage, so that an output that is absent altogether is found.
    """
    if not paths:
        raise ValueError("at least one stage is required")
    records = {name: read_completion(spark, path) for name, path in paths.items()}
    absent = sorted(name for name, record in records.items() if record is None)
    if absent:
        raise FileNotFoundError(f"stages are not complete: {absent}")
    seals = {(r["slots"], r["layout"]) for r in records.values()}
    if len(seals) > 1:
        raise ValueError(f"stages were made for different slot layouts: {sorted(paths)}")
    slots, layout = seals.pop()
    if layout is None:
        raise ValueError("the stages name no slot layout")
    bundles = []
    for name, path in paths.items():
        stored = load_stage(spark, path)
        listed = (expected or {}).get(name)
        gaps = coverage_check(stored, slots, listed, index).filter(~F.col("complete")).count()
        if gaps:
            raise ValueError(f"stage {name} does not cover every slot for {gaps} outputs")
        bundles.append(stored.select(F.lit(name).alias("function"), "*"))
    return reduce(DataFrame.unionByName, bundles)
