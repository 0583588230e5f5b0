"""Table readers: typed or all-string CSV, Parquet, row-limited scans, appends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T


def require_columns(df: DataFrame, required: Iterable[str], label: str = "input") -> DataFrame:
    """Fail before planning when a column is absent; returns ``df`` unchanged."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
    return df


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV scan by header name; types are declared, never inferred.

    Columns are matched by name, so the declared schema may list a subset of
    the file's columns, in any order; only those are converted.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = read_csv_text(spark, path)
    require_columns(text, wanted.fieldNames(), path)
    return text.select(*[text[f"`{f.name}`"].try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV scan; a leading byte-order mark is dropped from the header."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[name.lstrip("\ufeff") for name in df.columns])


def read_table(
    spark: SparkSession, folder: str, table: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """``<table>.parquet`` if there is one, else ``<table>.csv``.

    A CSV without a declared schema has its types inferred by a full pass of
    its own; for repeated use store it as Parquet once (``store_parquet``).
    """
    try:
        return read_parquet(spark, folder, table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    path = f"{folder}/{table}.csv"
    if schema is not None:
        return read_csv(spark, path, schema)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.toDF(*[name.lstrip("\ufeff") for name in df.columns])


def store_parquet(spark: SparkSession, source: str, target: str, table: str) -> DataFrame:
    """Convert one CSV table to Parquet; an existing target is refused."""
    path = f"{target}/{table}.parquet"
    read_table(spark, source, table).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def first_rows(df: DataFrame, order: Iterable[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in an explicit order; 0 means all rows."""
    return df if limit <= 0 else df.orderBy(*order).limit(limit)


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag union by name; a column only one side has is missing on the other."""
    return left.unionByName(right, allowMissingColumns=True)


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a target and rows without one."""
    return df.filter(df[target].isNotNull()), df.filter(df[target].isNull())
