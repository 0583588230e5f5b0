"""Categorical encoding: one-hot columns, category discovery, label codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from entityloom.operators.ordering import dense_index
from entityloom.plans.spec import CategoryShare


def categorical_columns(df: DataFrame) -> list[str]:
    """String columns are the categorical ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def discover_categories(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[str, ...]]:
    """Sorted distinct values of each column, from one pass that reads each row once.

    The driver receives one value per category, as each becomes a column.
    """
    columns = list(categorical_columns(df) if columns is None else columns)
    if not columns:
        return {}
    found = df.agg(*[F.collect_set(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: tuple(sorted(found[i])) for i, c in enumerate(columns)}


def one_hot(
    df: DataFrame, categories: Mapping[str, Sequence[str]], missing_category: bool = True
) -> tuple[DataFrame, list[str]]:
    """Replace each column by 0/1 columns; also returns the new column names.

    A missing-value column is always added when ``missing_category`` is set,
    also when no value is missing.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in categories]
    made: list[Column] = []
    names: list[str] = []
    for name, values in categories.items():
        wanted = list(values) + ([None] if missing_category else [])
        for value in wanted:
            alias = f"{name}_{'nan' if value is None else value}"
            made.append(F.col(f"`{name}`").eqNullSafe(F.lit(value)).cast("int").alias(alias))
            names.append(alias)
    return df.select(*kept, *made), names


def shares_of(
    categories: Mapping[str, Sequence[str]], prefix: str = "", missing: bool = True
) -> tuple[CategoryShare, ...]:
    """Share specs for discovered or frozen categories."""
    return tuple(CategoryShare(c, tuple(v), missing, prefix) for c, v in categories.items())


def label_codes(df: DataFrame, name: str, order: str) -> DataFrame:
    """``(value, code)`` numbered by first appearance in ``order``."""
    present = df.filter(F.col(name).isNotNull())
    first = present.groupBy(F.col(name).alias("value")).agg(F.min(order).alias("first_seen"))
    return dense_index(first, ["first_seen", "value"], "code").select("value", "code")


def label_encode(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Replace each column by its code by first appearance; missing becomes -1.

    Spark chooses by size how the code table meets the rows.
    """
    for name in columns:
        codes = label_codes(df, name, order)
        joined = df.join(codes, df[name] == codes["value"], "left")
        code = F.coalesce(F.col("code"), F.lit(-1).cast("bigint"))
        df = joined.select(*[code.alias(name) if c == name else df[c] for c in df.columns])
    return df
