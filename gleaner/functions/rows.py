"""Row-making helpers that evaluate a costly expression once.

A plain ``explode`` makes the optimizer add size and null tests on its input and
push them down, and a filter on a computed column is pushed below the column:
both repeat the expression. The outer form is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, items: Column, name: str) -> DataFrame:
    """One row per non-null array entry."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def each_at(df: DataFrame, keep: list, items: Column, at: str, name: str) -> DataFrame:
    """One row per array entry with its place from 0."""
    return df.select(*keep, F.posexplode_outer(items).alias(at, name)).where(F.col(at).isNotNull())


def pin(df: DataFrame, keep: list, **cols: Column) -> DataFrame:
    """``keep`` and new columns, each computed once whatever later steps do with it."""
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select(*keep, made.alias("_pin")).select(*keep, "_pin.*")
