"""Keeping one row of each key by an explicit order (never ``dropDuplicates``, whose survivor is arbitrary)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order``: the primary-key rule of the fact tables."""
    return _one(df, key, [F.col(c).desc_nulls_last() for c in order])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first in ``order``: first assignment wins."""
    return _one(df, key, [F.col(c).asc_nulls_last() for c in order])
