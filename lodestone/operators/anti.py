"""Anti joins with a residual, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unshared(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Rows whose key occurs with no other ``ident``: NOT EXISTS (same key, different ident).

    The least and greatest ident of a key tell, so it is one partial aggregate and an
    equi join, where the correlated form would compare all rows of a key with each other.
    """
    ends = df.groupBy(*keys).agg(F.min(ident).alias("__lo"), F.max(ident).alias("__hi"))
    lone = ends.where(F.col("__lo") == F.col("__hi")).select(*keys)
    return df.join(lone, keys, "left_semi")
