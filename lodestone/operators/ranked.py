"""Resolution by priority, and filters that fall back to everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_resolve(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The best candidate of each key by ``order`` (priority first, then a unique tiebreak)."""
    best = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return candidates.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def filter_or_all(df: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """The rows of each key for which ``good`` holds; all of a key's rows where it holds for none.

    One aggregate and one join on the keys, both of which adaptive execution can split,
    rather than a window that would hold a whole key in one task.
    """
    marked = df.withColumn("__good", F.coalesce(good, F.lit(False)))
    some = marked.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.bool_or("__good").alias("__some"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = marked.join(some, same).drop(*[f"__k{i}" for i in range(len(keys))])
    return joined.where(F.col("__good") | ~F.col("__some")).drop("__good", "__some")


def first_then_rest(rows: DataFrame, first: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """``first``, and of ``rest`` what belongs to keys that ``first`` has no row for."""
    remaining = rows.select(key).join(first.select(key).distinct(), key, "left_anti").distinct()
    return first.unionByName(rest.join(remaining, key, "left_semi"))


def top_of_each(outer: DataFrame, inner: DataFrame, key: str, inner_key: str, order: list[Column], k: int) -> DataFrame:
    """Each row of ``outer`` with the first ``k`` rows of ``inner`` of its key, by ``order``: a correlated lateral join.

    The planner ranks ``inner`` within its keys before the two meet, so no more than k rows
    a key are joined.
    """
    return outer.lateralJoin(inner.where(F.col(inner_key) == F.col(key).outer()).orderBy(*order).limit(k))
