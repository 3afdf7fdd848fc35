"""Recursion by semi-naive iteration: each round's step sees only the rows that were new in the round before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.scratch import materialize


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` cut as a table, and its number of rows, counted as they are written."""
    seen = Observation()
    cut = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return cut, seen.get["n"]


def _first(df: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: the least by its other columns."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__least")).select(*[F.col(c) if c in key else F.col(f"__least.{c}").alias(c) for c in df.columns])


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str] | None = None, rounds: int = 1000) -> DataFrame:
    """All rows that ``step`` leads to from ``seed``, each key once, the seed's included.

    ``step`` maps a table to one of the same columns.  ``key`` (by default all columns, as
    UNION has it) says which rows are the same; of such rows those of the earliest round
    stay, and of these the least.  Nulls are equal to each other.  Cycles end, since a round
    without new keys is the last.  A relation that hasn't ended after ``rounds`` rounds
    raises.  Each round is cut as a table and counted while it is written.
    """
    key = key or seed.columns
    front, n = _counted(_first(seed, key), "seed")
    seen, made = front, 0
    while n:
        if made == rounds:
            raise ValueError(f"no fixpoint after {rounds} rounds")
        new = _first(step(front).select(seed.columns), key)
        old = seen.select(*[F.col(c).alias(f"__old_{c}") for c in key])
        same = [F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in key]
        front, n = _counted(new.join(old, same, "left_anti"), "round")
        seen, made = seen.unionByName(front), made + 1
    return seen
