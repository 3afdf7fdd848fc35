"""Global order without a single-task window: range partition, number each part, add offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize

#: monotonically_increasing_id() puts the partition above this bit and the row's place below.
PART_BITS = 33
POS, PART = "__rank_pos", "__rank_part"


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(cut.withColumn(POS, F.monotonically_increasing_id()), "rank").withColumn(PART, F.shiftright(POS, PART_BITS))


def _offsets(parts: DataFrame, size: str) -> DataFrame:
    """One row for each partition, so the window and the broadcast are bounded by the partition count."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select(PART, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("__rank_before")))


def with_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's 0-based place in the total order by ``order`` (ascending, nulls first).

    One range shuffle and one table cut; each task numbers its own rows.  Rows equal
    in all of ``order`` are numbered in an arbitrary way, kept by the cut.
    """
    cut = _ranged(df, order)
    place = F.col(POS).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    parts = cut.groupBy(PART).agg(F.count(F.lit(1)).alias("__rank_n"))
    joined = cut.join(_offsets(parts, "__rank_n"), PART)
    return joined.withColumn(name, F.col("__rank_before") + place).drop(POS, PART, "__rank_before")


def with_prefix_sum(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Adds the sum of ``weight`` (a long) over all rows before this one in the order by ``order``."""
    cut = _ranged(df, order)
    inside = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(PART).agg(F.sum(weight).alias("__rank_n"))
    summed = cut.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)).cast("long"))
    joined = summed.join(_offsets(parts, "__rank_n"), PART)
    return joined.withColumn(name, F.col(name) + F.col("__rank_before")).drop(POS, PART, "__rank_before")
