"""Intervals: the innermost one that holds a point, parents by containment, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.sweep import latest_reaching
from lodestone.scratch import materialize


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, point_id: str, start: str = "start", end: str = "end", span_id: str = "span_id", partitions: int | None = None) -> DataFrame:
    """``points`` with ``span_id`` of the innermost span of the same ``by`` that holds the point, ends included.

    Innermost is the span that starts last, and among those the one that ends first, and
    then the greatest id.  One ordered sweep over points and spans, without pairs (see
    :mod:`lodestone.operators.sweep`); starts, ends and points are numbers of one type.
    Spans without a start or an end hold nothing.  Point ids are unique.
    """
    kinds = dict(points.dtypes) | dict(spans.dtypes)
    none = {c: F.lit(None).cast(kinds[c]) for c in (span_id, point_id, end)}
    pushed = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(by).alias("by"), F.col(start).alias("place"), F.lit(0).alias("asks"), (-F.col(end)).alias("fall"), F.col(span_id).alias("tie"),
        F.col(end).alias("end"), F.col(span_id).alias("span"), none[end].alias("ask"), none[point_id].alias("asker"),
    )
    asked = points.where(F.col(at).isNotNull()).select(
        F.col(by).alias("by"), F.col(at).alias("place"), F.lit(1).alias("asks"), none[end].alias("fall"), none[span_id].alias("tie"),
        none[end].alias("end"), none[span_id].alias("span"), F.col(at).cast(kinds[end]).alias("ask"), F.col(point_id).alias("asker"),
    )
    best = latest_reaching(pushed.unionByName(asked), ["place", "asks", "fall", "tie"], partitions)
    return points.join(best.select(F.col("asker").alias("__point"), F.col("span").alias(span_id)), F.col(point_id) == F.col("__point"), "left").drop("__point")


def parents(spans: DataFrame, by: str, span_id: str, start: str = "start", end: str = "end", partitions: int | None = None) -> DataFrame:
    """``spans`` with ``parent_id``: the innermost other span of the same ``by`` that contains it.

    Order is start ascending, end descending, id: of equal spans the earlier contains the later.
    One ordered sweep, in which every span asks before it is passed itself.  Ids are unique;
    a span without a start or an end neither contains nor is contained.
    """
    events = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(by).alias("by"), F.col(start).alias("place"), (-F.col(end)).alias("fall"), F.col(span_id).alias("tie"),
        F.col(end).alias("end"), F.col(span_id).alias("span"), F.col(end).alias("ask"), F.col(span_id).alias("asker"),
    )
    best = latest_reaching(events, ["place", "fall", "tie"], partitions).select(F.col("asker").alias("__child"), F.col("span").alias("parent_id"))
    return spans.join(best, F.col(span_id) == F.col("__child"), "left").drop("__child")


def depths(tree: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``(id, depth)``: how many rows a row's chain of parents has, itself included, by pointer doubling.

    A parent that isn't a row ends the chain, and so does a row that is its own parent.
    Rows on a longer cycle, or below one, have no root and so no depth: null.
    """
    now = tree.select(F.col(id_col).alias("id"), F.when(F.col(parent_col) != F.col(id_col), F.col(parent_col)).alias("up"), F.lit(1).cast("long").alias("depth"))
    before = None
    while True:
        above = now.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("depth").alias("__depth"))
        joined = now.join(above, F.col("up") == F.col("__id"), "left")
        now = materialize(joined.select("id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")), "depths")
        left = now.where(F.col("up").isNotNull()).count()
        if left in (0, before):
            return now.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
        before = left


def qualified_names(tree: DataFrame, id_col: str, parent_col: str, name_col: str, separator: Column | str) -> DataFrame:
    """``(id, qualified_name)``: names from the root down, by pointer doubling, so log(depth) joins at any depth.

    A row that is its own parent is a root.  Rows on a longer cycle, or below one, have no
    root and so no name: null.  They are told by a round that leaves as many rows open.
    """
    sep = F.lit(separator) if isinstance(separator, str) else separator
    now = tree.select(F.col(id_col).alias("id"), F.when(F.col(parent_col) != F.col(id_col), F.col(parent_col)).alias("up"), F.col(name_col).alias("name"), sep.alias("sep"))
    before = None
    while True:
        above = now.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("name").alias("__name"))
        joined = now.join(above, F.col("up") == F.col("__id"), "left")
        now = materialize(joined.select("id", F.col("__up").alias("up"), F.when(F.col("__id").isNull(), F.col("name")).otherwise(F.concat("__name", "sep", "name")).alias("name"), "sep"), "names")
        left = now.where(F.col("up").isNotNull()).count()
        if left in (0, before):
            return now.select("id", F.when(F.col("up").isNull(), F.col("name")).alias("qualified_name"))
        before = left


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str], by: list[str]) -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row of the same ``by`` at or before its time.

    A union and one window over it: a single shuffle on ``by``, no pairs.
    """
    tag = F.lit(1).alias("__left")
    l = left.select("*", F.col(left_time).alias("__t"), tag, *[F.lit(None).cast(right.schema[v].dataType).alias(f"__v{k}") for k, v in enumerate(values)])
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by]
    r = right.select(*by, *blank, F.col(right_time).alias("__t"), F.lit(0).alias("__left"), *[F.col(v).alias(f"__v{k}") for k, v in enumerate(values)])
    upto = Window.partitionBy(*by).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.when(F.col("__left") == 0, F.struct(*[f"__v{k}" for k in range(len(values))]))
    seen = l.unionByName(r).withColumn("__seen", F.last(packed, ignorenulls=True).over(upto)).where("__left = 1")
    return seen.select(*left.columns, *[F.col(f"__seen.__v{k}").alias(v) for k, v in enumerate(values)])
