"""Sweeps against all pairs, over keys that go across partitions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, sweep

SPAN, POINT = "span_id long, k string, start long, end long", "p long, k string, t long"


def some(seed, n, keys):
    draw = random.Random(seed)
    spans = []
    for i in range(n):
        s = draw.randrange(60)
        spans.append((i, draw.choice(keys), s, s + draw.choice([0, 1, 3, 9, 30, 60])))
    spans += [(n + 1, "a", None, 9), (n + 2, "a", 1, None), (n + 3, None, 1, 50)]
    points = [(i, draw.choice([*keys, "none"]), draw.randrange(-2, 130)) for i in range(n)] + [(n, None, 3), (n + 1, "a", None)]
    return spans, points


def holds(spans, k, t):
    found = [(s, -e, i) for i, by, s, e in spans if None not in (by, s, e, k, t) and by == k and s <= t <= e]
    return max(found)[2] if found else None


def parent(spans, own):
    i, k, s, e = own
    if None in own:
        return None
    before = [(a, -b, j) for j, by, a, b in spans if None not in (by, a, b) and by == k and (a, -b, j) < (s, -e, i) and b >= e]
    return max(before)[2] if before else None


@pytest.mark.parametrize("partitions", [None, 7])
@pytest.mark.parametrize("keys", [["a"], ["a", "b", "c", "d", "e"]])
def test_sweeps_agree_with_all_pairs(spark, partitions, keys):
    spans, points = some(len(keys), 160, keys)
    s, p = spark.createDataFrame(spans, SPAN), spark.createDataFrame(points, POINT)
    got = {r["p"]: r["span_id"] for r in intervals.innermost(p, s, "k", "t", "p", partitions=partitions).collect()}
    assert got == {i: holds(spans, k, t) for i, k, t in points}
    tree = intervals.parents(s, "k", "span_id", partitions=partitions)
    up = {r["span_id"]: r["parent_id"] for r in tree.collect()}
    assert up == {x[0]: parent(spans, x) for x in spans}
    depth = {}

    def deep(i):
        if i not in depth:
            depth[i] = 1 + (deep(up[i]) if up[i] is not None else 0)
        return depth[i]

    assert {r["id"]: r["depth"] for r in intervals.depths(tree, "span_id", "parent_id").collect()} == {i: deep(i) for i in up}


def test_empty_tables(spark):
    s, p = spark.createDataFrame([], SPAN), spark.createDataFrame([(1, "a", 1)], POINT)
    assert intervals.innermost(p, s, "k", "t", "p").first()["span_id"] is None
    assert intervals.parents(s, "k", "span_id").count() == 0 and intervals.depths(intervals.parents(s, "k", "span_id"), "span_id", "parent_id").count() == 0


def test_a_key_of_many_nested_spans_is_no_pairs(spark):
    n = 100_000
    nested = spark.range(n).select(F.col("id").alias("span_id"), F.lit("hot").alias("k"), F.col("id").alias("start"), (3 * n - F.col("id")).alias("end"))
    stairs = spark.range(n).select((F.col("id") + n).alias("span_id"), F.lit("over").alias("k"), F.col("id").alias("start"), (F.col("id") + n).alias("end"))
    began = time.time()
    tree = intervals.parents(nested.unionByName(stairs), "k", "span_id", partitions=6)
    bad = tree.where(F.col("parent_id").eqNullSafe(F.when((F.col("k") == "hot") & (F.col("span_id") > 0), F.col("span_id") - 1)) == F.lit(False))
    assert bad.count() == 0
    plan = tree._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert time.time() - began < 60


def test_the_last_value_is_carried_over_partitions(spark):
    rows = [(k, k if k % 37 == 0 else None) for k in range(300)]
    got = sweep.carried(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], "v", "last").collect()
    assert all(r["last"] == r["k"] - r["k"] % 37 for r in got) and len(got) == 300


def test_a_cycle_has_no_depth(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (5, 4), (6, 99)], "id long, up long")
    assert {r["id"]: r["depth"] for r in intervals.depths(tree, "id", "up").collect()} == {1: None, 2: None, 3: None, 4: 1, 5: 2, 6: 1}
