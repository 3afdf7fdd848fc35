"""Fixpoints, lateral joins and the one-pass envelope."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators.fixpoint import fixpoint
from lodestone.operators.ranked import top_of_each
from lodestone.plans import guard


def test_pairs_over_cycles_and_nulls(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, None), (4, 4), (None, 5)]
    e = spark.createDataFrame(edges, "src int, dst int")
    step = lambda front: front.join(e, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))
    got = [tuple(r) for r in fixpoint(e.select(F.col("src").alias("origin"), F.col("dst").alias("node")), step).collect()]
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b is not None and b == c} - want:
        want |= more
    assert len(got) == len(set(got)) and set(got) == want
    assert fixpoint(e.where("false").select(F.col("src").alias("origin"), F.col("dst").alias("node")), step).count() == 0


def test_the_earliest_round_stays_and_endless_steps_raise(spark):
    seed = spark.createDataFrame([(0, "b"), (0, "a")], "n int, way string")
    grow = lambda front: front.where("n < 5").select((F.col("n") + 1).alias("n"), F.concat("way", F.lit("x")).alias("way"))
    assert {tuple(r) for r in fixpoint(seed, grow, ["n"]).collect()} == {(k, "a" + "x" * k) for k in range(6)}
    with pytest.raises(ValueError, match="no fixpoint after 3"):
        fixpoint(seed, grow, ["n"], rounds=3)


def test_lateral_top(spark):
    outer = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    inner = spark.createDataFrame([(1, x) for x in (5, 9, 7)] + [(2, 4), (None, 3)], "k2 int, x int")
    top = top_of_each(outer, inner, "k", "k2", [F.desc("x")], 2)
    assert sorted((r["k"], r["x"]) for r in top.collect()) == [(1, 7), (1, 9), (2, 4)]


def test_a_truncated_envelope_is_one_execution(spark):
    sc = spark.sparkContext
    sc.setJobGroup("envelope", "")
    made = guard.envelope(spark.range(1000, numPartitions=6).withColumn("twice", F.col("id") * 2).withColumn("twice_", F.col("twice")))
    assert made["total_rows"] == 1000 and made["truncated"] and made["rows"] == [[k, 2 * k, 2 * k] for k in range(200)]
    assert len(sc.statusTracker().getJobIdsForGroup("envelope")) == 1
    sc.setJobGroup("rest", "")
    ordered = guard.envelope(spark.sql("SELECT id, id FROM range(5000) ORDER BY id % 7, id DESC"), 3)
    assert ordered["rows"] == [[4998, 4998], [4991, 4991], [4984, 4984]] and ordered["total_rows"] == 5000
    assert guard.envelope(spark.range(0)) == {"headers": ["id"], "rows": [], "total_rows": 0, "truncated": False}


def test_aliases(spark):
    guard.register_aliases(spark)
    found = json.loads(guard.query(spark, "SELECT string_split('a.b', '.') AS s, regexp_full_match('abc', 'b') AS m, list_sort(list_distinct(array('b', 'a', 'b'))) AS l, strpos('abc', 'c') AS p, epoch_us(TIMESTAMP'1970-01-01 00:00:01') AS t"))
    assert found["rows"] == [[["a", "b"], False, ["a", "b"], 3, 1000000]]
