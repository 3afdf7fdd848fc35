"""Resolution and walks make no more rows on the way than go in and come out, and agree with their SQL on odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import registered, resolution
from tests.test_registered import rows


def most_rows(spark, run):
    """The largest number of rows that any step of ``run``'s executions put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, done = 0, store.executionsList()
    for k in range(before, done.size()):
        number = done.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                metric = metrics.apply(j)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    found = max(found, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return found


def test_many_parents_of_one_name(spark):
    n = 300
    ids = spark.range(n).select(F.format_string("s%04d", "id").alias("id"), F.lit("f").alias("file_path"), F.lit("n").alias("name"), F.lit("class").alias("kind"))
    raw = spark.range(n).select(F.lit("f").alias("file_path"), F.lit("n").alias("child_name"), F.lit("class").alias("child_kind"), F.col("id").alias("child_start_line"),
                                F.lit(0).alias("child_start_col"), F.lit("n").alias("parent_leaf"), F.lit("extends").alias("kind"))
    imports = spark.createDataFrame([], "importer_file_id string, imported_id string")
    got = []
    most = most_rows(spark, lambda: got.extend(resolution.resolve_inheritance(raw, ids, imports)[0].collect()))
    assert {(r[0], r[1]) for r in got} == {(f"s{k:04d}", "s0000" if k else "s0001") for k in range(n)} and len(got) == n
    assert most <= 2 * n


def test_repeated_imports_are_resolved_once(spark):
    n = 400
    raw = spark.range(n).select(F.lit("src/a.py").alias("file_path"), F.col("id").alias("position"), F.lit("pkg.mod").alias("raw_path"), F.lit("python").alias("language"), F.lit("use").alias("kind"))
    files = spark.createDataFrame([("src/a.py",), ("pkg/mod.py",)], "path string")
    got = []
    most = most_rows(spark, lambda: got.extend(resolution.resolve_imports(raw, files).collect()))
    assert [tuple(r) for r in got] == [("src/a.py", "pkg/mod.py")]
    assert most <= n


def test_many_classes_of_one_name(spark):
    n = 200
    classes = [(f"c{k}", "class", "T", f"g{k}", None, True) for k in range(n)]
    symbol = spark.createDataFrame([*classes, ("caller", "function", "run", "f", None, True), ("callee", "method", "m", "f", "c7", True), ("other", "function", "m", "f", None, True)],
                                   "id string, kind string, name string, file_path string, parent_id string, exported boolean")
    sites = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("caller").alias("caller_id"), F.lit("m").alias("callee_name"), F.lit("v").alias("receiver"), F.lit("f").alias("file_path"))
    empty = [spark.createDataFrame([], c) for c in ("name string, function_id string, type_id string", "symbol_id string, type_id string", "id string, display_name string")]
    imports, local = spark.createDataFrame([], "importer_file_id string, imported_id string"), spark.createDataFrame([("f", "v", "T")], "file_path string, name string, type_name string")
    got = []
    most = most_rows(spark, lambda: got.extend(resolution.resolve_calls(sites, symbol, imports, local, *empty).collect()))
    assert [tuple(r) for r in got] == [("caller", "callee", "f")]
    assert most <= 4 * n


def test_walks_through_a_dense_graph(spark):
    n = 60
    dense = spark.range(n).select(F.col("id").alias("src")).join(spark.range(n).select((F.col("id") + 30).alias("dst")))
    got = []
    most = most_rows(spark, lambda: got.extend(graph.reach_pairs(dense, 3).collect()))
    edges = {(a, b) for a in range(n) for b in range(30, n + 30) if a != b}
    two = {(a, c) for a, b in edges for b2, c in edges if b == b2 and a != c} - edges
    assert sorted(tuple(r) for r in got) == sorted([(a, b, 1) for a, b in edges] + [(a, b, 2) for a, b in two])
    assert most <= 2 * len(edges)


def odd_tables(folder, seed):
    """Orders and lines with repeated keys, repeated rows and nulls."""
    r = random.Random(seed)
    some = lambda *xs: r.choice(xs)
    orders = [(some(k, k, k, k - 5), some(None, *range(1, 140)), some("F", "O")) for k in range(5, 260)]
    orders += orders[:9]
    lines = [(r.randrange(5, 265), r.randrange(2000), some(*range(30), None), r.randrange(1, 8), float(r.randrange(1, 50))) for _ in range(900)]
    con = duckdb.connect()
    for name, columns, data in (
        ("orders", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR", orders),
        ("lineitem", "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE", lines),
        ("customer", "c_custkey BIGINT, c_nationkey INTEGER", [(k, r.randrange(25)) for k in range(400)]),
        ("part", "p_partkey BIGINT", [(k,) for k in range(300)]),
    ):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("name", ["q_resolve_inheritance", "q_inheritance_pairs", "q_resolve_imports", "q_resolve_namespaces", "q_resolve_calls"])
def test_odd_rows_agree_with_sql(spark, tmp_path, name):
    con = odd_tables(tmp_path, 4)
    ours, theirs = registered.QUERIES[name](spark, str(tmp_path)), con.sql(registered.ORACLES[name])
    got = rows(ours.columns, [tuple(r) for r in ours.collect()])
    assert got and got == rows(theirs.columns, theirs.fetchall())
