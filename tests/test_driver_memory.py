"""What is small as Parquet and large as rows doesn't go through the driver, and walks shuffle few rows."""

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import resolution


def metric_of(spark, run, node, name):
    """The largest value of a metric in ``run``'s executions, of nodes of one name or of all."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, done = 0, store.executionsList()
    for k in range(before, done.size()):
        number = done.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics() if node in (None, nodes.apply(i).name()) else None
            for j in range(metrics.size() if metrics else 0):
                metric = metrics.apply(j)
                if metric.name() == name and values.contains(metric.accumulatorId()):
                    found = max(found, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return found


def test_what_files_inherit_is_not_broadcast(spark):
    n, before = 20_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    symbol = spark.range(200).select(F.format_string("s%04d", "id").alias("id"), F.lit("f").alias("file_path"), F.format_string("n%d", F.col("id") % 100).alias("name"), F.lit("class").alias("kind"))
    raw = spark.range(n).select(F.lit("f").alias("file_path"), F.format_string("n%d", F.col("id") % 100).alias("child_name"), F.lit("class").alias("child_kind"),
                                F.format_string("n%d", F.floor(F.col("id") / 100) % 100).alias("parent_leaf"), F.when(F.col("id") < n / 2, "extends").otherwise("implements").alias("kind"))
    imports, got = spark.createDataFrame([], "importer_file_id string, imported_id string"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        most = metric_of(spark, lambda: got.extend(len(df.collect()) for df in resolution.resolve_inheritance(raw, symbol, imports)), "BroadcastExchange", "number of output rows")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [n, n]  # two classes of each name, a hundred parents each
    assert most < 1000


def test_walks_do_not_shuffle_a_row_for_each_edge_and_block(spark):
    n, degree, held = 1500, 20, {}
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("k")).select("src", F.pmod(F.col("src") + F.col("k") * 37, F.lit(n)).alias("dst"))
    for name, value in (("spark.sql.shuffle.partitions", "32"), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        held[name] = spark.conf.get(name)
        spark.conf.set(name, value)
    got = []
    try:
        moved = metric_of(spark, lambda: got.append(graph.reach_pairs(ring, 2).groupBy("depth").count().collect()), None, "shuffle records written")
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    assert {r["depth"]: r["count"] for r in got[0]} == {1: n * degree, 2: n * degree}  # steps of 1 to 20, then of 21 to 40
    assert moved <= 1.2 * n * degree
