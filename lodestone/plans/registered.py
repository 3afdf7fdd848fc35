"""Registered queries: each exercises an operator of the library on the sample tables, beside the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.ids import fnv_hex
from lodestone.operators import graph, intervals, lookup, report
from lodestone.operators.anti import unshared
from lodestone.operators.dedupe import keep_first, keep_last
from lodestone.operators.fixpoint import fixpoint
from lodestone.operators.ranked import filter_or_all, first_then_rest, ranked_resolve, top_of_each
from lodestone.plans import hints, resolution
from lodestone.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def N() -> Column:
    return F.count(F.lit(1))


def micros(t) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(t) if isinstance(t, str) else t)

# --- aggregates, filters, sorts -------------------------------------------------------------


@registered("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_hist(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(N().alias("n")).orderBy(F.desc("n"))


@registered("SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def q_biggest(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars")).orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20)


@registered("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def q_bytes_vs_chars(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n_bytes"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@registered("SELECT d.doc_id, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (l.toxic = 1) AND NOT (l.quality = 0)")
def q_exclude_flags(spark, d):
    flags = table(spark, d, "labels").where("toxic <> 1 and quality <> 0").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(flags, "doc_id")


@registered("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND o_custkey IS NOT NULL GROUP BY 1, 2")
def q_in_lists(spark, d):
    some = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P") & F.col("o_custkey").isNotNull()
    return table(spark, d, "orders").where(some).groupBy("o_orderstatus", "o_orderpriority").agg(N().alias("n"))


@registered("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, count(*) AS n, CAST(sum(p_size + 1) AS BIGINT) AS s FROM part GROUP BY 1")
def q_case_arith(spark, d):
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, d, "part").groupBy(kind.alias("class")).agg(N().alias("n"), F.sum(F.col("p_size") + 1).cast("long").alias("s"))


@registered("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def q_distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@registered("SELECT count(*) AS total_rows, count(*) > 200 AS truncated, least(count(*), 200) AS shown FROM orders")
def q_envelope(spark, d):
    return table(spark, d, "orders").agg(N().alias("total_rows"), (N() > 200).alias("truncated"), F.least(N(), F.lit(200).cast("long")).alias("shown"))


@registered("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def q_grouping_sets(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("q_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM q_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")


@registered("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(N().alias("n"))


@registered("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(N().alias("n"))


@registered("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS plain FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10")
def q_filter_agg(spark, d):
    counted = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if(F.col("l_discount") == 0).alias("plain"), N().alias("n"))
    return counted.where("n > 10").drop("n")


@registered("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def q_distinct_agg(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), N().alias("n"))


@registered("SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def q_arg_min_max(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"))


@registered("SELECT l_returnflag, median(l_quantity) AS mid, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def q_quantiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("mid"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@registered("SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY o_custkey")
def q_string_agg(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["o_orderstatus"]), ",").alias("statuses"))


@registered("SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey < 10) AS low, count(*) FILTER (WHERE c_nationkey >= 10) AS high FROM customer GROUP BY c_mktsegment")
def q_pivot(spark, d):
    side = F.when(F.col("c_nationkey") < 10, "low").otherwise("high")
    return table(spark, d, "customer").withColumn("side", side).groupBy("c_mktsegment").pivot("side", ["low", "high"]).agg(N()).na.fill(0)


# --- joins ----------------------------------------------------------------------------------


@registered("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority AND p.o_orderkey <> o.o_orderkey)")
def q_anti_residual(spark, d):
    return unshared(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey")


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q_semi(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@registered("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_anti(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@registered("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q_left(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@registered("SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) s ON c.c_nationkey = s.s_nationkey")
def q_full(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 15").groupBy("c_nationkey").agg(N().alias("customers"))
    s = table(spark, d, "supplier").where("s_nationkey > 5").groupBy("s_nationkey").agg(N().alias("suppliers"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


@registered("SELECT DISTINCT p.p_partkey, p.p_name FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_name = 'Supplier#000000007'")
def q_callers(spark, d):
    one = table(spark, d, "supplier").where("s_name = 'Supplier#000000007'").select(F.col("s_suppkey").alias("l_suppkey"))
    edges = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(one, "l_suppkey").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, d, "part").select("p_partkey", "p_name").join(edges, "p_partkey")


@registered("SELECT DISTINCT s.s_suppkey, s.s_name FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE p.p_partkey = 11")
def q_callees(spark, d):
    edges = table(spark, d, "lineitem").where("l_partkey = 11").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(edges, "s_suppkey")


@registered("SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def q_three_way(spark, d):
    by = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(N().alias("n"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(by, "n_nationkey").select("r_name", "n_name", "n")


@registered("SELECT o.o_orderkey, max(e.event_id) AS event_id FROM orders o LEFT JOIN events e ON e.user_id = o.o_custkey AND e.event_id <= o.o_orderkey GROUP BY o.o_orderkey")
def q_asof(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    events = table(spark, d, "events").select("user_id", "event_id")
    return intervals.asof(orders, events, "o_orderkey", "event_id", ["event_id"], ["user_id"]).select("o_orderkey", "event_id")


SPANS_SQL = "SELECT event_id AS span_id, user_id, epoch_us(ts) AS s, epoch_us(lead(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS e FROM events WHERE event_type IN ('view', 'click')"


def spans(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    some = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return some.select(F.col("event_id").alias("span_id"), "user_id", micros("ts").alias("start"), F.lead(micros("ts"), 3).over(w).alias("end"))


@registered(f"""WITH sp AS ({SPANS_SQL}), p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
r AS (SELECT p.event_id, sp.span_id, row_number() OVER (PARTITION BY p.event_id ORDER BY sp.s DESC, sp.e, sp.span_id DESC) AS rn FROM p JOIN sp ON sp.user_id = p.user_id AND sp.s <= p.t AND p.t <= sp.e)
SELECT p.event_id, r.span_id FROM p LEFT JOIN r ON r.event_id = p.event_id AND r.rn = 1""")
def q_innermost(spark, d):
    points = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", micros("ts").alias("t"))
    return intervals.innermost(points, spans(spark, d), "user_id", "t", "event_id").select("event_id", "span_id")


NESTS_SQL = "SELECT event_id AS id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(value AS BIGINT) * 3600000000 AS e FROM events WHERE event_type = 'error'"


@registered(f"""WITH sp AS ({NESTS_SQL}), r AS (SELECT c.id, p.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY p.s DESC, p.e, p.id DESC) AS rn FROM sp c JOIN sp p ON p.user_id = c.user_id AND p.e >= c.e
AND (p.s < c.s OR (p.s = c.s AND (p.e > c.e OR (p.e = c.e AND p.id < c.id)))))
SELECT sp.id, r.parent_id FROM sp LEFT JOIN r ON r.id = sp.id AND r.rn = 1""")
def q_parent_nest(spark, d):
    return q_nests(spark, d).select("id", "parent_id")


def q_nests(spark, d):
    some = table(spark, d, "events").where("event_type = 'error'")
    start = micros("ts")
    # whole hours of the rounded value; DuckDB's cast rounds half to even, as rint does
    nests = some.select(F.col("event_id").alias("id"), "user_id", start.alias("start"), (start + F.rint("value").cast("long") * 3600000000).alias("end"))
    return intervals.parents(nests, "user_id", "id")


@registered(f"""WITH RECURSIVE sp AS ({NESTS_SQL}), r AS (SELECT c.id, p.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY p.s DESC, p.e, p.id DESC) AS rn FROM sp c JOIN sp p ON p.user_id = c.user_id AND p.e >= c.e
AND (p.s < c.s OR (p.s = c.s AND (p.e > c.e OR (p.e = c.e AND p.id < c.id))))),
tree AS (SELECT sp.id, sp.user_id, r.parent_id FROM sp LEFT JOIN r ON r.id = sp.id AND r.rn = 1),
d AS (SELECT id, user_id, CAST(1 AS BIGINT) AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.user_id, d.depth + 1 FROM tree t JOIN d ON t.parent_id = d.id)
SELECT user_id, max(depth) AS depth FROM d GROUP BY user_id""")
def q_nesting_depth(spark, d):
    nested = materialize(q_nests(spark, d).select("id", "user_id", "parent_id"), "nested")
    return nested.join(intervals.depths(nested, "id", "parent_id"), "id").groupBy("user_id").agg(F.max("depth").alias("depth"))


@registered("SELECT e.event_id, count(*) AS n FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts >= e.ts AND f.ts <= e.ts + INTERVAL 6 HOUR WHERE e.event_type = 'signup' GROUP BY e.event_id")
def q_interval_join(spark, d):
    # a range frame over one shuffle on the user instead of pairs
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.currentRow, 6 * 3600 * 1_000_000)
    counted = table(spark, d, "events").withColumn("us", micros("ts")).withColumn("n", F.count(F.lit(1)).over(w))
    return counted.where("event_type = 'signup'").select("event_id", "n")


# --- resolution -----------------------------------------------------------------------------


@registered("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_keep_last(spark, d):
    return keep_last(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@registered("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def q_first_local(spark, d):
    return keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@registered("""WITH c AS (SELECT DISTINCT o.o_orderkey, s.s_suppkey, CASE WHEN s.s_nationkey = c.c_nationkey THEN 1 WHEN ns.n_regionkey = nc.n_regionkey THEN 2 ELSE 3 END AS priority
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation nc ON nc.n_nationkey = c.c_nationkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey)
SELECT o_orderkey, s_suppkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, s_suppkey) AS rn FROM c) WHERE rn = 1""")
def q_ranked(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("c_region"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_region"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    priority = F.when(F.col("s_nationkey") == F.col("c_nationkey"), 1).when(F.col("s_region") == F.col("c_region"), 2).otherwise(3)
    return ranked_resolve(joined.select("o_orderkey", "s_suppkey", priority.alias("priority")), ["o_orderkey"], ["priority", "s_suppkey"])


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS has_r FROM lineitem) WHERE l_returnflag = 'R' OR NOT has_r")
def q_filter_or_all(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return filter_or_all(lines, ["l_orderkey"], F.col("l_returnflag") == "R")


@registered("""SELECT o_orderkey, l_suppkey, 'own' AS via FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45
UNION ALL SELECT o_orderkey, l_suppkey, 'any' AS via FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def q_self_then_fallback(spark, d):
    joined = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = joined.where("l_quantity > 45").select("o_orderkey", "l_suppkey", F.lit("own").alias("via"))
    rest = joined.select("o_orderkey", "l_suppkey", F.lit("any").alias("via"))
    return first_then_rest(joined, own, rest, "o_orderkey")


@registered("SELECT c.c_custkey, r.r_name || '.' || n.n_name || '.' || c.c_name AS qualified_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
def q_qname(spark, d):
    def rows(name, ident, parent, label):
        return table(spark, d, name).select(ident.alias("id"), parent.cast("string").alias("parent"), F.col(label).alias("name"))

    c, n, r = F.col("c_custkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("r_regionkey").cast("string")
    tree = rows("region", F.concat(F.lit("r"), r), F.lit(None), "r_name")
    tree = tree.unionByName(rows("nation", F.concat(F.lit("n"), n), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name"))
    tree = tree.unionByName(rows("customer", F.concat(F.lit("c"), c), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name"))
    names = intervals.qualified_names(tree, "id", "parent", "name", ".")
    return names.where("id like 'c%'").select(F.substring("id", 2, 20).cast("long").alias("c_custkey"), "qualified_name")


# --- graphs: a user's event follows another user's within the same hour -------------------------

EDGES_SQL = "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst"


def edges(spark, d) -> DataFrame:
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    e = table(spark, d, "events").select("ts", "event_id", F.col("user_id").alias("src"))
    return e.select("src", F.lead("src").over(w).alias("dst")).where("dst is not null and src <> dst").distinct()


@registered(f"SELECT dst AS node, count(*) AS fan_in FROM ({EDGES_SQL}) GROUP BY dst ORDER BY fan_in DESC, node LIMIT 20")
def q_hub(spark, d):
    return graph.hubs(edges(spark, d), 20)


@registered(f"WITH e AS ({EDGES_SQL}) SELECT i.node, i.fan_in, o.fan_out FROM (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY dst) i JOIN (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY src) o ON o.node = i.node WHERE i.fan_in >= 50 AND o.fan_out >= 50")
def q_god(spark, d):
    return graph.gods(edges(spark, d), 50, 50)


@registered(f"WITH e AS ({EDGES_SQL}) SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON y.src = x.dst AND y.dst = x.src WHERE x.src < x.dst")
def q_cycle2(spark, d):
    return graph.cycles2(edges(spark, d))


@registered(f"WITH e AS ({EDGES_SQL}) SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst")
def q_cycle3(spark, d):
    return graph.cycles3(edges(spark, d))


@registered(f"""WITH RECURSIVE e AS ({EDGES_SQL}), w AS (SELECT CAST(8 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 6)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def q_reach(spark, d):
    seed = spark.createDataFrame([(8,)], "node long")
    return graph.reach(edges(spark, d), seed, 6)


@registered(f"""WITH RECURSIVE e AS ({EDGES_SQL}), w AS (SELECT src AS origin, dst AS node, 1 AS depth FROM e UNION SELECT w.origin, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3 AND e.dst <> w.origin)
SELECT origin, node, min(depth) AS depth FROM w GROUP BY origin, node""")
def q_reach_pairs(spark, d):
    return graph.reach_pairs(edges(spark, d), 3)


# --- text -----------------------------------------------------------------------------------


@registered("WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) SELECT doc_id, w = 'the' AS is_the, count(*) AS n FROM t WHERE w IN ('the', 'of') GROUP BY 1, 2")
def q_refs_by_file(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    return words.where(F.col("w").isin("the", "of")).groupBy("doc_id", (F.col("w") == "the").alias("is_the")).agg(N().alias("n"))


@registered("SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'password') THEN 'password' WHEN contains(text, 'token') THEN 'token' WHEN contains(text, 'the') THEN 'the' END AS kind FROM documents")
def q_todo(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_marker(F.col("text"), ["License", "password", "token", "the"]).alias("kind"))


@registered("SELECT doc_id, len(list_filter(list_slice(regexp_split_to_array(text, '\\r?\\n'), 1, 20), lambda x: contains(x, 'License') OR contains(x, '###'))) > 0 AS generated FROM documents")
def q_generated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.in_first_lines(F.col("text"), ["License", "###"]).alias("generated"))


@registered("SELECT doc_id, source IN ('src1', 'src2') OR regexp_matches(ltrim(text), '^(The|Der|Los|///)') AS is_doc FROM documents")
def q_doc(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("source").isin("src1", "src2") | F.ltrim("text").rlike("^(The|Der|Los|///)")).alias("is_doc"))


URL_PATH_SQL = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/$', '')"


def url_path(url):
    return F.regexp_replace(F.regexp_extract(url, "^[a-z]+://[^/]+/([^?#]*)", 1), "/$", "")


@registered(f"SELECT page_id, regexp_extract({URL_PATH_SQL}, '[^/]*$') AS base, regexp_matches({URL_PATH_SQL}, '(^|/)en(/|$)') AS in_en, regexp_extract({URL_PATH_SQL}, '[^/]*$') IN ('index.html', '1.html') AS barrel FROM pages")
def q_classify_url(spark, d):
    path = url_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.basename(path).alias("base"), path.rlike("(^|/)en(/|$)").alias("in_en"), T.basename(path).isin("index.html", "1.html").alias("barrel"))


@registered("WITH t AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS position FROM t")
def q_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("position", "href")).select("page_id", "href", F.col("position").cast("long").alias("position"))


@registered(f"""WITH p AS (SELECT page_id, {URL_PATH_SQL} AS path FROM pages), k AS (SELECT DISTINCT path FROM p),
c AS (SELECT page_id, unnest(['nl/' || regexp_extract(path, '[^/]*$'), 'en/' || regexp_extract(path, '[^/]*$'), path]) AS candidate, unnest([0, 1, 2]) AS rank FROM p)
SELECT page_id, candidate AS resolved, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS rn FROM c JOIN k ON k.path = c.candidate) WHERE rn = 1""")
def q_resolve_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    base = T.basename(F.col("path"))
    candidates = F.array(F.concat(F.lit("nl/"), base), F.concat(F.lit("en/"), base), F.col("path"))
    return lookup.first_known(pages, ["page_id"], candidates, pages, "path")


@registered(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' || {URL_PATH_SQL} AS path FROM pages),
w AS (SELECT page_id, regexp_extract(path, '[^/]*$') AS key FROM p)
SELECT w.page_id, w.key, (SELECT min(p.path) FROM p WHERE p.path = w.key OR ends_with(p.path, '/' || w.key)) AS resolved FROM w""")
def q_suffix_lookup(spark, d):
    paths = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("/"), url_path(F.col("url"))).alias("path"))
    wanted = paths.select("page_id", T.basename(F.col("path")).alias("key"))
    return lookup.suffix_lookup(wanted, "key", paths)


@registered("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY 1, 2")
def q_tags(spark, d):
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(N().alias("n"))


@registered("""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace('Map<  ' || p_brand || ' ,' || p_type || '|x >', '\\s+', ' ', 'g')), '\\s*([<>\\[\\]()])\\s*', '\\1', 'g'), '\\s*,\\s*', ', ', 'g'), '\\s*([|&])\\s*', ' \\1 ', 'g'), '\\s+$', '')) AS t FROM part""")
def q_norm_type(spark, d):
    raw = F.concat(F.lit("Map<  "), "p_brand", F.lit(" ,"), "p_type", F.lit("|x >"))
    return table(spark, d, "part").select("p_partkey", F.trim(T.normalize_type(raw)).alias("t"))


@registered("SELECT p_partkey, regexp_extract(regexp_extract('pkg.mod::' || replace(p_brand, '#', '') || '<' || p_type || '>', '^([^<\\[]*)', 1), '([^.:]*)$', 1) AS bare, replace(p_brand, '#', '') AS leaf FROM part")
def q_bare_type(spark, d):
    display = F.concat(F.lit("pkg.mod::"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("<"), "p_type", F.lit(">"))
    return table(spark, d, "part").select("p_partkey", T.bare_type(display).alias("bare"), T.parent_leaf(display).alias("leaf"))


@registered("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents")
def q_line_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_slice(F.col("text"), 2, 4).alias("lines"))


@registered("""SELECT c_custkey, lower(printf('%016x', CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT))) AS h FROM (SELECT c_custkey, list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)],
list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, CAST(i AS INT), 1)) AS HUGEINT))), lambda a, x: ((xor(a, x) % 16777216) * 1099511628211 + ((xor(a, x) // 16777216) * 1099511628211 % 1099511627776) * 16777216) % 18446744073709551616) AS h FROM customer)""")
def q_fnv(spark, d):
    return table(spark, d, "customer").select("c_custkey", fnv_hex(F.col("c_name")).alias("h"))


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@registered("SELECT doc_id, upper(lang) AS u, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS p, split_part(source, 'c', 2) AS s, replace(lang, 'e', '3') AS r, position('r' IN source) AS i, substr(source, 2, 3) AS b FROM documents")
def q_strings(spark, d):
    i = F.instr("source", "r").cast("long")
    return table(spark, d, "documents").select("doc_id", F.upper("lang").alias("u"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("p"), F.split_part("source", F.lit("c"), F.lit(2)).alias("s"), F.replace("lang", F.lit("e"), F.lit("3")).alias("r"), i.alias("i"), F.substring("source", 2, 3).alias("b"))


@registered("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(extract('dow' FROM o_orderdate) AS BIGINT) AS dow, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS due FROM orders")
def q_dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).cast("long").alias("y"), (F.dayofweek(t) - 1).cast("long").alias("dow"), F.date_format(F.date_trunc("month", t), "yyyy-MM-dd").alias("m"), F.date_format(F.date_add(t, 40), "yyyy-MM-dd").alias("due"))


@registered("SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, p_size // 7 AS q, p_size % 7 AS m, greatest(p_size, 10) AS g, least(p_size, 10) AS l FROM part")
def q_math(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.abs(s - 25).alias("a"), F.floor(p).alias("f"), F.ceil(p).alias("c"), F.expr("cast(p_size div 7 as int)").alias("q"), (s % 7).alias("m"), F.greatest(s, F.lit(10)).alias("g"), F.least(s, F.lit(10)).alias("l"))


# --- findings -------------------------------------------------------------------------------

FINDINGS_SQL = "SELECT event_id AS ord, event_type AS review, CASE WHEN value < 5 THEN 'info' WHEN value < 15 THEN 'low' WHEN value < 40 THEN 'medium' ELSE 'high' END AS severity, 'u' || user_id AS file, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS INT) END AS line, props || '|' || chr(10) || 'x' AS message FROM events"


def findings(spark, d) -> DataFrame:
    v = F.col("value")
    severity = F.when(v < 5, "info").when(v < 15, "low").when(v < 40, "medium").otherwise("high")
    line = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("review"), severity.alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), line.alias("line"), F.concat("props", F.lit("|\nx")).alias("message"))


@registered(f"SELECT ord, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, review, file, ord) AS place FROM ({FINDINGS_SQL}) ORDER BY place LIMIT 100")
def q_findings_sort(spark, d):
    top = report.sort_findings(findings(spark, d)).limit(100)
    w = Window.orderBy(report.severity_rank(F.col("severity")), "review", "file", "ord")
    return top.select("ord", F.row_number().over(w).cast("long").alias("place"))


@registered(f"SELECT ord, '| ' || severity || ' | ' || file || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || ' | ' || replace(replace(message, '|', '\\|'), chr(10), ' ') || ' |' AS md FROM ({FINDINGS_SQL})")
def q_findings_md(spark, d):
    f = findings(spark, d)
    return f.select("ord", report.markdown_rows(f).alias("md"))


@registered(f"SELECT review, count(*) AS n, min(ord) AS first_ord FROM ({FINDINGS_SQL}) GROUP BY review")
def q_findings_group(spark, d):
    return report.group_findings(findings(spark, d))


# --- arrays, windows, sets, time --------------------------------------------------------------


@registered("SELECT vec_id, len(embedding) AS n FROM embeddings")
def q_array_len(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"))


@registered("SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has, list_distinct(list_filter(string_split(text, ' '), lambda x: x = 'of')) AS ofs FROM documents")
def q_array_contains(spark, d):
    words = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.array_contains(words, "the").alias("has"), F.array_distinct(F.filter(words, lambda x: x == "of")).alias("ofs"))


@registered("SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)")
def q_rank_family(spark, d):
    w = Window.partitionBy("user_id").orderBy("value")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    return table(spark, d, "events").select("event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), rn.cast("long").alias("rn"))


@registered("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.lead("event_id", 2).over(w).alias("next2"), F.first("event_id").over(w).alias("f"))


@registered("SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM lineitem")
def q_frames(spark, d):
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(-2, Window.currentRow)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(w).cast("long").alias("s"))


@registered("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer")
def q_ntile(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.ntile(4).over(w).cast("long").alias("q"))


def _users(spark, d, kind, least) -> DataFrame:
    return table(spark, d, "events").where((F.col("event_type") == kind) & (F.col("value") > least)).select("user_id")


@registered("SELECT user_id FROM events WHERE event_type = 'view' AND value > 40 UNION SELECT user_id FROM events WHERE event_type = 'click' AND value > 40")
def q_union(spark, d):
    return _users(spark, d, "view", 40).union(_users(spark, d, "click", 40)).distinct()


@registered("SELECT user_id FROM events WHERE event_type = 'view' AND value > 30 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 30")
def q_intersect(spark, d):
    return _users(spark, d, "view", 30).intersect(_users(spark, d, "click", 30))


@registered("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'click' AND value > 40")
def q_except(spark, d):
    return _users(spark, d, "view", -1e9).subtract(_users(spark, d, "click", 40))


@registered("""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t) SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def q_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = micros("ts")
    new = F.when(us - F.lag(us).over(w) <= 12 * 3600 * 1_000_000, 0).otherwise(1)
    marked = table(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(N().alias("n"))


@registered("SELECT event_type, epoch_us(date_trunc('day', ts)) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def q_tumbling(spark, d):
    day = F.window("ts", "1 day")["start"]
    return table(spark, d, "events").groupBy("event_type", micros(day).alias("day")).agg(N().alias("n"))


# --- recursion, lateral joins and other members of the dialect --------------------------------


@registered(f"""WITH RECURSIVE e AS ({EDGES_SQL}), w(node, parity) AS (SELECT CAST(8 AS BIGINT), 0 UNION SELECT e.dst, 1 - w.parity FROM w JOIN e ON e.src = w.node)
SELECT node, parity FROM w""")
def q_fixpoint(spark, d):
    steps = materialize(edges(spark, d), "edges").withColumnRenamed("src", "node")
    return fixpoint(spark.createDataFrame([(8, 0)], "node long, parity int"), lambda front: front.join(steps, "node").select(F.col("dst").alias("node"), (1 - F.col("parity")).alias("parity")))


@registered("SELECT o_orderkey, l.l_linenumber, l.l_extendedprice FROM orders, LATERAL (SELECT l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_extendedprice DESC, l_linenumber LIMIT 3) l")
def q_lateral_top(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    top = top_of_each(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)
    return top.select("o_orderkey", "l_linenumber", "l_extendedprice")


@registered("SELECT p_partkey, count(l_orderkey) AS n FROM lineitem RIGHT JOIN part ON p_partkey = l_partkey AND l_quantity > 48 GROUP BY p_partkey")
def q_right_join(spark, d):
    lines, part = table(spark, d, "lineitem").where("l_quantity > 48"), table(spark, d, "part")
    return lines.join(part, F.col("p_partkey") == F.col("l_partkey"), "right").groupBy("p_partkey").agg(F.count("l_orderkey").alias("n"))


@registered("SELECT p_partkey, p_name LIKE '%a%e%' AS named, p_size BETWEEN 10 AND 20 AS middle, nullif(p_size, 7) IS DISTINCT FROM nullif(p_partkey % 50, 7) AS other FROM part")
def q_predicates(spark, d):
    other = ~F.nullif("p_size", F.lit(7)).eqNullSafe(F.nullif(F.col("p_partkey") % 50, F.lit(7)))
    return table(spark, d, "part").select("p_partkey", F.col("p_name").like("%a%e%").alias("named"), F.col("p_size").between(10, 20).alias("middle"), other.alias("other"))


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 40")
def q_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(25)


@registered("""SELECT 'both' AS part, k, count(*) AS n FROM (SELECT o_custkey % 100 AS k FROM orders INTERSECT ALL SELECT c_custkey % 100 FROM customer) GROUP BY k
UNION ALL SELECT 'left' AS part, k, count(*) AS n FROM (SELECT o_custkey % 100 AS k FROM orders EXCEPT ALL SELECT c_custkey % 100 FROM customer) GROUP BY k""")
def q_all_sets(spark, d):
    left = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k"))
    right = table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("k"))
    both, rest = left.intersectAll(right).withColumn("part", F.lit("both")), left.exceptAll(right).withColumn("part", F.lit("left"))
    return both.unionByName(rest).groupBy("part", "k").agg(N().alias("n"))


@registered("SELECT event_type, count(*) AS n, count(TRY_CAST(split_part(props, ':', 2) AS BIGINT)) AS whole FROM events GROUP BY event_type")
def q_try_cast(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(N().alias("n"), F.count(F.split_part("props", F.lit(":"), F.lit(2)).try_cast("bigint")).alias("whole"))


@registered("""SELECT p_partkey, nth_value(p_partkey, 2) OVER w AS second, round(cume_dist() OVER w * 1000000) / 1000000 AS share FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)""")
def q_nth_cume(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.nth_value("p_partkey", 2).over(w).alias("second"), (F.round(F.cume_dist().over(w) * 1000000) / 1000000).alias("share"))


@registered("SELECT v.label, count(*) AS n FROM part JOIN (VALUES (1, 10, 'small'), (11, 30, 'middle'), (31, 99, 'large')) v(lo, hi, label) ON p_size BETWEEN v.lo AND v.hi GROUP BY v.label")
def q_values(spark, d):
    classes = spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (31, 99, "large")], "lo int, hi int, label string")
    return table(spark, d, "part").join(F.broadcast(classes), F.col("p_size").between(F.col("lo"), F.col("hi"))).groupBy("label").agg(N().alias("n"))  # three rows


# --- resolution and analyses over facts made of orders and their lines ------------------------

SYMBOLS = """SELECT 's' || o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 4 THEN 'field' ELSE 'method' END AS kind,
 CASE WHEN o_orderkey % 5 = 4 THEN 'v' || (o_orderkey % 9) ELSE 'n' || (o_orderkey % 211) END AS name,
 'f' || (o_custkey % 60) || '.n' || (o_orderkey % 211) AS qualified_name, 'f' || (o_custkey % 60) AS file_path,
 CASE WHEN o_orderkey % 5 > 1 THEN 's' || (o_orderkey - o_orderkey % 5) END AS parent_id, o_orderstatus <> 'F' AS exported FROM orders"""
SPANS = """SELECT 's' || o_orderkey AS entity_id, 'f' || (o_custkey % 60) AS file_path, CAST(o_orderkey % 1000 AS BIGINT) AS start_line,
 CAST(o_orderkey % 1000 + o_custkey % 200 AS BIGINT) AS end_line FROM orders"""
IMPORTS = """SELECT DISTINCT importer_file_id, imported_id FROM (SELECT 'f' || (l_suppkey % 60) AS importer_file_id, 'f' || ((l_suppkey * 7 + l_linenumber) % 60) AS imported_id FROM lineitem) AS e
 WHERE importer_file_id <> imported_id"""
SITES = """SELECT l_orderkey || '-' || l_linenumber AS id, 's' || l_orderkey AS caller_id, 'n' || (l_partkey % 211) AS callee_name,
 CASE l_linenumber WHEN 1 THEN 'self' WHEN 2 THEN 'this' WHEN 3 THEN 'v' || (l_suppkey % 9) WHEN 4 THEN 'v' || (l_partkey % 9) END AS receiver,
 'f' || (o_custkey % 60) AS file_path FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
LOCALS = "SELECT 'f' || (c_custkey % 60) AS file_path, 'v' || (c_nationkey % 9) AS name, 'n' || (c_custkey % 211) AS type_name FROM customer"
PARAMETERS = "SELECT 's' || o_orderkey AS function_id, 'v' || (o_custkey % 9) AS name, CASE WHEN o_orderkey % 5 <> 4 THEN 't' || (o_custkey % 211) END AS type_id FROM orders"
FIELDS = "SELECT 's' || o_orderkey AS symbol_id, 't' || (o_custkey % 211) AS type_id FROM orders WHERE o_orderkey % 5 = 4"
TYPES = "SELECT DISTINCT 't' || (p_partkey % 211) AS id, 'n' || (p_partkey % 211) AS display_name FROM part"
HEIRS = """SELECT 'f' || (o_custkey % 60) AS file_path, 'n' || (o_orderkey % 211) AS child_name, 'class' AS child_kind, CAST(o_orderkey AS BIGINT) AS child_start_line,
 CAST(l_linenumber AS BIGINT) AS child_start_col, 'n' || (l_partkey % 211) AS parent_leaf, CASE WHEN l_quantity < 25 THEN 'extends' ELSE 'implements' END AS kind
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def facts(spark: SparkSession, d: str, *relations: str) -> list[DataFrame]:
    """The relations above as DataFrames; their text means the same to Spark and to DuckDB."""
    out = []
    for sql in relations:
        for name in ("orders", "lineitem", "customer", "part"):
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
        used = {n: table(spark, d, n) for n in ("orders", "lineitem", "customer", "part") if f"{{{n}}}" in sql}
        if " JOIN " in sql:  # keys in order are few bytes as Parquet: never taken by these to be small enough for the driver
            used = {n: df.hint("merge") for n, df in used.items()}
        out.append(spark.sql(sql, **used))
    return out


HEIRS_RANKED = f"""found AS (SELECT c.id AS child_id, h.child_start_line, h.child_start_col, h.parent_leaf, h.kind, p.id AS parent_id,
  CASE WHEN p.file_path = h.file_path THEN 1 WHEN EXISTS (SELECT 1 FROM imp i WHERE i.importer_file_id = h.file_path AND i.imported_id = p.file_path) THEN 2 ELSE 3 END AS priority
  FROM ({HEIRS}) h JOIN sym c ON c.file_path = h.file_path AND c.name = h.child_name AND c.kind = h.child_kind JOIN sym p ON p.name = h.parent_leaf AND p.id <> c.id),
 best AS (SELECT *, row_number() OVER (PARTITION BY child_id, child_start_line, child_start_col, parent_leaf, kind ORDER BY priority, parent_id) AS place FROM found)"""


@registered(f"WITH sym AS ({SYMBOLS}), imp AS ({IMPORTS}), {HEIRS_RANKED} SELECT DISTINCT kind, child_id, parent_id FROM best WHERE place = 1")
def q_resolve_inheritance(spark, d):
    extends, implements = resolution.resolve_inheritance(*facts(spark, d, HEIRS, SYMBOLS, IMPORTS))
    some = implements.select(F.lit("implements").alias("kind"), F.col("impl_id").alias("child_id"), F.col("interface_id").alias("parent_id"))
    return extends.select(F.lit("extends").alias("kind"), "child_id", "parent_id").unionByName(some)


@registered(f"""WITH sym AS ({SYMBOLS}), imp AS ({IMPORTS}), {HEIRS_RANKED}, extends AS (SELECT DISTINCT child_id, parent_id FROM best WHERE place = 1 AND kind = 'extends')
 SELECT c.file_path, c.name AS child, p.name AS parent FROM extends e JOIN sym c ON c.id = e.child_id JOIN sym p ON p.id = e.parent_id""")
def q_inheritance_pairs(spark, d):
    return resolution.resolve_inheritance_pairs(*facts(spark, d, HEIRS, SYMBOLS, IMPORTS))


@registered(f"""WITH sym AS ({SYMBOLS}), imp AS ({IMPORTS}), callable AS (SELECT * FROM sym WHERE kind IN ('function', 'method')),
 owned AS (SELECT t.*, s.parent_id AS class_id FROM ({SITES}) t LEFT JOIN sym s ON s.id = t.caller_id),
 own AS (SELECT o.id AS site, o.caller_id, c.id AS callee_id, o.file_path FROM owned o JOIN callable c ON c.parent_id = o.class_id AND c.name = o.callee_name WHERE o.receiver IN ('self', 'this')),
 rest AS (SELECT * FROM owned WHERE id NOT IN (SELECT site FROM own)),
 candidate AS (SELECT r.id AS site, r.caller_id, c.id AS callee_id, c.parent_id, r.file_path FROM rest r JOIN callable c ON c.file_path = r.file_path AND c.name = r.callee_name
  UNION SELECT r.id, r.caller_id, c.id, c.parent_id, r.file_path FROM rest r JOIN imp i ON i.importer_file_id = r.file_path JOIN callable c ON c.file_path = i.imported_id AND c.name = r.callee_name AND c.exported),
 typed AS (SELECT * FROM rest WHERE receiver NOT IN ('self', 'this')),
 known AS (SELECT t.id, l.type_name FROM typed t JOIN ({LOCALS}) l ON l.file_path = t.file_path AND l.name = t.receiver
  UNION SELECT t.id, y.display_name FROM typed t JOIN ({PARAMETERS}) p ON p.function_id = t.caller_id AND p.name = t.receiver JOIN ({TYPES}) y ON y.id = p.type_id
  UNION SELECT t.id, y.display_name FROM typed t JOIN sym f ON f.parent_id = t.class_id AND f.name = t.receiver JOIN ({FIELDS}) g ON g.symbol_id = f.id JOIN ({TYPES}) y ON y.id = g.type_id),
 valid AS (SELECT DISTINCT k.id, c.id AS class_id FROM known k JOIN sym c ON c.name = k.type_name AND c.kind = 'class'),
 marked AS (SELECT c.*, v.id IS NOT NULL AS fits FROM candidate c LEFT JOIN valid v ON v.id = c.site AND v.class_id = c.parent_id),
 chosen AS (SELECT * FROM marked QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY site)),
 edge AS (SELECT caller_id, callee_id, file_path FROM own UNION ALL SELECT caller_id, callee_id, file_path FROM chosen)
 SELECT caller_id, callee_id, max(file_path) AS file_path FROM edge WHERE caller_id <> callee_id GROUP BY caller_id, callee_id""")
def q_resolve_calls(spark, d):
    return resolution.resolve_calls(*facts(spark, d, SITES, SYMBOLS, IMPORTS, LOCALS, PARAMETERS, FIELDS, TYPES))


@registered(f"SELECT id, kind, name, qualified_name, exported FROM ({SYMBOLS}) s WHERE file_path = 'f7' AND kind NOT IN ('parameter', 'variable', 'field')")
def q_declarations(spark, d):
    return hints.declarations(*facts(spark, d, SYMBOLS), "f7")


@registered(f"SELECT s.name, s.kind, p.file_path, start_line, end_line FROM ({SYMBOLS}) s JOIN ({SPANS}) p ON s.id = p.entity_id WHERE s.name = 'n42'")
def q_symbol_span(spark, d):
    return hints.symbol_span(*facts(spark, d, SYMBOLS, SPANS), "n42")


@registered(f"""SELECT s.name, p.file_path, end_line - start_line AS lines FROM ({SYMBOLS}) s JOIN ({SPANS}) p ON s.id = p.entity_id
 WHERE kind IN ('function', 'method') ORDER BY lines DESC, p.file_path, s.name LIMIT 20""")
def q_longest_functions(spark, d):
    return hints.longest_functions(*facts(spark, d, SYMBOLS, SPANS))


@registered(f"SELECT importer_file_id FROM ({IMPORTS}) i WHERE imported_id = 'f9'")
def q_who_imports(spark, d):
    return hints.who_imports(*facts(spark, d, IMPORTS), "f9")


OWN_FILE = """'src/d' || (o_custkey % 12) || '/m' || (o_orderkey % 40) || CASE o_orderkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.java' WHEN 3 THEN '.go' WHEN 4 THEN '.c' ELSE '.php' END"""
FILES = f"SELECT DISTINCT {OWN_FILE} AS path FROM orders"
#: An import of every line of an order, in the language of the order's file: x and y are the module and directory that it names.
#: Lines may share an order and a number, so positions hold both too.
RAW_IMPORTS = f"""SELECT file_path, position, language,
 CASE language WHEN 'typescript' THEN CASE form WHEN 0 THEN './m' || x WHEN 1 THEN '../d' || y || '/m' || x || '.js' ELSE 'react' END
  WHEN 'python' THEN CASE form WHEN 0 THEN 'd' || y || '.m' || x WHEN 1 THEN '.m' || x ELSE '..d' || y || '.m' || x END
  WHEN 'java' THEN CASE form WHEN 0 THEN 'src.d' || y || '.*' ELSE 'd' || y || '.m' || x END
  WHEN 'go' THEN CASE form WHEN 0 THEN 'example.org/src/d' || y ELSE 'fmt' END
  WHEN 'c' THEN CASE form WHEN 0 THEN 'm' || x || '.c' ELSE '../d' || y || '/m' || x || '.c' END
  ELSE CASE form WHEN 0 THEN 'D' || y || chr(92) || 'M' || x ELSE '../d' || y || '/m' || x || '.php' END END AS raw_path,
 CASE WHEN form = 0 THEN 'use' ELSE 'require' END AS kind, x, y, form, own
 FROM (SELECT {OWN_FILE} AS file_path, ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 40 + l_partkey % 40) * 12 + l_suppkey % 12 AS position, l_linenumber % 3 AS form, l_partkey % 40 AS x, l_suppkey % 12 AS y, o_custkey % 12 AS own,
 CASE o_orderkey % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 3 THEN 'go' WHEN 4 THEN 'c' ELSE 'php' END AS language
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS i"""


@registered(f"""WITH raw AS ({RAW_IMPORTS}), known AS ({FILES}),
 meant AS (SELECT file_path, position, CASE language
   WHEN 'typescript' THEN CASE form WHEN 0 THEN 'src/d' || own || '/m' || x || '.ts' WHEN 1 THEN 'src/d' || y || '/m' || x || '.ts' END
   WHEN 'python' THEN 'src/d' || (CASE form WHEN 1 THEN own ELSE y END) || '/m' || x || '.py'
   WHEN 'java' THEN CASE WHEN form <> 0 THEN 'src/d' || y || '/m' || x || '.java' END
   WHEN 'c' THEN 'src/d' || (CASE form WHEN 0 THEN own ELSE y END) || '/m' || x || '.c'
   WHEN 'php' THEN 'src/d' || y || '/m' || x || '.php' END AS path FROM raw),
 one AS (SELECT m.* FROM meant m JOIN known k ON k.path = m.path WHERE m.path <> m.file_path),
 anywhere AS (SELECT r.file_path, r.position, min(k.path) AS path FROM raw r JOIN known k ON split_part(k.path, '/', 3) = 'm' || r.x || '.c' AND k.path <> r.file_path
   WHERE r.language = 'c' AND r.form = 0 AND NOT EXISTS (SELECT 1 FROM one o WHERE o.file_path = r.file_path AND o.position = r.position) GROUP BY r.file_path, r.position),
 package AS (SELECT r.file_path, k.path FROM raw r JOIN known k ON split_part(k.path, '/', 2) = 'd' || r.y AND k.path <> r.file_path WHERE r.language IN ('go', 'java') AND r.form = 0)
 SELECT file_path AS importer_file_id, path AS imported_id FROM one UNION SELECT file_path, path FROM anywhere UNION SELECT file_path, path FROM package""")
def q_resolve_imports(spark, d):
    return resolution.resolve_imports(*facts(spark, d, RAW_IMPORTS, FILES))


@registered(f"""WITH known AS ({FILES}), ns AS (SELECT path, 'App.' || regexp_extract(path, 'd[0-9]+/m[0-9]+') AS name FROM known),
 wanted AS (SELECT DISTINCT file_path, 'App.d' || y || '/m' || x AS name FROM ({RAW_IMPORTS}) r)
 SELECT w.file_path AS importer_file_id, n.path AS imported_id FROM wanted w JOIN ns n ON n.name = w.name WHERE w.file_path <> n.path""")
def q_resolve_namespaces(spark, d):
    """Imports of namespaces: every file that declares one."""
    raw, files = facts(spark, d, RAW_IMPORTS, FILES)
    using = raw.select("file_path", "position", F.lit("csharp").alias("language"), F.format_string("App.d%d/m%d", "y", "x").alias("raw_path"), "kind")
    named = F.concat(F.lit("App."), F.regexp_extract("path", "d[0-9]+/m[0-9]+", 0))
    spaces = files.select(F.lit("csharp").alias("language"), F.lit("namespace").alias("kind"), named.alias("qualified_name"), F.col("path").alias("file_path"))
    return resolution.resolve_imports(using, files, spaces)
