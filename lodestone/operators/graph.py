"""Directed graphs as edge tables ``(src, dst)``: degrees, short cycles, bounded walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.fixpoint import fixpoint
from lodestone.operators.ranking import with_rank
from lodestone.scratch import materialize


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with most edges into them."""
    return fan_in(edges).orderBy(F.desc("fan_in"), F.asc_nulls_last("node")).limit(k)


def gods(edges: DataFrame, least_in: int, least_out: int) -> DataFrame:
    """Nodes that many others use and that use many others."""
    joined = fan_in(edges).join(fan_out(edges), "node")
    return joined.where((F.col("fan_in") >= least_in) & (F.col("fan_out") >= least_out))


def cycles2(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, with edges both ways: an aggregate on the unordered pair instead of a self join."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    both = pair.groupBy("a", "b").agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d"))
    return both.where("u and d").select("a", "b")


def cycles3(edges: DataFrame) -> DataFrame:
    """Triangles a -> b -> c -> a, each once, from its least node."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    first = e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    second = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    third = e.where("src > dst").select(F.col("src").alias("c"), F.col("dst").alias("a"))
    return first.join(second, "b").where("c > a and c <> b").join(third, ["c", "a"]).select("a", "b", "c")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)``: nodes within ``depth`` steps of the seeds, at their least depth.

    A fixpoint with the node as key: each round joins only nodes that are new, so work
    follows distinct nodes, never paths.
    """
    edges = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "edges")

    def step(front: DataFrame) -> DataFrame:
        return front.where(F.col("depth") < depth).join(edges, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(seeds.select("node", F.lit(0).alias("depth")), step, ["node"], depth + 1)


#: Longs of a row's bitmap in ``reach_pairs``: a row stands for 64 times as many nodes.
WORDS = 16
#: About as many edges into a node are one row.
INTO = 1024
#: Rows of a level from which on the next is made in parts, one after the other, and the most parts.
PART, PARTS = 500_000, 8


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _mapped(pairs: DataFrame) -> DataFrame:
    """``(origin, block, w0, w1, ...)``: the numbers ``place`` that each origin has, as bits."""
    word = F.shiftright("place", 6).bitwiseAND(F.lit(WORDS - 1))
    bits = [F.bit_or(F.when(word == k, _bit(F.col("place"))).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return pairs.groupBy("origin", F.floor(F.col("place") / (64 * WORDS)).alias("block")).agg(*bits)


def _stepped(front: DataFrame, seen: DataFrame, into: DataFrame, names: list[str]) -> DataFrame:
    """What the sources of edges to ``front``'s origins reach by these and haven't in ``seen``.

    Blocks don't depend on each other, so all rows of a block go to one task, each with its
    edges as an array: a row for each edge is made there and added up, and never shuffled.
    """
    met = front.join(into.hint("merge"), F.col("origin") == F.col("dst")).select("block", "sources", F.lit(False).alias("old"), *names)
    old = seen.select("block", F.array("origin").alias("sources"), F.lit(True).alias("old"), *names)
    each = met.unionByName(old).repartition("block").select("block", F.explode("sources").alias("origin"), "old", *names)
    summed = each.groupBy("block", "origin", "old").agg(*[F.bit_or(w).alias(w) for w in names])
    now = [F.bit_or(F.when(~F.col("old"), F.col(w))).alias(w) for w in names]
    before = [F.coalesce(F.bit_or(F.when(F.col("old"), F.col(w))), F.lit(0).cast("long")).alias(f"old_{w}") for w in names]
    both = summed.groupBy("block", "origin").agg(*now, *before).where(F.col(names[0]).isNotNull())
    new = both.select("origin", "block", *[F.col(w).bitwiseAND(F.bitwise_not(F.col(f"old_{w}"))).alias(w) for w in names])
    return new.where(reduce(lambda a, b: a | b, [F.col(w) != 0 for w in names]))


def reach_pairs(edges: DataFrame, depth: int) -> DataFrame:
    """``(origin, node, depth)`` for all origins: the same walk keyed by (origin, node); polynomial, not one row a path.

    Nodes are numbered, and what an origin reaches is kept as bits, a row for each block of
    numbers with any.  A step moves each such row once, with the edges into its origin.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    nodes = materialize(with_rank(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), ["node"], "place"), "nodes")
    words = nodes.groupBy(F.shiftright("place", 6).alias("word")).agg(F.sort_array(F.collect_list(F.struct("place", "node")))["node"].alias("nodes"))  # 64 at most
    of = words.groupBy(F.floor(F.col("word") / WORDS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("word", "nodes")))["nodes"].alias("parts"))
    names = [f"w{k}" for k in range(WORDS)]
    most = e.groupBy("dst").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()["most"]
    chunk = F.pmod(F.xxhash64("src"), F.lit(-(-most // INTO) or 1))
    into = materialize(e.groupBy("dst", chunk).agg(F.collect_list("src").alias("sources")).select("dst", "sources"), "into")
    own = _mapped(nodes.select(F.col("node").alias("origin"), "place"))
    front = materialize(_mapped(e.select(F.col("src").alias("origin"), F.col("dst").alias("node")).join(nodes, "node")), "level")
    levels = [front]
    for _ in range(2, depth + 1):
        rows = front.count()
        if not rows:
            break
        seen, parts = reduce(DataFrame.unionByName, [own, *levels]), max(1, min(PARTS, -(-rows // PART)))
        shares = [[df.where(F.pmod("block", F.lit(parts)) == k) for df in (front, seen)] for k in range(parts)]
        front = reduce(DataFrame.unionByName, [materialize(_stepped(*share, into, names), "level") for share in shares])
        levels.append(front)

    each = reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels, 1)])
    some = each.join(of, "block").select("origin", "depth", "parts", F.posexplode(F.array(*names)).alias("k", "bits")).where("bits <> 0")
    asked = some.select("origin", "depth", "bits", F.posexplode(F.get("parts", F.col("k"))).alias("at", "node"))
    return asked.where(F.call_function("shiftright", F.col("bits"), F.col("at")).bitwiseAND(F.lit(1)) == 1).select("origin", "node", "depth")
