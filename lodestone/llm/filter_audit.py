"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Failure flags are counted once, by part.  A cube over the flags then has, in the row whose
kept flags are all false, the documents that pass just those filters: the survivors of
every subset of filters.  A step of an order lies between two subsets, so its figures are
differences of two such rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.text_sql import let, words
from lodestone.scratch import materialize

# Fixed values of the five filters.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"


def flags(text: Column) -> list[Column]:
    """Failures that a text alone decides: few words, few distinct words, many capitals, symbols."""
    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))

    known = let(words(text), counts)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        (known["n"] < LEAST_WORDS).alias("A"),
        (100 * known["distinct"] < LEAST_DISTINCT * known["n"]).alias("B"),
        (100 * capitals > MOST_CAPITALS * F.length(text)).alias("C"),
        text.rlike(SYMBOLS).alias("D"),
    ]


def cells(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(part, A, B, C, D, E, n, good, toxic)``: documents by part and failures, a bounded number of rows.

    E holds for a document if a smaller id has the same text.  Texts move as a digest; the
    copies of one text are summed by part before they meet, so a hot text is a few rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *flags(text))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(known, "doc_id", "left").select("doc_id", "part", "digest", *"ABCD", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    once = marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("n"))
    by = ["digest", "part", *"ABCD", "good", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = once.groupBy(*by).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = copies.withColumn("first", first).withColumn("plain", F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0)))
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("plain").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("plain")).alias("n")))
    each = firsts.select("part", *"ABCD", "good", "toxic", F.explode(both).alias("e")).select("part", *"ABCD", "e.E", "e.n", "good", "toxic")
    return each.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)`` for each part and each set of filters (bit k for filter k): what passes all of the set."""
    cube = counted.cube("part", *FILTERS).agg(F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"any_{f}") for f in FILTERS], *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # a flag that is summed over is outside the set; one that isn't must be false
    passing = reduce(lambda a, b: a & b, [(F.col(f"any_{f}") == 1) | ~F.col(f) for f in FILTERS], F.col("whole") == 0)
    mask = reduce(lambda a, b: a + b, [(1 - F.col(f"any_{f}")) * (1 << k) for k, f in enumerate(FILTERS)])
    some = cube.where(passing).select("part", mask.cast("int").alias("mask"), "n", "good", "toxic")
    every = counted.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return every.join(some, ["part", "mask"], "left").select("part", "mask", *zeros)


def steps(spark: SparkSession) -> DataFrame:
    """``(filter_order, step, filter, before, after, alone, others)``: each step of each order with the sets it lies between."""
    rows, whole = [], (1 << len(FILTERS)) - 1
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            own = 1 << FILTERS.index(name)
            rows.append(("".join(order), k + 1, name, before, before | own, own, whole ^ own))
            before |= own
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, alone int, others int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``kept`` and ``removed`` count documents after and at the step; ``redundant`` those that
    fail its filter and are gone already; ``unique_fails`` those that fail it alone;
    ``good_lost`` and ``toxic_lost`` the labelled among the removed; ``shapley`` what the
    filter removes in all orders together.

    A null text is empty, a null part the empty string.  A null id is smaller than none and
    none is smaller; rows of one id and text are no copies of each other.  Of several labels
    of one id, one that holds counts.  An empty table gives an empty result.
    """
    counted = materialize(cells(docs, labels, id_col, text_col, part_col), "cells")
    known = materialize(survivors(counted), "survivors")

    def at(step: str, name: str, columns: dict[str, str]) -> DataFrame:
        return known.select(F.col("part").alias(f"{name}_part"), F.col("mask").alias(f"{name}_mask"), *[F.col(k).alias(v) for k, v in columns.items()])

    def join(left: DataFrame, step: str, name: str, columns: dict[str, str]) -> DataFrame:
        right = at(step, name, columns)
        return left.join(right, (F.col("part") == F.col(f"{name}_part")) & (F.col(step) == F.col(f"{name}_mask"))).drop(f"{name}_part", f"{name}_mask")

    spark = docs.sparkSession
    now = known.select("part", F.col("mask").alias("before"), F.col("n").alias("n0"), F.col("good").alias("good0"), F.col("toxic").alias("toxic0")).join(steps(spark), "before")
    now = join(now, "after", "a", {"n": "n1", "good": "good1", "toxic": "toxic1"})
    whole = known.groupBy("part").agg(F.max("n").alias("total"), F.min("n").alias("left"))
    now = join(join(now, "alone", "o", {"n": "passing"}), "others", "r", {"n": "but_one"}).join(whole, "part")
    removed = F.col("n0") - F.col("n1")
    out = now.select(
        "part", "filter_order", "step", "filter", F.col("n1").alias("kept"), removed.alias("removed"),
        (F.col("total") - F.col("passing") - removed).alias("redundant"), (F.col("but_one") - F.col("left")).alias("unique_fails"),
        (F.col("good0") - F.col("good1")).alias("good_lost"), (F.col("toxic0") - F.col("toxic1")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
