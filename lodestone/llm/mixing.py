"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source needs the hash threshold below which its documents add up to its budget.
Sums by (source, hash bucket) give the bucket in which the budget ends; only that bucket
is summed again by the next bits of the hash, and so on.  Documents are then taken by
comparing their hash with their source's threshold: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text_sql import word_count
from lodestone.operators.ranking import with_rank
from lodestone.scratch import materialize

WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own size.
MAX_EPOCHS = 3
#: Three levels of 10 bits: the last buckets hold a 2**30th of the hash range each.
LEVEL_BITS = 10
LEVELS = 3


def doc_hash(id_col: str, text_col: str) -> Column:
    """30 bits of the MD5 of id and text: reruns and other engines agree, and only rows equal in both go together.

    Texts of one id, or of none, are apart, so that the budget can end between them.
    """
    place = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    digits = F.substring(F.md5(place.cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long").bitwiseAND(F.lit((1 << (LEVEL_BITS * LEVELS)) - 1))


def targets(sources: DataFrame) -> DataFrame:
    """``(source, source_size)`` with ``weight`` and ``target``.

    Sources in code-point order, null last, weigh WEIGHTS, repeating.  Targets share the
    total by weight; what a source can't give within MAX_EPOCHS times its size goes to the
    others by weight, until none is above.  The driver holds two sums a round, never the
    sources.
    """
    last = F.col("source").isNull().alias("__last")
    ranked = with_rank(sources.select("*", last), ["__last", "source"], "__rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    held = materialize(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * MAX_EPOCHS
    total = held.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    left, share, level = total, None, F.lit(False)
    while True:
        open_ = held.where(~level).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
        left = total - (held.where(level).agg(F.sum(cap).alias("c")).first()["c"] or 0)
        share = open_["w"] or 0
        over = level | (cap * share < F.col("weight") * left) if share else F.lit(True)
        if not share or held.where(over).count() == held.where(level).count():
            break
        # a source over its cap stays over: what is left per weight only grows
        level = cap * share < F.col("weight") * left
    target = F.when(level, cap.cast("double")).otherwise(F.col("weight") * F.lit(left).cast("double") / F.lit(max(share, 1)))
    return held.withColumn("target", target.cast("double"))


def thresholds(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target, full, threshold)`` from rows ``(source, size, hash)``.

    A document is taken ``full`` times, and once more if its hash is below the threshold.
    The extra words are within the size of the documents in one last bucket of the budget.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    aim = targets(materialize(sums, "sums"))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(F.lit(0)).cast("long")
    aim = materialize(aim.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size")), "aim")
    # what is known so far: all hashes below `low` are within the budget, and `budget` is left for the bucket at `low`
    state = aim.select("source", F.lit(0).cast("long").alias("low"), "budget")
    for level in range(LEVELS):
        width = 1 << (LEVEL_BITS * (LEVELS - 1 - level))
        inside = sized.join(state, sized["source"].eqNullSafe(state["source"])).select(sized["source"], "size", "hash", "low", "budget")
        inside = inside.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + (width << LEVEL_BITS)))
        bucket = F.expr(f"(hash - low) div {width}L")
        cells = inside.groupBy("source", "low", "budget", bucket.alias("b")).agg(F.sum("size").alias("s"))
        upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = cells.withColumn("upto", F.sum("s").over(upto))
        # the first bucket that passes the budget; none: the budget takes all there is
        cut = summed.where(F.col("upto") > F.col("budget")).groupBy("source", "low", "budget").agg(F.min_by(F.struct("b", "s", "upto"), "b").alias("c"))
        found = cut.select(
            "source",
            (F.col("low") + F.col("c.b") * width).alias("low"),
            (F.col("budget") - (F.col("c.upto") - F.col("c.s"))).alias("budget"),
            F.col("c.s").alias("s"),
        )
        state = materialize(found, "level")
    # the last bucket goes in if that is nearer to the budget than leaving it out
    edge = state.select("source", (F.col("low") + F.when(F.col("budget") * 2 >= F.col("s"), F.lit(1)).otherwise(F.lit(0))).alias("edge"))
    joined = aim.join(edge, aim["source"].eqNullSafe(edge["source"]), "left")
    every = F.lit(1 << (LEVEL_BITS * LEVELS)).cast("long")
    out = joined.select(aim["source"], "source_size", "target", "full", F.coalesce("edge", F.when(F.col("budget") > 0, every).otherwise(F.lit(0))).alias("threshold"))
    return materialize(out, "mix")


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(sized, plan)``: the rows ``(id, source, size, hash)`` and the thresholds of the sources."""
    sized = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), doc_hash(id_col, text_col).alias("hash")), "sized")
    return sized, thresholds(sized)


def copies(plan: DataFrame, hash_: Column) -> Column:
    return plan["full"] + F.when(hash_ < plan["threshold"], F.lit(1)).otherwise(F.lit(0))


def mixed_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row: ``taken`` counts repeats.

    Null texts have size 0; rows without an id are told apart by their texts; a null source is a source of
    its own; an empty table gives an empty result.  The plan has a row for each source, so
    the join is broadcast when it is small and otherwise split where a source is hot.
    """
    sized, plan = plan_mix(df, id_col, text_col, source_col)
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["source"]))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies(plan, sized["hash"])).cast("long").alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it is taken, which may be none."""
    _, plan = plan_mix(df, id_col, text_col, source_col)
    hashed = df.withColumn("__hash", doc_hash(id_col, text_col))
    p = plan.select(F.col("source").alias("__source"), "full", "threshold").select("__source", F.col("full").alias("__full"), F.col("threshold").alias("__threshold"))
    n = F.col("__full") + F.when(F.col("__hash") < F.col("__threshold"), F.lit(1)).otherwise(F.lit(0))
    joined = hashed.join(p, hashed[source_col].eqNullSafe(p["__source"])).withColumn("__n", n.cast("int"))
    return joined.where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*df.columns)
