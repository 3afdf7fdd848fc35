"""Ordered sweeps over keys of any size: the latest earlier row that reaches far enough.

Rows are range-partitioned by key and order, and each task keeps one stack of the spans it
has passed.  A span whose end lies before that of a later one is never asked for again, so
ends fall from the bottom of the stack to its top: pushing is amortised, asking is a
binary search, and a key of n rows costs n log n however they nest or overlap.

A key may go over several partitions.  What a partition can't answer for its first key is
asked of the nearest earlier partition that reaches far enough, told by one row a
partition; there the stack that was left open answers, by one more ordered pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodestone.operators.ranking import PART, POS, _ranged
from lodestone.scratch import materialize

FOUND, OPEN, STACK = 0, 1, 2


def carried(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that isn't null at or before each row in the order by ``order``.

    As ranks are: range partitions, a window inside each, and one row a partition handed on.
    """
    cut = _ranged(df, order)
    upto = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = cut.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    lasts = cut.groupBy(PART).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(POS))).alias("__last"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    handed = F.broadcast(lasts.select(PART, F.last("__last", ignorenulls=True).over(before).alias("__before")))
    return here.join(handed, PART).withColumn(name, F.coalesce(name, "__before")).drop(POS, PART, "__before")


def _passes(events: DataFrame, kinds: dict[str, S.DataType]) -> DataFrame:
    """``(kind, part, by, at, end, asker, span)`` of ordered partitions: answers, what stays open, and stacks left."""
    schema = S.StructType([S.StructField("kind", S.IntegerType()), S.StructField("part", S.IntegerType()), S.StructField("by", kinds["by"]), S.StructField("at", S.LongType()), S.StructField("end", kinds["end"]), S.StructField("asker", kinds["asker"]), S.StructField("span", kinds["span"])])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, now, falls, spans = True, None, [], []
        types = None
        for batch in batches:
            types = [pa.int32(), pa.int32(), batch.schema.field("by").type, pa.int64(), batch.schema.field("end").type, batch.schema.field("asker").type, batch.schema.field("span").type]
            out = []
            for by, end, ask, asker, span in zip(*[batch.column(c).to_pylist() for c in ("by", "end", "ask", "asker", "span")]):
                if by != now:
                    first, now, falls, spans = now is None, by, [], []
                if ask is not None:
                    k = bisect_right(falls, -ask)
                    if k:
                        out.append((FOUND, part, by, None, ask, asker, spans[k - 1]))
                    elif first:
                        out.append((OPEN, part, by, None, ask, asker, None))
                if end is not None:
                    while falls and falls[-1] > -end:
                        falls.pop()
                        spans.pop()
                    falls.append(-end)
                    spans.append(span)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        for at in range(0, len(spans), 10_000):
            some = [(STACK, part, now, at + k, -f, None, s) for k, (f, s) in enumerate(zip(falls[at : at + 10_000], spans[at : at + 10_000]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)

    return events.mapInArrow(run, schema)


def latest_reaching(events: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``(asker, span)``: for every row that asks, the last row before it, of the same ``by``, that reaches it.

    ``events`` has ``by``, the columns ``order``, ``end`` and ``span`` of rows that can be
    found, ``ask`` and ``asker`` of rows that ask; a row may do both and doesn't find
    itself.  A row reaches what asks for its ``end`` or less.  ``end`` and ``ask`` are
    numbers of one type.  Rows without ``by`` find nothing, and who finds nothing is left
    out.  The order must be total, or equal rows may be found in either order.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    plain = events.where(F.col("by").isNotNull())
    by = ["by", *order]
    ranged = plain.repartitionByRange(partitions, *by) if partitions else plain.repartitionByRange(*by)
    made = materialize(_passes(ranged.sortWithinPartitions(*by).select("by", "end", "ask", "asker", "span"), kinds), "sweep")
    found = made.where(F.col("kind") == FOUND).select("asker", "span")
    # how far each partition's stack reaches: its lowest entry; one row a partition
    reach = made.where((F.col("kind") == STACK) & (F.col("at") == 0)).groupBy("by").agg(F.sort_array(F.collect_list(F.struct("part", "end"))).alias("reach"))
    open_ = made.where(F.col("kind") == OPEN).select("by", F.col("part").alias("__own"), F.col("end").alias("ask"), "asker").join(F.broadcast(reach), "by")
    nearest = F.try_element_at(F.filter("reach", lambda r: (r["part"] < F.col("__own")) & (r["end"] >= F.col("ask"))), F.lit(-1))
    routed = materialize(open_.select(nearest["part"].alias("part"), "ask", "asker").where("part is not null"), "open")
    if routed.isEmpty():
        return found
    stack = made.where(F.col("kind") == STACK)
    # ends fall while a stack is climbed: the last entry before a question, by falling ends, is the highest that reaches it
    entries = stack.select("part", (-F.col("end")).alias("fall"), F.lit(0).alias("asks"), "at", "span", F.lit(None).cast(kinds["asker"]).alias("asker"))
    asked = routed.select("part", (-F.col("ask")).alias("fall"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("at"), F.lit(None).cast(kinds["span"]).alias("span"), "asker")
    answered = carried(entries.unionByName(asked), ["part", "fall", "asks", "at"], "span", "__span")
    return found.unionByName(answered.where("asks = 1").select("asker", F.col("__span").alias("span")))
