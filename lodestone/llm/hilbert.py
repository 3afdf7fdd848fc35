"""Sharding along a Hilbert curve through several metadata dimensions (DataFrame functions only).

Each dimension is quantised to equal-depth codes from its whole value histogram, the
codes give a place on a Hilbert curve, rows are put in the order of (place, id) and the
order is cut into runs.  Neighbouring rows agree in all dimensions at once, so the
min/max statistics of each run's files prune on any of them.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import with_prefix_sum, with_rank
from lodestone.scratch import materialize


@cache
def curve_automaton(dims: int) -> tuple[list[int], list[int]]:
    """Transition tables of the Hilbert curve in ``dims`` dimensions.

    A state is (entry corner, direction).  Given a state and the next bit of every
    coordinate, the tables at ``state * 2**dims + bits`` hold the next ``dims`` bits of
    the place on the curve, and the state of the sub-cube.
    """
    side, full = 1 << dims, (1 << dims) - 1

    def spin(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & full

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ungray(g: int) -> int:
        i = 0
        while g:
            i ^= g
            g >>= 1
        return i

    def trailing_ones(i: int) -> int:
        n = 0
        while i & 1:
            n, i = n + 1, i >> 1
        return n

    def corner(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def axis(i: int) -> int:
        return 0 if i == 0 else trailing_ones(i if i & 1 else i - 1) % dims

    out, then = [], []
    for state in range(side * dims):
        entry, way = divmod(state, dims)
        for bits in range(side):
            w = ungray(spin(bits ^ entry, -(way + 1)))
            out.append(w)
            then.append((entry ^ spin(corner(w), way + 1)) * dims + (way + axis(w) + 1) % dims)
    return out, then


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of non-negative integer coordinates of ``bits`` bits each."""
    dims = len(codes)
    out, then = (F.array(*map(F.lit, t)) for t in curve_automaton(dims))

    def step(acc: Column, power: Column) -> Column:
        digit = reduce(lambda a, b: a + b, [F.expr("0")] + [F.when(c.bitwiseAND(power) != 0, F.lit(1 << d)).otherwise(F.lit(0)) for d, c in enumerate(codes)])
        at = acc["state"] * (1 << dims) + digit
        return F.struct(F.get(then, at).alias("state"), (acc["h"] * (1 << dims) + F.get(out, at)).cast("long").alias("h"))

    powers = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(powers, start, step, lambda acc: acc["h"])


def equal_depth_codes(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """``(dim, num, str, code)``: for each value of each dimension its equal-depth code.

    The code of a value is the share of rows below its middle, in units of 2**-bits, from
    exact counts over all rows.  Numbers sort as numbers and everything else as strings;
    null is a value of its own, before the others.
    """
    number = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = dict(df.dtypes)
    cells = [
        F.struct(
            F.lit(d).alias("dim"),
            (F.col(c) if types[c] in number else F.lit(None)).cast("double").alias("num"),
            (F.lit(None) if types[c] in number else F.col(c)).cast("string").alias("str"),
        )
        for d, c in enumerate(dims)
    ]
    counts = df.select(F.explode(F.array(*cells)).alias("v")).select("v.*").groupBy("dim", "num", "str").agg(F.count(F.lit(1)).alias("n"))
    summed = with_prefix_sum(counts, ["dim", "num", "str"], "n", "before")
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # one number
    middle = (F.col("before") - F.col("dim") * total) + F.col("n") / 2
    code = F.least(F.floor(middle * (1 << bits) / max(total, 1)), F.lit((1 << bits) - 1)).cast("int")
    return materialize(summed.select("dim", "num", "str", code.alias("code")), "codes")


def hilbert_shards(df: DataFrame, dims: list[str], id_col: str, n_shards: int, bits: int = 6, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``hilbert`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Law ``rows``: the order by (hilbert, id) is cut into ``n_shards`` runs whose counts
    differ by at most one.  A value that holds a third of all rows is one cell of the
    curve, but the id orders and splits its rows like any others: range partitioning on
    (hilbert, id) deals them to many tasks and no window groups by cell.

    Nulls in a dimension are a value of their own; a null id sorts first.  Rows of one id,
    or of none, are ordered by the columns ``ties``.  Repeated rows keep one place each.  An empty table gives an empty result.  Columns of ``df`` other
    than the three named are kept as they are (names beginning with ``__`` are reserved).
    """
    narrow = materialize(df, "shard-in")
    codes = equal_depth_codes(narrow, dims, bits)
    number = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types, out = dict(narrow.dtypes), narrow
    for d, c in enumerate(dims):
        by = "num" if types[c] in number else "str"
        own = codes.where(F.col("dim") == d).select(F.col(by).alias("__v"), F.col("code").alias(f"__c{d}"))
        key = F.col(c).cast("double" if by == "num" else "string")
        out = out.withColumn("__k", key).join(own, F.col("__k").eqNullSafe(F.col("__v")), "left").drop("__k", "__v")
    place = hilbert_index([F.col(f"__c{d}") for d in range(len(dims))], bits)
    placed = out.withColumn("hilbert", place).drop(*[f"__c{d}" for d in range(len(dims))])
    ranked = with_rank(placed, ["hilbert", id_col, *(ties or [])], "__r")
    total = narrow.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = max(total, 1)
    shard = F.expr(f"__r * {n_shards}L div {n}L")
    first = F.expr(f"(cast(shard as bigint) * {n}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__r") - first).drop("__r")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order, so that every file's statistics are tight."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
