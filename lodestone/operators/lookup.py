"""Lookups by path suffix and by ranked candidates, as equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranked import ranked_resolve


def suffixes(path: Column) -> Column:
    """Every suffix of a path that begins at a segment, the whole path included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest last."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def suffix_table(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``(suffix, path)``: exploded once, so any number of lookups are equi joins."""
    return paths.select(F.explode(suffixes(F.col(path_col))).alias("suffix"), F.col(path_col).alias("path"))


def suffix_lookup(wanted: DataFrame, key: str, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``wanted`` with ``resolved``: the exact path, else the least path that ends in the key."""
    table = suffix_table(paths, path_col).groupBy("suffix").agg(F.min(F.struct((F.col("suffix") != F.col("path")).alias("longer"), "path"))["path"].alias("resolved"))
    return wanted.join(table, F.col(key) == F.col("suffix"), "left").drop("suffix")


def first_known(wanted: DataFrame, ident: list[str], candidates: Column, known: DataFrame, known_col: str) -> DataFrame:
    """The first of each row's candidate names that is known: explode with rank, equi join, least rank."""
    each = wanted.select(*ident, F.posexplode(candidates).alias("rank", "candidate"))
    hits = each.join(known.select(F.col(known_col).alias("candidate")).distinct(), "candidate")
    best = ranked_resolve(hits, ident, ["rank", "candidate"])
    return best.select(*ident, F.col("candidate").alias("resolved"), "rank")


def maybe_among(table: DataFrame, key: str, wanted: DataFrame, name: str, words: int = 19) -> DataFrame:
    """``table`` with ``name``: whether the hash ``key`` may be one of ``wanted``'s; false only if it isn't.

    A bitmap of at most 2**words longs is broadcast, whatever the input.
    """
    word, bit = F.shiftright(F.col(key), 6).bitwiseAND(F.lit((1 << words) - 1)), F.col(key).bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    found = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1
    return table.withColumn("__word", word).join(F.broadcast(bits), "__word", "left").withColumn(name, F.coalesce(found, F.lit(False))).drop("__word", "__bits")
