"""SimHash near-duplicates by segment popcounts.

A fingerprint is embedded as the number of set bits in each of its segments.  Two
fingerprints differ in at least as many bits as the Manhattan distance of their
embeddings, so those within R bits are within R in the embedding: a range join on a grid
finds them, and the exact bit distance verifies each pair.

With R = 2, embeddings within distance 2 share a grid point within distance 1 of both.
Each distinct fingerprint is put at its own point and the neighbouring ones, and pairs
meet by an equi join on the point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_store import slices
from lodestone.operators.components import connected_components
from lodestone.scratch import materialize

SHINGLE, SEED = 3, 42
#: Fingerprints link at this many differing bits or fewer.  The grid and the exact way for hot cells are made for 2.
RADIUS = 2
#: 16 segments of 4 bits hold each fingerprint at 33 points; 32 of 2 bits, at 65, but far fewer strangers meet.
SEGMENTS = ((1 << 26, 16), (None, 32))
#: Cells with more distinct fingerprints than this are linked without comparing pairs.
HOT_CELL = 64


def fingerprint(raw: bytes) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles; no words: 0."""
    words = raw.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        some = words[at : min(at + (1 << 16), n) + SHINGLE - 1]
        grams = map(b" ".join, zip(some, some[1:], some[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, fp)``: a hash of the text and the fingerprint, as signed longs.  A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ["doc_id", "text"]):
            own = np.array([xxhash.xxh64_intdigest(t or b"", 42) for _, t in rows], np.uint64).view(np.int64)  # as xxhash64 has it
            fps = np.array([fingerprint(t or b"") for _, t in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(own), pa.array(fps)], ["doc_id", "row", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def grid_points(fp: Column, segments: int) -> Column:
    """Array of (point, moved): the embedding, packed in one long, and its neighbours one step away."""
    bits = 64 // segments
    room = 64 // segments if segments == 32 else 4  # bits for a count in the packed point
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * bits).bitwiseAND(F.lit((1 << bits) - 1))).cast("long") for i in range(segments)]

    def packed(c: Column, i: int) -> Column:
        return F.shiftleft(c, i * room)

    own = reduce(lambda a, b: a.bitwiseOR(b), [packed(c, i) for i, c in enumerate(counts)])
    # one step beyond either end of a segment's range isn't a point of the grid
    steps = []
    for i, c in enumerate(counts):
        without = own.bitwiseXOR(packed(c, i))
        steps += [F.when(c < bits, without.bitwiseOR(packed(c + 1, i))), F.when(c > 0, without.bitwiseOR(packed(c - 1, i)))]
    near = F.transform(F.filter(F.array(*steps), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("point"), F.lit(1).alias("moved")))
    return F.concat(F.array(F.struct(own.alias("point"), F.lit(0).alias("moved"))), near)


def bit_flips(fp: Column) -> Column:
    """The fingerprint and its 64 neighbours at one bit.  Any two that share one differ in at most 2 bits."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])


def cells(distinct: DataFrame) -> DataFrame:
    """``(point, fp, moved, n)``: the fingerprints at each grid point that ``n``, two or more, share."""
    n = distinct.count()
    segments = next(s for most, s in SEGMENTS if most is None or n <= most)
    at = distinct.select("fp", F.explode(grid_points(F.col("fp"), segments)).alias("g")).select("fp", "g.point", "g.moved")
    crowd = at.groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    return at.join(crowd.where("n > 1").hint("merge"), "point")


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints that connect all within RADIUS bits of each other.

    In cells of up to HOT_CELL fingerprints every pair is verified, which is at most
    HOT_CELL / 2 a row.  In larger ones (dense families of near copies) the fingerprints
    are linked exactly through shared one-bit neighbours, a star around each: the same
    components, and work in proportion to their number.

    Joins here are by sorting: the planner takes exploded rows to be as few as those they
    were made of, and would gather up to 65 times its limit in the driver to broadcast it.
    """
    shared = materialize(cells(distinct), "cells")
    light = shared.where(F.col("n") <= HOT_CELL).select("point", "fp", "moved")
    other = light.select(F.col("point").alias("point2"), F.col("fp").alias("fp2"), F.col("moved").alias("moved2"))
    near = (F.col("point") == F.col("point2")) & (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    pairs = light.join(other.hint("merge"), near).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    hot = shared.where(F.col("n") > HOT_CELL).select("fp").distinct()
    flips = hot.select("fp", F.explode(bit_flips(F.col("fp"))).alias("z"))
    centre = flips.groupBy("z").agg(F.min("fp").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = flips.join(centre.hint("merge"), "z").where("fp <> c").select(F.col("c").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _rooted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, fp, root, component_id)`` for every row; ``root`` tells components apart, even those without an id."""
    own = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp")), "a", "b", "root")
    rooted = distinct.join(found, distinct["fp"] == found["vertex"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return own.join(named, "fp").select("doc_id", "row", "fp", "root", "component_id")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; the component is its smallest doc_id.

    Equal fingerprints are one point of the graph, so copies, however many, are never
    paired.  Texts without words share the fingerprint 0.  A null doc_id is a member like
    any other but never the smallest, unless all are null.  Repeated rows are kept.
    """
    return _rooted(df, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the first of its component by id (null last) and text hash, one row for each.

    Rows of one id, or of none, with different texts are different documents.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = _rooted(df, id_col, text_col).groupBy("root").agg(F.min(place).alias("first"))
    # plain columns without nulls: texts are dealt out by them once, for the join and for the one row that stays
    def key(doc_id: Column, row: Column) -> list[Column]:
        return [doc_id.isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id"), F.coalesce(row, F.lit(0)).alias("__row")]

    names = ["__none", "__id", "__row"]
    kept = first.select(*key(F.col("first.doc_id"), F.col("first.row")))
    keyed = df.select("*", *key(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*df.columns)
