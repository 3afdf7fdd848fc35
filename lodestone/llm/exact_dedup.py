"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of CHUNK bytes.  A chunk's hash is the polynomial of its bytes at
a fixed base, modulo a prime; shifted by the number of bytes behind it, the hashes of all
chunks add up to the hash of the text.  Sums don't mind where or in which order the chunks
were hashed, so a huge text's chunks are dealt out over all tasks and meet as a sum.

Texts of equal length and fingerprint (two primes) are candidates.  Their chunks are then
compared byte by byte, place by place: of a class's chunks at one place the least and the
greatest are kept, by partial aggregation, and differ if any two do.  A class in which
some place differs is taken apart by whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_sql import SPACES
from lodestone.llm.token_store import slices
from lodestone.operators.lookup import maybe_among
from lodestone.scratch import materialize

#: Bytes of a chunk: sums of CHUNK products of a byte and a residue stay below 2**63.
CHUNK = 1 << 16
#: Texts of more bytes than this are hashed chunk by chunk in many tasks.
HUGE = 32 << 20
#: Two primes below 2**31 with a base each: 62 bits beside the length.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_386_437_543, 911_382_323)
#: Rows that a repeated row is spread to at a time.
SPREAD = 1 << 16

CUT = "doc_id long, hint long, n_bytes long, sha256 string, fp long, at long, chunk binary"


def normalised(text: Column) -> Column:
    """What texts are compared by: every run of white space is one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


@cache
def powers(prime: int, base: int) -> np.ndarray:
    """base**(CHUNK - 1) ... base**0 modulo the prime."""
    out, now = np.empty(CHUNK, np.uint64), 1
    for k in range(CHUNK - 1, -1, -1):
        out[k], now = now, now * base % prime
    return out


def shifted(chunk: bytes | memoryview, behind: int, primes: tuple[int, ...]) -> list[int]:
    """The chunk's hashes, shifted by the bytes behind it: what it adds to the text's."""
    wide = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return [int(wide @ powers(p, b)[CHUNK - len(wide) :]) % p * pow(b, behind, p) % p for p, b in zip(primes, BASES)]


def packed(sums: list[int]) -> int:
    return sums[0] << 31 | sums[1]


def chunks(raw: bytes) -> Iterator[tuple[int, memoryview]]:
    """(place, bytes) of each chunk; an empty text has one empty chunk."""
    view = memoryview(raw)
    for at in range(0, max(len(raw), 1), CHUNK):
        yield at, view[at : at + CHUNK]


def fingerprint(raw: bytes, primes: tuple[int, ...] = PRIMES) -> int:
    sums = zip(*[shifted(part, len(raw) - at - len(part), primes) for at, part in chunks(raw)])
    return packed([sum(s) % p for s, p in zip(sums, primes)])


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some SLICE bytes, the last column's."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1] or b"") + 64
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("hint"), "text")


def fingerprints(df: DataFrame, id_col: str, text_col: str, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """``(doc_id, hint, n_bytes, sha256, fp, copies)``: one row for all rows of one id and text, cut as a table.

    Texts are read once.  Huge ones leave that pass as chunks, which other tasks hash.
    ``hint`` is a plain hash of the text, by which a later pass leaves out most others.
    """
    names = [x.split(" ")[0] for x in CUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for rows in slices(batches, ["doc_id", "hint", "text"]):
                for doc_id, hint, raw in rows:
                    own = doc_id, hint, len(raw), hashlib.sha256(raw).hexdigest()
                    if len(raw) <= huge:
                        yield *own, fingerprint(raw, primes), None, None
                    else:
                        yield from ((*own, None, at, part.tobytes()) for at, part in chunks(raw))

        yield from _batches(each(), names, types, 1 << 20)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shifted(c, n - at - len(c), primes) for n, at, c in zip(*[batch.column(k).to_pylist() for k in ("n_bytes", "at", "chunk")])]
            sums = [pa.array([h[k] for h in held], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*key, "at"]], *sums], [*key, "at", "h0", "h1"])

    key = ["doc_id", "hint", "n_bytes", "sha256"]
    first = materialize(_rows(df, id_col, text_col).mapInArrow(cut, CUT), "fingerprints")
    whole = first.where(F.col("chunk").isNull()).groupBy(*key, "fp").agg(F.count(F.lit(1)).alias("copies"))
    pieces = first.where(F.col("chunk").isNotNull()).select(*key, "at", "chunk").repartition("sha256", "at")
    each = pieces.mapInArrow(hashed, "doc_id long, hint long, n_bytes long, sha256 string, at long, h0 long, h1 long")
    once = each.groupBy(*key, "at").agg(F.max("h0").alias("h0"), F.max("h1").alias("h1"), F.count(F.lit(1)).alias("copies"))
    joined = F.shiftleft(F.sum("h0") % primes[0], 31).bitwiseOR(F.sum("h1") % primes[1])
    large = once.groupBy(*key).agg(joined.alias("fp"), F.max("copies").alias("copies"))
    return materialize(whole.unionByName(large.select(*whole.columns)), "documents")


def collisions(df: DataFrame, known: DataFrame, sums: DataFrame, id_col: str, text_col: str, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``(n_bytes, fp)`` of classes that hold different texts, found by comparing the bytes of their chunks.

    Texts of classes of one row stay where they are (but for those that a bitmap of fixed
    size takes for others).  Of the rest the chunks move, at most once for each task and
    distinct text.
    """
    several = sums.where("group_size > 1").select("n_bytes", "fp")
    hints = known.join(several.hint("merge"), ["n_bytes", "fp"], "left_semi").select("hint").distinct()
    rows = maybe_among(_rows(df, id_col, text_col), "hint", hints, "maybe").where("maybe").select("doc_id", "hint", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for some in slices(batches, ["doc_id", "hint", "text"]):
                for _, _, raw in some:
                    fp = fingerprint(raw, primes)
                    yield from ((len(raw), fp, at, part.tobytes()) for at, part in chunks(raw))

        yield from _batches(each(), ["n_bytes", "fp", "at", "chunk"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], 1 << 20)

    parts = rows.mapInArrow(run, "n_bytes long, fp long, at long, chunk binary")
    ends = parts.groupBy("n_bytes", "fp", "at").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return materialize(ends.where("lo <> hi").select("n_bytes", "fp").distinct(), "collisions")


def _sums(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each class with its least id and its number of rows, cut as a table.

    A join with an aggregate of the very shuffle it reads can't be split, and a hot class
    would be one task's.
    """
    return materialize(rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "classes")


def _classes(rows: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with what is known of their class.  Rows of a hot class are split by the join."""
    return rows.join(sums.hint("merge"), key).select("doc_id", "sha256", "copies", "keep_id", "group_size")


def _spread(rows: DataFrame) -> DataFrame:
    """A row for each copy; of the class's least id, the first copy stays."""
    some = rows.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(SPREAD).cast("long"))))
    each = some.withColumn("__copy", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + (SPREAD - 1), F.col("copies")))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha256")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, sha256)`` for every row of ``df``.

    A null text is an empty one.  Of rows with equal text and id exactly one stays; a null id
    is never the least, unless a class has no other.  An empty table gives an empty result.
    Other columns aren't read, so their names don't matter.
    """
    known = fingerprints(df, id_col, text_col, primes, huge)
    sums = _sums(known, ["n_bytes", "fp"])
    mixed = collisions(df, known, sums, id_col, text_col, primes)
    if mixed.isEmpty():
        return _spread(_classes(known, sums, ["n_bytes", "fp"]))
    clean = known.join(mixed, ["n_bytes", "fp"], "left_anti")
    hints = known.join(mixed, ["n_bytes", "fp"], "left_semi").select("hint").distinct()
    texts = _rows(df, id_col, text_col).join(hints, "hint", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    apart = _classes(texts, _sums(texts, ["text"]), ["text"])
    # a clean class may share a hint with a mixed one: it is told by the classes that the mixed ones' texts have
    some = known.join(mixed, ["n_bytes", "fp"], "left_semi").select("sha256").distinct()
    return _spread(_classes(clean, sums, ["n_bytes", "fp"]).unionByName(apart.join(some, "sha256", "left_semi").select("doc_id", "sha256", "copies", "keep_id", "group_size")))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each text."""
    def key(doc_id: Column, sha: Column) -> list[Column]:
        return [doc_id.isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id"), sha.alias("__sha")]

    names = ["__none", "__id", "__sha"]
    stay = classes(df, id_col, text_col).where("kept").select(*key(F.col("doc_id"), F.col("sha256")))
    keyed = df.select("*", *key(F.col(id_col).cast("long"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))
    return keyed.join(stay, names, "left_semi").dropDuplicates(names).select(*df.columns)
