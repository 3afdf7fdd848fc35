"""A content-addressed store of token ids.

Documents are encoded, and a rolling hash over the ids cuts each stream into chunks, so
equal passages cut alike wherever they stand.  Unique chunks are stored once under their
digest; a document's recipe lists its chunks; Merkle nodes over the recipes verify that
what is read back is what was written.

Layout of a store (all Parquet):
  chunks/    digest, n, payload    each distinct chunk once: zstd over little-endian ids
  recipes/   start, doc_id, n_tokens, digests, root    in ascending doc_id order
  manifest/  level, node, root     hash trees over the recipes' roots, up to one node
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ranking import with_prefix_sum
from lodestone.scratch import drop, scratch_path

#: Ids a chunk has at least, and on average beyond that; longer ones are cut at the last.
MIN_CHUNK, CHUNK_BITS, MAX_CHUNK = 64, 10, 16384
#: Bytes, objects included, that one generation of a memo may take; a worker holds two.  An entry costs ENTRY bytes beside its
#: key and value, words of over LONG_WORD bytes aren't kept, and a memo turns every TURN words at most.
MEMO_BYTES, ENTRY, LONG_WORD, TURN = 144 << 20, 200, 64, 1 << 16
#: Text bytes that a task encodes at a time.
SLICE_BYTES = 1 << 20
#: A recipe's node in the lowest level of the manifest covers this many ids' worth of starts (in bits).
NODE_BITS, FAN_BITS = 16, 8

#: Ids below this have their hashes in a table.
SMALL_IDS = 1 << 16

ENCODED = "doc_id long, n_tokens long, digests array<binary>, lens array<int>, payloads array<binary>"


#: Words of ASCII and Latin letters without apostrophes: the splitter parts them as RUNS does, and they lower-case letter by letter.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")
#: Marks that are a run of their own behind a word of letters.
MARKS = frozenset(b".,;:!?")


class Memo(dict):
    """Values worked out when first asked for, while there is room for them.

    ``turned`` gives a memo to go on with: a full one becomes the old generation of a new
    one, whose own old generation goes.  What is asked for again moves over.
    """

    def __init__(self, work: Callable, room: int = 0):
        self.work, self.room, self.size = work, room or MEMO_BYTES, 0
        self.old: dict = {}

    def __missing__(self, key):
        if len(key) > LONG_WORD:
            return self.work(key)
        found = self.old.get(key)
        if found is None:
            found = self.work(key)
        if self.size < self.room:
            self.size += ENTRY + len(key) + len(found)
            self[key] = found
        return found

    def turned(self) -> Memo:
        if self.size < self.room:
            return self
        new = Memo(self.work, self.room)
        new.old, self.old = self, {}
        return new


def pack(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids; for a few ids cheaper than by way of NumPy."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class WordEncoder:
    """Encodes white-space separated words with the tokenizers library, each distinct word once per memo.

    The vocabulary's normalizer and splitter never join ids across ASCII white space, so
    the ids of a text are those of its words in order.  Plain words are lower-cased and
    parted into runs, which the library's BPE model encodes; any other word goes through
    the whole tokenizer.  A word of one run and that run are one entry of the memo.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from lodestone.llm.byte_bpe import byte_table

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = byte_table()
        self.memo = Memo(self.word)

    def run(self, run: bytes) -> bytes:
        spelled = run.decode() if run.isascii() else "".join(map(self.chars.__getitem__, run))
        return pack([t.id for t in self.model.tokenize(spelled)])

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters, which are one run
            low = word.lower()
            return self.run(word) if low == word else self.memo[low]
        if word[-1] in MARKS and word[:-1].isalpha():  # and then one mark: two runs
            return self.memo[word[:-1].lower()] + self.memo[word[-1:]]
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            runs = [r.encode() for r in RUNS.findall(text.lower())]
            return self.run(word) if runs == [word] else b"".join(map(self.memo.__getitem__, runs))
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text (UTF-8)."""
        if b"<|" not in text:  # no name of a special token, whose case counts
            text = text.lower()
        words = text.split()
        out = []
        for at in range(0, len(words), TURN):
            self.memo = self.memo.turned()
            out.append(b"".join(map(self.memo.__getitem__, words[at : at + TURN] if len(words) > TURN else words)))
        return b"".join(out)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker: Spark reuses workers, so memos outlive tasks."""
    return WordEncoder(path)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each id."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def mixed_small() -> np.ndarray:
    """The hashes of all ids below SMALL_IDS, looked up rather than made for each id of a text."""
    return mixed(np.arange(SMALL_IDS))


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids, decided by the 32 ids before each place alone."""
    n = len(ids)
    h = mixed_small()[ids] if n and int(ids.max()) < SMALL_IDS else mixed(ids)
    for by in (1, 2, 4, 8, 16):
        h[by:] += h[:-by] << np.uint64(by)
    ends, last = [], 0
    for end in [*(np.flatnonzero(h >> np.uint64(64 - CHUNK_BITS) == 0) + 1).tolist(), n]:
        if end - last < MIN_CHUNK and end != n:
            continue
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


@contextmanager
def no_collection() -> Iterator[None]:
    """Encoding makes many small objects and no cycles of them: searching large memos for cycles meanwhile finds nothing."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=20).digest()


def slices(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of the batches in lists of at most SLICE_BYTES of text (one row at least); the last column is the text, as bytes."""
    for batch in batches:
        held, size = [], 0
        rows = zip(*[batch.column(c).cast(pa.binary()).to_pylist() if c == columns[-1] else batch.column(c).to_pylist() for c in columns])
        for row in rows:
            held.append(row)
            size += len(row[-1] or b"") + 64
            if size >= SLICE_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def encoded(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its chunks (see ENCODED).  A null text is empty and has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(tokenizer_path), zstandard.ZstdCompressor(level=3)
        end = np.array([end_id], "<u4").tobytes()
        for rows in slices(batches, ["doc_id", "text"]):
            out: list[list] = [[], [], [], [], []]
            with no_collection():
                streams = [encoder.encode(text or b"") + end for _, text in rows]
            for (doc_id, _), stream in zip(rows, streams):
                ids = np.frombuffer(stream, "<u4")
                ends = chunk_ends(ids)
                parts = [ids[a:b].astype("<u2" if int(ids[a:b].max()) < 65536 else "<u4") for a, b in zip([0, *ends], ends)]
                raws = [p.tobytes() for p in parts]
                for column, value in zip(out, (doc_id, len(ids), [digest(r) for r in raws], [len(p) for p in parts], [packer.compress(r) for r in raws])):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n_tokens", "digests", "lens", "payloads"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``df`` into a store at ``path``.

    Encoding happens once, into a staging table; from it the chunks go through one
    shuffle on their digests, and the narrow recipes through one range shuffle on
    doc_id.  Repeated rows get a recipe each.  An empty table gives an empty store.
    """
    spark = df.sparkSession
    staging = scratch_path(spark, "encoded")
    encoded(df, tokenizer_path, end_id, id_col, text_col).write.option("compression", "none").parquet(staging)
    rows = spark.read.schema(ENCODED).parquet(staging)
    chunks = rows.select(F.explode(F.arrays_zip("digests", "lens", "payloads")).alias("c"))
    chunks = chunks.select(F.col("c.digests").alias("digest"), F.col("c.lens").alias("n"), F.col("c.payloads").alias("payload"))
    chunks.dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{path}/chunks")
    narrow = rows.select("doc_id", "n_tokens", "digests")
    ordered = with_prefix_sum(narrow, ["doc_id", "n_tokens", "digests"], "n_tokens", "start")
    recipes = ordered.select("start", "doc_id", "n_tokens", "digests", recipe_root().alias("root"))
    recipes.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    write_manifest(spark, path)
    drop(spark, staging)


def recipe_root() -> Column:
    """The root of a recipe, made from what it lists and from where it stands: ``(start, doc_id, n_tokens, digests)``."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("start", "doc_id", "n_tokens")])
    listed = F.array_join(F.transform("digests", lambda d: F.hex(d)), "")
    return F.sha2(F.concat(F.lit("recipe:"), place, F.lit(":"), listed).cast("binary"), 256)


def manifest_level(nodes: DataFrame, level: int, bits: int) -> DataFrame:
    """The nodes above rows ``(at, root)``: each hashes its rows' roots in order, at most 2**bits of them."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "root"))), lambda x: x["root"]), "")
    made = nodes.groupBy(F.shiftright("at", bits).alias("node")).agg(F.sha2(joined.cast("binary"), 256).alias("root"))
    return made.select(F.lit(level).alias("level"), "node", "root")


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """The recipes' roots, made anew from their digests; the stored ones prove nothing."""
    return spark.read.parquet(f"{path}/recipes").select(F.col("start").alias("at"), recipe_root().alias("root"))


def write_manifest(spark: SparkSession, path: str) -> None:
    level = 0
    made = manifest_level(leaves(spark, path), level, NODE_BITS)
    while True:
        made.write.parquet(f"{path}/manifest/depth={level}")
        held = manifest_at(spark, path, level)
        if held.count() <= 1:
            return
        level += 1
        made = manifest_level(held.select(F.col("node").alias("at"), "root"), level, FAN_BITS)


def manifest_at(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("level int, node long, root string").parquet(f"{path}/manifest/depth={level}")


def checked_chunks(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """The chunks, unpacked and held against their digests; ``ids`` (32-bit) only if asked for.  A damaged chunk raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = iter(zip(*[batch.column(c).to_pylist() for c in ("digest", "n", "payload")]))
            while some := list(islice(rows, 512)):
                crcs, ids = [], []
                for key, n, packed in some:
                    raw = unpacker.decompress(packed)
                    if digest(raw) != key:
                        raise ValueError(f"chunk {key.hex()} is damaged")
                    wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                    crcs.append(zlib.crc32(wide))
                    ids.append(wide)
                columns = [pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.int32()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, names)

    names = ["digest", "n", "crc", *["ids"] * with_ids]
    schema = "digest binary, n int, crc long" + ", ids binary" * with_ids
    return spark.read.parquet(f"{path}/chunks").mapInArrow(run, schema)


class CrcShift:
    """crc32 of a concatenation from the parts' crc32: shifting a crc by n zero bytes is linear over its bits."""

    def __init__(self) -> None:
        # tables[k][b][x]: the crc whose byte b is x, shifted by 2**k bytes; built by squaring
        zero = zlib.crc32(b"\0")
        one = [self._one(1 << bit, zero) for bit in range(32)]
        self.steps = []
        for _ in range(40):
            self.steps.append(one)
            one = [self._apply(one, c) for c in one]

    @staticmethod
    def _one(crc: int, zero: int) -> int:
        # the linear part of appending a zero byte
        return zlib.crc32(b"\0", crc) ^ zero

    @staticmethod
    def _apply(step: list[int], crc: int) -> int:
        out, bit = 0, 0
        while crc:
            if crc & 1:
                out ^= step[bit]
            crc >>= 1
            bit += 1
        return out

    def join(self, left: int, right: int, right_bytes: int) -> int:
        k = 0
        while right_bytes:
            if right_bytes & 1:
                left = self._apply(self.steps[k], left)
            right_bytes >>= 1
            k += 1
        return left ^ right


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every recipe, from the chunks on disk.

    Only the chunks' lengths and crcs move: a document's crc32 is joined from its parts'.
    A chunk that a third of all documents share is a hot key of a plain equi join, which
    adaptive execution splits.  Chunks are held against their digests, and the digests, by
    the recipes' roots, against every level of the manifest: a store that differs raises.
    """
    if bad := verify_manifest(spark, path).first():
        raise ValueError(f"the manifest's node {bad['node']} at level {bad['level']} differs from what is below it")
    parts = spark.read.parquet(f"{path}/recipes").select("start", "doc_id", "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    joined = parts.join(checked_chunks(spark, path, False), "digest")
    rows = joined.groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    rows = rows.select("doc_id", "start", "n_tokens", F.col("parts.n").alias("lens"), F.col("parts.crc").alias("crcs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = CrcShift()
        for batch in batches:
            crcs = []
            for n, lens, parts in zip(*[batch.column(c).to_pylist() for c in ("n_tokens", "lens", "crcs")]):
                if sum(lens) != n:
                    raise ValueError("a recipe and its chunks differ in length")
                crc = parts[0]
                for k in range(1, len(parts)):
                    crc = shift.join(crc, parts[k], 4 * lens[k])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: the documents rebuilt from chunks, ids as little-endian 32-bit integers."""
    parts = spark.read.parquet(f"{path}/recipes").select("start", "doc_id", "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    joined = parts.join(checked_chunks(spark, path, True), "digest")
    rows = joined.groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    ids = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.select("doc_id", "start", "n_tokens", ids.alias("ids"))


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(level, node)`` wherever a stored node differs from what the rows below it give: the digests of the recipes, then each level (none, if all is well)."""
    below, bits, level, found = leaves(spark, path), NODE_BITS, 0, None
    while True:
        stored = manifest_at(spark, path, level).select("node", F.col("root").alias("stored"))
        again = manifest_level(below, level, bits).select("node", "root")
        bad = again.join(stored, "node", "full").where(~F.col("root").eqNullSafe(F.col("stored"))).select(F.lit(level).alias("level"), "node")
        found = bad if found is None else found.unionByName(bad)
        if stored.count() <= 1:
            return found
        below, bits, level = stored.select(F.col("node").alias("at"), F.col("stored").alias("root")), FAN_BITS, level + 1
