"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, and decoding through the byte table."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_store import slices

#: Units or matches, and bytes of them and their ids, from which on a task's memo starts anew at its next slice.
MEMO_UNITS, MEMO_BYTES = 400_000, 64 << 20


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Held(dict):
    """Ids by text, worked out when first asked for; ``trim`` starts anew what has grown too large."""

    def __init__(self, work: Callable[[str], bytes]):
        self.work, self.size = work, 0

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.work(key)
        self.size += len(key) + len(found)
        return found

    def trim(self) -> None:
        if len(self) > MEMO_UNITS or self.size > MEMO_BYTES:
            self.clear()
            self.size = 0


class ByteBpe:
    """A tokenizer built from ranks: every way to join two tokens into a third is a merge of the third's rank.

    The library orders merges one by one, ranks order them by what they make.  That differs
    only where two ways to make one token overlap, p + q and q + r with p not q, and then
    the leftmost must win.  The bytes p q r of all such cases are known beforehand; units
    that hold any are merged here by rank, all others by the library.
    """

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        ranks = read_ranks(ranks_path)
        to_char = byte_table()
        spelled = {t: "".join(map(to_char.__getitem__, t)) for t in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    merges.append((spelled[token[:k]], spelled[token[k:]]))
        model = BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        overlaps = {t[:k] + t for t in ranks for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks and t[:k] != t[k:] and t.startswith(t[k:]) and t[len(t) - k :] in ranks}
        self.overlap = re.compile(b"|".join(map(re.escape, sorted(overlaps))) if overlaps else rb"(?!)")
        from_char = {c: b for b, c in to_char.items()}
        self.table = {i: bytes(map(from_char.__getitem__, token)) for token, i in self.tokenizer.get_vocab().items()}
        self.model, self.chars = model, to_char
        self.memo, self.matches = Held(self.unit), Held(self.match)

    def units(self, text: str) -> list[str]:
        """Pieces of the text at whose borders the pattern always parts it: before a single space between two words."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts
        if "" not in parts and text.isprintable():
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = [parts[0]]
        for p in parts[1:]:
            if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def match(self, piece: str) -> bytes:
        """The ids of one match of the pattern, whole tokens first: the model's own merges, but for those whose order it loses."""
        raw = piece.encode()
        if self.overlap.search(raw):
            return np.array(self.merged(raw), "<u4").tobytes()
        return np.array([t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, raw)))], "<u4").tobytes()

    def unit(self, unit: str) -> bytes:
        """The ids of a unit: new units are mostly known matches put together anew."""
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(unit)))

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one match: the pair of the least rank joins first, and of several such pairs the leftmost."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        ends = list(range(1, len(raw) + 1))  # of the part that begins here
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and (right := after[at]) < len(raw) and (rank := self.ranks.get(raw[at : ends[right]])) is not None:
                heapq.heappush(heap, (rank, at, ends[right]))

        for at in range(len(raw)):
            offer(at)
        while heap:
            _, at, end = heapq.heappop(heap)
            right = after[at]
            if ends[at] <= at or right >= len(raw) or ends[right] != end:
                continue  # one of the two has been joined to another since
            ends[at], after[at] = end, after[right]
            ends[right] = 0
            if after[right] < len(raw):
                before[after[right]] = at
            offer(at)
            offer(before[at])
        out, at = [], 0
        while at < len(raw):
            out.append(self.ranks[raw[at : ends[at]]])
            at = ends[at]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        for memo in (self.memo, self.matches):
            memo.trim()
        return [b"".join(map(self.memo.__getitem__, self.units(t))) for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for.  A character may be split over several ids: only whole sequences are text."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def pieces(self, ids: np.ndarray) -> list[str]:
        """Text that each id completes, as a stream would show it: bytes of an unfinished character wait for the rest."""
        import codecs

        held = codecs.getincrementaldecoder("utf-8")("replace")
        out = [held.decode(self.table[i]) for i in ids.tolist()]
        if out:
            out[-1] += held.decode(b"", True)
        return out

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code-point range of each id: every character of which it has a byte (so split characters belong to several)."""
        raw = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = np.array([len(self.table[i]) for i in ids.tolist()], np.int64)
        ends = np.cumsum(sizes)
        return char[ends - sizes], char[ends - 1] + 1


@cache
def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    """One for each Python worker: Spark reuses workers, so the memo outlives tasks."""
    return ByteBpe(ranks_path, pattern)


def _coded(df: DataFrame, columns: dict[str, pa.DataType], schema: str, one: Callable, ranks_path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for rows in slices(batches, ["doc_id", "text"]):
            coded = bpe.encode([(t or b"").decode("utf-8", "replace") for _, t in rows])
            made = [one(bpe, doc_id, np.frombuffer(raw, "<u4")) for (doc_id, _), raw in zip(rows, coded)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), columns.values())], list(columns))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, starts, ends)``: ids with the code-point range of each.

    A null or empty text has no ids.  Invalid UTF-8 counts as replacement characters.
    Row by row, so repeated rows, empty tables and extra columns need no care.
    """
    columns = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}

    def one(bpe: ByteBpe, doc_id: int, ids: np.ndarray) -> tuple:
        starts, ends = bpe.offsets(ids) if len(ids) else (ids, ids)
        return doc_id, ids.astype("i4"), starts, ends

    return _coded(df, columns, "doc_id long, ids array<int>, starts array<long>, ends array<long>", one, ranks_path, pattern, id_col, text_col)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: texts encoded, and the ids decoded again, in one pass.

    Null and empty texts have no ids and the digests of nothing; rows may repeat, a null
    id stays, extra columns are left alone, and an empty table gives an empty result.
    """
    columns = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def one(bpe: ByteBpe, doc_id: int, ids: np.ndarray) -> tuple:
        return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _coded(df, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", one, ranks_path, pattern, id_col, text_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, raw)``: the bytes of each array of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            raw = [None if ids is None else bpe.decode(np.array(ids, "i8")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, raw binary")
