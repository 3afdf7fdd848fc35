"""Periodic runs of words: maximal repetitions by Lyndon words.

A run of period q has, under one of two opposite orders of the words, a Lyndon word of q
words that is the longest one where it starts (its root).  So a stack of Lyndon words,
kept from right to left, under both orders, proposes at most two periods a place.  Each is
extended to both sides by longest common extensions: a few words are compared directly,
then prefixes' rolling hashes by galloping and binary search, and what the hashes say is
verified word by word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_store import slices

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TURNS = 6, 4
MODULUS, BASE = (1 << 61) - 1, 1_000_003_819_417
#: Words compared one by one before hashes are.
DIRECT = 8

FOUND = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Extensions:
    """Common extensions of places of one text, by distance: what is known of a distance is kept while places go left."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.raw = memoryview(array("I", ids).tobytes())
        self.sums: list[int] = []
        self.powers: list[int] = []
        #: by distance: the words from the first place to the second equal those so far behind, and then no more
        self.known: dict[int, tuple[int, int]] = {}

    def _prepare(self) -> None:
        sums, powers, h, p = [0], [1], 0, 1
        for x in self.ids:
            h = (h * BASE + x + 1) % MODULUS
            p = p * BASE % MODULUS
            sums.append(h)
            powers.append(p)
        self.sums, self.powers = sums, powers

    def _same(self, i: int, j: int, size: int) -> bool:
        s, p = self.sums, self.powers[size]
        return (s[i + size] - s[i] * p - s[j + size] + s[j] * p) % MODULUS == 0

    def _most(self, most: int, same) -> int:
        """The greatest size up to ``most`` for which ``same`` holds, by galloping and halving."""
        low, step = 0, DIRECT
        while low < most and same(min(low + step, most)):
            low, step = min(low + step, most), 2 * step
        high = min(low + step, most)
        while low < high:
            mid = (low + high + 1) // 2
            if same(mid):
                low = mid
            else:
                high = mid - 1
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        ids, d = self.ids, j - i
        first, end = self.known.get(d, (self.n, self.n))
        if first <= i <= end:
            return end - i
        k, last = i, self.n - d
        stop = min(i + DIRECT, last)
        while k < stop and ids[k] == ids[k + d]:
            k += 1
        if k == stop and k < last:
            if first <= k <= end:
                k = end
            else:
                k += self._verified(k, k + d, last - k)
        self.known[d] = i, k
        return k - i

    def _verified(self, i: int, j: int, most: int) -> int:
        if not self.sums:
            self._prepare()
        size = self._most(most, lambda s: self._same(i, j, s))
        if self.raw[4 * i : 4 * (i + size)] != self.raw[4 * j : 4 * (j + size)]:  # hashes met by chance
            ids = self.ids
            size = next((k for k in range(size) if ids[i + k] != ids[j + k]), size)
        return size

    def left(self, i: int, j: int, most: int) -> int:
        """How many words before i equal those before j, up to ``most``."""
        ids, k, most = self.ids, 0, min(most, i)
        stop = min(DIRECT, most)
        while k < stop and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
        if k < stop or k == most:
            return k
        if not self.sums:
            self._prepare()
        a, b = i - k, j - k
        size = self._most(most - k, lambda s: self._same(a - s, b - s, s))
        if self.raw[4 * (a - size) : 4 * a] != self.raw[4 * (b - size) : 4 * b]:
            size = next((s for s in range(size) if ids[a - 1 - s] != ids[b - 1 - s]), size)
        return k + size


def _roots(w: list[int], ext: Extensions, found: set[tuple[int, int, int]]) -> None:
    """Adds the runs whose roots are Lyndon words under the order of ``w``."""
    n, right = len(w), ext.right
    after = [n] * n  # the end of the longest Lyndon word that starts at a place
    for i in range(n - 2, -1, -1):
        x, j = w[i], i + 1
        while j < n:
            y = w[j]
            if x > y:
                break
            if x == y:
                k = j + right(i, j)
                if k >= n or w[k - j + i] > w[k]:
                    break
            j = after[j]
        after[i] = j
        if j < n and w[j] == x:
            p = j - i
            size = p + right(i, j)
            least = max(LEAST_WORDS, LEAST_TURNS * p)
            # the first root of a run starts within its first p words
            if size + p - 1 >= least:
                before = ext.left(i, j, p)
                if before < p and before + size >= least:
                    found.add((i - before, before + size, p))


def runs(words: list) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    numbers: dict = {}
    ids = [numbers.setdefault(x, len(numbers)) for x in words]
    ext, found = Extensions(ids), set()
    _roots(ids, ext, found)
    _roots([-x for x in ids], ext, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without what runs repeat of their first period."""
    if not found:
        return b" ".join(words)
    stay = bytearray(b"\1") * len(words)
    for start, length, period in found:
        stay[start + period : start + length] = bytes(length - period)
    return b" ".join(compress(words, stay))


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, runs, collapsed)`` for every row: its runs by start, then period, and its words without repetitions.

    Words are parted by ASCII white space; a null text has none.  Row by row, each in time
    near its length, so repeated rows, empty tables, null ids, extra columns and one very
    long text need no care.
    """
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ["doc_id", "text"]):
            ids, each, texts = [], [], []
            for doc_id, raw in rows:
                words = (raw or b"").split()
                found = runs(words)
                ids.append(doc_id)
                each.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found))
            columns = [pa.array(ids, pa.int64()), pa.array(each, kinds), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)
