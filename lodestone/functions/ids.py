"""Identities of facts.  These formulas are fixed: other tables and stored results refer to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(text: str) -> int:
    h = FNV_OFFSET
    for byte in text.encode():
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv_series(texts: pd.Series) -> pd.Series:
    """Hex FNV-1a of a batch: one vectorised step for each byte position, over the texts that long."""
    raws = [b"" if t is None else t.encode() for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(raws) else sizes
    flat = np.frombuffer(b"".join(raws), np.uint8)
    h = np.full(len(raws), FNV_OFFSET, np.uint64)
    longest = int(sizes.max(initial=0))
    counts = len(raws) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
    for at in range(longest):
        live = order[: counts[at]]
        h[live] = (h[live] ^ flat[starts[live] + at]) * np.uint64(FNV_PRIME)
    return pd.Series([None if t is None else f"{x:016x}" for t, x in zip(texts, h.tolist())], dtype=object)


def fnv_hex(text: Column) -> Column:
    """16 hex digits of FNV-1a: an Arrow-batched function, since wrapping 64-bit products aren't built in."""

    @F.pandas_udf("string")
    def fnv(texts: pd.Series) -> pd.Series:
        return fnv_series(texts)

    return fnv(text)


def symbol_id(path: Column, line: Column, col: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws("|", path, line.cast("string"), col.cast("string"), name, kind)


def type_id(language: Column, path: Column, display: Column) -> Column:
    return F.concat(F.lit("type:"), fnv_hex(F.concat_ws("|", language, path, display)))


def call_site_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", path, start.cast("string"), end.cast("string"))


def scope_id(path: Column, start: Column, kind: Column) -> Column:
    return F.concat_ws("|", path, start.cast("string"), kind)


def occurrence_id(path: Column, start: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws("|", path, start.cast("string"), name, kind)


def comment_id(path: Column, start: Column, ordinal: Column) -> Column:
    return F.concat_ws("|", path, start.cast("string"), ordinal.cast("string"), F.lit("comment"))
