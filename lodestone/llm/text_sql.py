"""Text expressions shared by the native operators: words, lines, and bound sub-expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that parts words: space and the five control characters from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it.

    A lambda variable holds it, so the optimizer can move the whole expression (into a
    filter, say) without copying ``value`` to every place of use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: maximal runs of anything but white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")
