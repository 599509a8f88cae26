"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.size(words(text)).cast("long")


def lines(text: Column) -> Column:
    """The \\n-separated lines of a text; null has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))
