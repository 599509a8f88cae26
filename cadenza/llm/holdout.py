"""The split of documents into those that models learn from and those held out, by the id alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold
