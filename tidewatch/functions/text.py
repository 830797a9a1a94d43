"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_distinct(col: Column, sep: str = ", ") -> Column:
    """Aggregate: the distinct values in order, as one string; NULL if none.

    For groups whose number of distinct values is bounded by the data model.
    """
    values = F.collect_set(col)
    return F.when(F.size(values) > 0, F.concat_ws(sep, F.array_sort(values)))


def strip_fences(col: Column) -> Column:
    """Model output without markdown fences and line breaks."""
    bare = F.trim(F.regexp_replace(col, "```json\n|```", ""), F.lit(" \t\n\r"))
    return F.regexp_replace(bare, "[\r\n]+", " ")
