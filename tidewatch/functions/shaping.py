"""Helpers that shape a plan without changing its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a costly column (a parser, a long pattern) that runs once per row.

    The one-row explode holds later filters above it. Pushed below a plain
    projection, a filter on parsed fields would run the parser again per field.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key of `left` can be split over many tasks.

    `right` holds one row per key, usually because it was just aggregated on it.
    Such a side is already partitioned on the key, so Spark would not shuffle it
    again, and AQE only splits hot partitions of joins with a shuffle on both
    sides. The hash of the key as one more join column asks for that shuffle; it
    moves the (small) aggregated side once and leaves the result unchanged.
    """
    for key in on:
        if left.schema[key].dataType != right.schema[key].dataType:
            raise TypeError(f"join column {key} differs in type: cast one side first")
    key_hash = F.xxhash64(*on).alias("_key_hash")
    joined = left.select("*", key_hash).join(right.select("*", key_hash), [*on, "_key_hash"], how)
    return joined.drop("_key_hash")
