"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the record's key and its own index, scaled by its
weight, and the highest draw takes the record. The draws of the other shards do not
change when a shard is added, so records only ever move into the new one.

Defined cases: a NULL key is a key like any other; a shard of weight 0 takes nothing;
equal keys share a shard, however many rows they have; the slots of such rows are
still numbered in pieces of one input partition, so a hot key gathers nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.session import stored


def shard_of(key: Column, weights: list[float]) -> Column:
    """Index of the shard that takes a key; weights are in proportion to the shards' shares."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be at least 0, and one above 0")
    text = key.cast("string")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 53 random bits, centred so that neither 0 nor 1 occurs
            uniform = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + 0.5) / 2.0 ** 53
            draws.append(F.struct((F.log(uniform) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def number_slots(df: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Adds gapless numbers from 0 within each value of `group` (not NULL).

    Rows are numbered inside (input partition, group), and each piece starts where
    the pieces before it end. The pieces' counts are all that a group gathers.
    Returns the columns of `df` and `slot`; a column of that name is replaced.
    """
    rows = stored(df.select(F.struct(*(c for c in df.columns)).alias("row"), F.col(group).alias("g"),
                            F.spark_partition_id().alias("part")), "slots")
    sizes = rows.groupBy("part", "g").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part", "g").orderBy(*(F.col(f"row.{c}") for c in order))
    numbered = rows.withColumn("n", F.row_number().over(inside) - 1)
    joined = spread_join(numbered, starts, ["part", "g"])
    return joined.select(*(F.col(f"row.{c}").alias(c) for c in df.columns if c != slot),
                         (F.col("start") + F.col("n")).alias(slot))


def shard_rows(docs: DataFrame, weights: list[float], grown_weights: list[float],
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, checksum, shard and slot of every row, and the shard under `grown_weights`."""
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), grown_weights).alias("grown_shard"))
    return number_slots(placed, "shard", [key, "text_crc32", "size"])


def write_shards(docs: DataFrame, weights: list[float], path: str, key: str = "doc_id") -> None:
    """Stores whole rows in one folder per shard (`shard=N`), files of a good size in each."""
    (docs.withColumn("shard", shard_of(F.col(key), weights)).hint("rebalance", "shard")
     .write.partitionBy("shard").parquet(path))
