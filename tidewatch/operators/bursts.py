"""Burst rule: too many failures of one source in a trailing window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.times import epoch_seconds


def trailing_failures(rows: DataFrame, group: list[str], window_seconds: int) -> DataFrame:
    """Adds `failures`, the `hits` of the trailing window (both ends included), within each group of seconds."""
    trailing = Window.partitionBy(*group).orderBy("second").rangeBetween(-window_seconds, 0)
    return rows.withColumn("failures", F.sum("hits").over(trailing))


def burst_offenders(df: DataFrame, key: str, ts: str, n: int = 3, window_seconds: int = 600,
                    ban_seconds: int = 86400) -> DataFrame:
    """Seconds at which a source reached `n` failures within the trailing window.

    `ts` holds whole seconds, as the event tables do. Failures are first counted
    per source and second. Time is then cut into buckets of one window length,
    and each second also serves as history in the next bucket; a trailing window
    never reaches further back. A task therefore handles one source and at most
    two window lengths of seconds, even if one source makes a third of all rows.
    """
    seconds = df.groupBy(key, ts).agg(F.count("*").alias("hits"))
    second = epoch_seconds(F.col(ts))
    bucket = F.floor(F.col("second") / window_seconds)
    copies = F.explode(F.array(
        F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
        F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))).alias("c")
    rows = seconds.withColumn("second", second).select(key, ts, "second", "hits", copies).select(
        key, ts, "second", "hits", "c.bucket", "c.own")
    counted = trailing_failures(rows, [key, "bucket"], window_seconds)
    return counted.filter(F.col("own") & (F.col("failures") >= n)).select(
        key, F.col(ts).alias("flagged_at"), "failures",
        (F.col(ts) + F.make_dt_interval(secs=F.lit(ban_seconds))).alias("banned_until"))
