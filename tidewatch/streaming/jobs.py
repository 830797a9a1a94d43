"""Structured Streaming forms of ingest, traffic, queue and burst rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.times import as_instant, as_wall_clock, hour_label
from tidewatch.operators.bursts import trailing_failures
from tidewatch.operators.reports import pending_analysis
from tidewatch.sources.logs import identified, parse_dns_lines, raw_log, read_dns, write_dns

WATERMARK = "10 minutes"


def stream_dns(spark: SparkSession, in_dir: str, out: str, checkpoint: str, now: Column | None = None,
               **trigger) -> StreamingQuery:
    """Continuous ingest of rotated log files into the month-partitioned DNS table.

    A batch writes into folders that carry its number and replaces them when it
    runs again, so a retry after a lost executor or driver adds nothing twice. A batch
    holds whole files, so it can number the equal lines of each.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        rows = parse_dns_lines(identified(batch, F.col("file")), now)
        write_dns(rows.withColumn("batch_id", F.lit(batch_id)), out, "overwrite", ["batch_id"])

    return (raw_log(spark, in_dir, streaming=True).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def compact_dns(spark: SparkSession, staged: str, out: str, before: str) -> None:
    """Moves the finished months (`yyyyMM` below `before`) of a stream's output into plain month folders.

    `stream_dns` writes a folder per batch. This rewrites whole months without the batch
    level, replacing a month that was moved before, so it can run again at any time.
    """
    for status in ("accepted", "rejected"):
        rows = read_dns(spark, staged, status).filter((F.col("ym") < before)).drop("batch_id", "ym")
        write_dns(rows, out, "overwrite")


def stream_hourly(dns: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Hourly traffic of a stream, exact, emitted once an hour is closed.

    Streams allow no distinct counts, so every row enters the first grouping
    twice, as its domain and as its source; the second grouping counts the
    groups. State is keyed by hour and value, so a busy hour is spread out.
    """
    tagged = dns.select(
        as_instant(F.col("timestamp")).alias("at"),
        F.explode(F.array(F.struct(F.lit("d").alias("kind"), F.col("domain").alias("value")),
                          F.struct(F.lit("s").alias("kind"), F.col("source_ip").alias("value")))).alias("e"))
    values = (tagged.withWatermark("at", watermark)
              .groupBy(F.window("at", "1 hour").alias("hour"), "e.kind", "e.value")
              .agg(F.count("*").alias("n"), F.max("at").alias("latest")))
    is_domain = F.col("kind") == "d"
    hours = values.groupBy("hour").agg(
        F.sum(F.when(is_domain, F.col("n")).otherwise(0)).alias("total_queries"),
        F.sum(F.when(is_domain, 1).otherwise(0)).alias("unique_domains"),
        F.sum(F.when(is_domain, 0).otherwise(1)).alias("unique_sources"),
        F.max("latest").alias("latest_query"))
    return hours.select(hour_label(as_wall_clock(F.col("hour.start"))).alias("hour_group"),
                        F.unix_seconds("hour.start").alias("time_sec"), "total_queries", "unique_domains",
                        "unique_sources", as_wall_clock(F.col("latest_query")).alias("latest_query"))


def stream_pending(dns: DataFrame, indicators: Callable[[], DataFrame], out: str, checkpoint: str,
                   **trigger) -> StreamingQuery:
    """Queue the new observables of each batch; `indicators` reads the table anew each time."""
    def queue(batch: DataFrame, batch_id: int) -> None:
        # only indicators of the batch's queries take part
        known = indicators().join(batch.select(F.col("id").alias("dns_query_id")), "dns_query_id", "left_semi")
        (pending_analysis(batch, known).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out))

    return (dns.writeStream.foreachBatch(queue).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "3 minutes"})).start())


def stream_bursts(failures: DataFrame, key: str, ts: str, out: str, checkpoint: str, n: int = 3,
                  window_seconds: int = 600, ban_seconds: int = 86400, watermark: str = WATERMARK,
                  **trigger) -> StreamingQuery:
    """The burst rule on a stream, with the result of the batch rule once a window is closed.

    Windows are two lengths long and slide by one, so every second lies in the later
    half of exactly one of them, together with all of its history. State is a count per
    source, window and second; a closed window is evaluated as the batch rule does it.
    """
    length = f"{window_seconds} seconds"
    at = failures.select(key, as_instant(F.col(ts)).alias("at"))
    counted = (at.withWatermark("at", watermark)
               .groupBy(key, F.window("at", f"{2 * window_seconds} seconds", length).alias("w"),
                        F.unix_seconds("at").alias("second"))
               .agg(F.count("*").alias("hits")))

    def flag(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, "hits", "second", F.unix_seconds("w.start").alias("start"))
        found = trailing_failures(rows, [key, "start"], window_seconds).filter(
            (F.col("second") >= F.col("start") + window_seconds) & (F.col("failures") >= n))
        flagged = as_wall_clock(F.timestamp_seconds("second"))
        ban = F.make_dt_interval(secs=F.lit(ban_seconds))
        (found.select(key, flagged.alias("flagged_at"), "failures", (flagged + ban).alias("banned_until"),
                      F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    return (counted.writeStream.foreachBatch(flag).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def late_rows(query: StreamingQuery) -> int:
    """How many rows came after the watermark and were left out, in the progress that the query still holds.

    The batch forms count such rows; a stream cannot, once it has closed their window.
    """
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for state in progress["stateOperators"])


def drain(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run a streaming DataFrame over the available input into parquet files and stop."""
    (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start(out).awaitTermination())
