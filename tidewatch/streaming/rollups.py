"""Roll-ups that streams keep fresh, whatever the order in which rows come.

A batch adds its own partial aggregates, in folders that carry its number and are replaced
when it runs again. Partial aggregates of all batches are merged when they are read, so a
late row counts like any other, and a panel reads small rows of the days it shows instead
of the table. `compact` merges the folders of finished days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.times import as_wall_clock, epoch_seconds, hour_label
from tidewatch.operators.bursts import trailing_failures
from tidewatch.session import stored

#: Batch number of rows that `compact` has merged; every batch has a larger one.
MERGED = -1
DAY = 86400


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path))


def _stream(rows: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def _wall_clock(seconds: Column) -> Column:
    return as_wall_clock(F.timestamp_seconds(seconds))


# --- traffic per hour ---------------------------------------------------------

def add_traffic(dns: DataFrame, path: str, batch_id: int) -> None:
    """Adds DNS rows to the roll-up: rows and newest time of each hour and domain, and of each hour and source."""
    second = epoch_seconds(F.col("timestamp"))
    values = F.explode(F.array(F.struct(F.lit("d").alias("kind"), F.col("domain").alias("value")),
                               F.struct(F.lit("s").alias("kind"), F.col("source_ip").alias("value")))).alias("v")
    rows = dns.select(F.floor(second / 3600).alias("hour"), "timestamp", values)
    parts = rows.groupBy("hour", "v.kind", "v.value").agg(F.count("*").alias("n"), F.max("timestamp").alias("latest"))
    _write(parts.withColumn("day", F.expr("hour div 24")), path, batch_id)


def stream_traffic(dns: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The roll-up of a stream of DNS rows; no watermark, as nothing is ever closed."""
    return _stream(dns, lambda batch, batch_id: add_traffic(batch, path, batch_id), checkpoint, trigger)


def hourly_traffic(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The hourly report from the roll-up, exact; of the days `first` to `last` (since 1970) if given."""
    parts = spark.read.parquet(path)
    if first is not None:
        parts = parts.filter(F.col("day") >= first)
    if last is not None:
        parts = parts.filter(F.col("day") <= last)
    values = parts.groupBy("hour", "kind", "value").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    is_domain = F.col("kind") == "d"
    present = F.col("value").isNotNull()
    hours = values.groupBy("hour").agg(
        F.sum(F.when(is_domain, F.col("n"))).alias("total_queries"),
        F.count(F.when(is_domain & present, 1)).alias("unique_domains"),
        F.count(F.when(~is_domain & present, 1)).alias("unique_sources"), F.max("latest").alias("latest_query"))
    return hours.select(hour_label(F.col("latest_query")).alias("hour_group"), (F.col("hour") * 3600).alias("time_sec"),
                        "total_queries", "unique_domains", "unique_sources", "latest_query")


def compact(spark: SparkSession, path: str, before: int) -> None:
    """Merges the traffic folders of each day below `before` (days since 1970) into one.

    The merged rows are written elsewhere first and then replace the folders of their day, of
    which those of single batches are left empty; a day without new batches is not touched.
    Run it while no batch is being added.
    """
    parts = spark.read.parquet(path).filter(F.col("day") < before)
    batches = parts.groupBy("day").agg(F.max("batch_id").alias("newest")).filter(F.col("newest") > MERGED)
    days = [r.day for r in batches.collect()]  # finished days since the last run
    if not days:
        return
    touched = parts.filter(F.col("day").isin(days))
    merged = touched.groupBy("day", "hour", "kind", "value").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    merged = stored(merged.select("hour", "kind", "value", "n", "latest", "day"), "compacted")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folders = [r for r in touched.select("day", "batch_id").distinct().collect() if r.batch_id != MERGED]
    _write(merged, path, MERGED)
    for folder in folders:
        place = hadoop.Path(f"{path}/day={folder.day}/batch_id={folder.batch_id}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# --- bursts -------------------------------------------------------------------

def add_failures(failures: DataFrame, key: str, ts: str, path: str, batch_id: int, n: int = 3, window_seconds: int = 600,
                 ban_seconds: int = 86400) -> None:
    """Adds failures and rewrites the burst rows of the sources and windows that they can change.

    Hits per source and second go to `counts`. A failure changes the rule in its own window
    length and in the next; for these the rule is evaluated anew over all hits stored so far, and
    the rows go to `flagged` with the batch's number. The newest evaluation of a source and window
    counts, see `burst_rows`.
    """
    spark = failures.sparkSession
    hits = failures.select(F.col(key).alias("source"), epoch_seconds(F.col(ts)).alias("second")).groupBy("source", "second") \
        .agg(F.count("*").alias("hits"))
    hits = stored(hits.withColumn("day", F.expr(f"second div {DAY}")), "hits")
    _write(hits, f"{path}/counts", batch_id)
    days = hits.agg(F.min("day"), F.max("day")).first()
    if days[0] is None:
        return
    reach = 2 * window_seconds // DAY + 1
    bucket = F.floor(F.col("second") / window_seconds)
    touched = hits.select("source", F.explode(F.array(bucket, bucket + 1)).alias("bucket")).distinct()
    # a bucket is evaluated with its own seconds and those of the one before
    known = spark.read.parquet(f"{path}/counts").filter(F.col("day").between(days[0] - reach, days[1] + reach))
    known = known.groupBy("source", "second").agg(F.sum("hits").alias("hits"))
    rows = known.select("source", "second", "hits", F.explode(F.array(
        F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
        F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))).alias("c")).select(
            "source", "second", "hits", "c.bucket", "c.own")
    counted = trailing_failures(rows.join(touched, ["source", "bucket"], "left_semi"), ["source", "bucket"], window_seconds)
    found = counted.filter(F.col("own") & (F.col("failures") >= n)).select("source", "bucket", "second", "failures")
    evaluated = touched.select("source", "bucket", F.lit(None).cast("bigint").alias("second"),
                               F.lit(None).cast("bigint").alias("failures"))
    out = found.unionAll(evaluated).withColumns({
        "day": F.floor(F.col("bucket") * window_seconds / DAY), "ban_seconds": F.lit(ban_seconds)})
    _write(out, f"{path}/flagged", batch_id)


def stream_failures(failures: DataFrame, key: str, ts: str, path: str, checkpoint: str, n: int = 3,
                    window_seconds: int = 600, ban_seconds: int = 86400, **trigger) -> StreamingQuery:
    """The burst rule of a stream, equal to the batch rule over all rows so far, late ones included."""
    def add(batch: DataFrame, batch_id: int) -> None:
        add_failures(batch, key, ts, path, batch_id, n, window_seconds, ban_seconds)

    return _stream(failures, add, checkpoint, trigger)


def burst_rows(spark: SparkSession, path: str) -> DataFrame:
    """`source`, `flagged_at`, `failures`, `banned_until` as of the newest evaluation of each source and window."""
    rows = spark.read.parquet(f"{path}/flagged")
    newest = rows.groupBy("source", "bucket").agg(F.max("batch_id").alias("batch_id"))
    current = rows.filter("second is not null").join(newest, ["source", "bucket", "batch_id"], "left_semi")
    at = _wall_clock(F.col("second"))
    return current.select("source", at.alias("flagged_at"), "failures",
                          (at + F.make_dt_interval(secs=F.col("ban_seconds"))).alias("banned_until"))
