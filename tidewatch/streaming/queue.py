"""The work queue as a stream that keeps its state: rows leave when answered and come back when not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.net import is_ipv4

#: Batches whose changes of state lie side by side before the state is written as a whole.
MERGE_EVERY = 50
_ENTRY = ["source_ip", "fqdn", "observable_ip", "first_seen"]
_STATE = ("dns_query_id string, answered boolean, until_ms bigint, attempt int, source_ip string, fqdn string, "
          "observable_ip string, first_seen timestamp_ntz, event string")


def stream_queue(dns: DataFrame, indicators: DataFrame, out: str, checkpoint: str, again_seconds: int = 3600,
                 keep_seconds: int = 30 * 86400, **trigger) -> StreamingQuery:
    """Queue events of streams of DNS rows and of indicators, written to `out` by batch.

    A row with an IPv4 answer and no indicator becomes an entry (`waiting`, attempt 1). Its
    indicator, in whatever batch it comes, ends it (`answered`); without one it is handed out
    again after `again_seconds` with the next attempt, once in a batch. An answer that comes
    before its query is remembered for `keep_seconds`. A row's time is that of the batch which
    brings it, so no row is too late to count. State is one small row per waiting or recently
    answered query, beside the checkpoint (`add_batch`); a restart goes on from there.
    """
    seen = dns.filter(is_ipv4(F.col("response_ip"))).select(
        F.col("id").cast("string").alias("dns_query_id"), F.lit(False).alias("answer"), "source_ip",
        F.col("domain").alias("fqdn"), F.col("response_ip").alias("observable_ip"), F.col("timestamp").alias("first_seen"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source_ip", "fqdn", "observable_ip")]
    answers = indicators.select(F.col("dns_query_id").cast("string").alias("dns_query_id"), F.lit(True).alias("answer"),
                                *nothing, F.lit(None).cast("timestamp_ntz").alias("first_seen"))
    both = seen.unionAll(answers).filter("dns_query_id is not null")
    both = both.withColumn("arrived_ms", F.unix_millis(F.current_timestamp()))
    state = f"{checkpoint.rstrip('/')}/queue"

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, out, state, batch_id, again_seconds * 1000, keep_seconds * 1000)

    return (both.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "3 minutes"})).start())


def add_batch(batch: DataFrame, out: str, state: str, batch_id: int, again_ms: int, keep_ms: int) -> None:
    """Adds a batch's rows to the state and writes the events that follow.

    A batch writes the state of the queries that it changes into a folder of its number, and
    every `MERGE_EVERY` batches the state of all; the newest row of a query counts. A batch
    that runs again reads what earlier ones left and replaces what it wrote itself. State and
    new rows meet in one aggregate by query, with map-side combine.
    """
    spark = batch.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # streams start without it; it is the session of this stream alone
    first_row = batch.select("arrived_ms").first()
    now = first_row.arrived_ms if first_row else 0  # without rows nothing is due
    base, whole = batch_id - batch_id % MERGE_EVERY, batch_id % MERGE_EVERY == 0
    before = max(batch_id - 1, 0) // MERGE_EVERY * MERGE_EVERY

    new = F.struct("first_seen", "source_ip", "fqdn", "observable_ip")
    empty = F.lit(None)
    held_type = "struct<batch_id: int, answered: boolean, until_ms: bigint, attempt: int, source_ip: string, fqdn: string, " \
                "observable_ip: string, first_seen: timestamp_ntz>"
    rows = batch.select("dns_query_id", "answer", F.when(~F.col("answer"), new).alias("new"), empty.cast(held_type).alias("held"))
    if batch_id > 0:
        known = spark.read.schema(f"{_STATE}, batch_id int").parquet(f"{state}/base={before}").filter(F.col("batch_id") < batch_id)
        held = F.struct("batch_id", "answered", "until_ms", "attempt", *_ENTRY)
        rows = rows.unionAll(known.select("dns_query_id", F.lit(False).alias("answer"),
                                          empty.cast(rows.schema["new"].dataType).alias("new"), held.cast(held_type).alias("held")))
    found = rows.groupBy("dns_query_id").agg(F.max("answer").alias("answer"), F.min("new").alias("new"), F.max("held").alias("held"))

    forgotten = F.col("held.answered") & (F.col("held.until_ms") <= now)
    found = found.withColumn("held", F.when(F.col("held").isNotNull() & ~forgotten, F.col("held")))
    has, waits = F.col("held").isNotNull(), ~F.col("held.answered")
    change = (F.when(has & F.col("held.answered"), None)
              .when(F.col("answer"), F.when(has & waits, "answered").otherwise("remembered"))
              .when(has, F.when(F.col("held.until_ms") <= now, "again"))
              .when(F.col("new").isNotNull(), "first"))
    found = found.withColumn("change", change)
    is_first, is_again = F.col("change") == "first", F.col("change") == "again"
    ends = F.col("change").isin("answered", "remembered")
    changed = found.filter("change is not null or held is not null" if whole else "change is not null").select(
        "dns_query_id", F.when(F.col("change").isNull(), F.col("held.answered")).otherwise(ends).alias("answered"),
        F.when(ends, now + keep_ms).when(is_first, now + again_ms).when(is_again, F.col("held.until_ms") + again_ms)
        .otherwise(F.col("held.until_ms")).alias("until_ms"),
        F.when(is_first, 1).when(is_again, F.col("held.attempt") + 1).otherwise(F.col("held.attempt")).alias("attempt"),
        *[F.when(is_first, F.col(f"new.{c}")).otherwise(F.col(f"held.{c}")).alias(c) for c in _ENTRY],
        F.when(is_first | is_again, "waiting").when(F.col("change") == "answered", "answered").alias("event"))
    own = f"{state}/base={base}/batch_id={batch_id}"
    changed.write.mode("overwrite").parquet(own)

    events = spark.read.schema(_STATE).parquet(own).filter("event is not null")
    (events.select("dns_query_id", F.col("event").alias("state"), *_ENTRY, "attempt", F.lit(batch_id).alias("batch_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))
    if whole and before >= MERGE_EVERY:  # `before` itself is needed if this batch runs again
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/base={before - MERGE_EVERY}")
        done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)


def open_entries(events: DataFrame) -> DataFrame:
    """The entries that wait, with their latest attempt, from the events of `stream_queue`."""
    last = F.max(F.struct(F.col("state") == "answered", "attempt", "source_ip", "fqdn", "observable_ip", "first_seen"))
    entries = events.groupBy("dns_query_id").agg(last.alias("e"))
    return entries.filter("not e.col1").select("dns_query_id", "e.source_ip", "e.fqdn", "e.observable_ip", "e.first_seen",
                                               "e.attempt")
