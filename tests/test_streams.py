from datetime import datetime, timedelta

from tidewatch.operators import bursts, reports
from tidewatch.schemas import DNS_QUERIES
from tidewatch.streaming import jobs

START = datetime(2024, 1, 1)


def dns_rows(hours, per_hour):
    return [(str(h * per_hour + i), START + timedelta(hours=h, seconds=30 * i), "reply", "A", f"d{i % 3}.com",
             f"10.0.0.{i % 2}", f"1.1.{h}.{i}") for h in hours for i in range(per_hour)]


def test_hourly_stream_equals_batch_over_several_files(spark, rows, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    everything = []
    for hours in ([0, 1], [2, 3], [4]):
        data = dns_rows(hours, 10)
        everything += data
        spark.createDataFrame(data, DNS_QUERIES).coalesce(1).write.mode("append").parquet(inbox)
        jobs.drain(jobs.stream_hourly(spark.readStream.schema(DNS_QUERIES).parquet(inbox)), out, state)
    batch = reports.dns_hourly_traffic(spark.createDataFrame(everything, DNS_QUERIES)).drop("raw_time")
    # The watermark is ten minutes behind 04:04:30, so the hour from 03:00 is still open.
    closed = batch.filter("hour_group < '2024-01-01 03:00:00'")
    assert rows(spark.read.parquet(out), *closed.columns) == rows(closed)


def test_pending_stream_sees_new_indicators(spark, rows, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    known = []
    for hour, seen in ((0, [0, 1]), (1, [5, 6])):
        known += seen
        spark.createDataFrame(dns_rows([hour], 5), DNS_QUERIES).write.mode("append").parquet(inbox)
        jobs.stream_pending(spark.readStream.schema(DNS_QUERIES).parquet(inbox),
                            lambda: spark.createDataFrame([(str(i),) for i in known], "dns_query_id string"),
                            out, state, availableNow=True).awaitTermination()
    assert rows(spark.read.parquet(out), "dns_query_id") == [(str(i),) for i in (2, 3, 4, 7, 8, 9)]


def burst_stream(spark, tmp_path, data, **options):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(data, "who string, at timestamp_ntz").coalesce(1).write.parquet(inbox)
    stream = spark.readStream.schema("who string, at timestamp_ntz").parquet(inbox)
    query = jobs.stream_bursts(stream, "who", "at", out, state, availableNow=True, **options)
    query.awaitTermination()
    return spark.read.parquet(out), bursts.burst_offenders(spark.read.parquet(inbox), "who", "at"), query


def test_burst_stream_finds_the_batch_offenders(spark, rows, tmp_path):
    seconds = {"a": (0, 60, 120, 4000), "b": (0, 3600), "c": (30, 300, 629), "d": (30, 300, 631), "e": (599, 600, 601)}
    data = [(who, START + timedelta(seconds=s)) for who, all_s in seconds.items() for s in all_s]
    data.append(("z", START + timedelta(days=1)))
    found, batch, query = burst_stream(spark, tmp_path, data)
    columns = ["who", "flagged_at", "failures", "banned_until"]
    assert rows(found, *columns) == rows(batch, *columns)
    assert rows(batch, "who") == [("a",), ("c",), ("e",)]
    assert jobs.late_rows(query) == 0


def test_months_of_a_stream_are_compacted_and_retained(spark, rows, tmp_path):
    from pyspark.sql import functions as F
    from tidewatch.operators import maintain
    from tidewatch.sources import logs
    staged, out = str(tmp_path / "staged"), str(tmp_path / "dns")
    lines = [f"query[A] {'x' * (300 if i % 5 == 0 else 3)}{i}.com from 10.0.0.{i}" for i in range(20)]
    for batch, month in enumerate(("2023-01-05", "2023-01-20", "2024-05-01")):
        parsed = logs.parse_dns_lines(spark.createDataFrame([(x,) for x in lines], "value string"),
                                      F.lit(month).cast("timestamp"))
        logs.write_dns(parsed.withColumn("batch_id", F.lit(batch)), staged, "overwrite", ["batch_id"])
    for _ in range(2):
        jobs.compact_dns(spark, staged, out, "202406")
    assert logs.read_dns(spark, out).count() == 48 and logs.read_dns(spark, out, "rejected").count() == 12
    spark.sql(f"CREATE TABLE dns_stored USING parquet LOCATION '{out}'")
    spark.sql("MSCK REPAIR TABLE dns_stored")
    try:
        log = maintain.drop_old_partitions(spark, ["dns_stored"], datetime(2024, 6, 15))
        assert rows(log, "partition_name", "action") == [("p202301", "DROP")] * 2
        assert spark.table("dns_stored").count() == 20
        log = maintain.add_future_partitions(spark, ["dns_stored"], datetime(2024, 6, 15))
        assert rows(log, "partition_name", "action") == sorted(
            [(f"p20240{m}", "ADD") for m in (7, 8, 9)] * 2)
        assert maintain.add_future_partitions(spark, ["dns_stored"], datetime(2024, 6, 15)).count() == 0
    finally:
        spark.sql("DROP TABLE dns_stored")
