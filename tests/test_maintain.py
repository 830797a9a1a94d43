from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.times import ntz
from tidewatch.operators import maintain

TODAY = datetime(2026, 8, 31, 4)
MONTHS = ["202512", "202601", "202602", "202607", "202608", "202609"]


@pytest.fixture
def table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS mt")
    spark.sql("DROP TABLE IF EXISTS mt.dns_queries")
    df = spark.createDataFrame([(i, m) for i, m in enumerate(MONTHS)], "id int, ym string")
    df.write.partitionBy("ym").format("parquet").saveAsTable("mt.dns_queries")
    yield "mt.dns_queries"
    spark.sql("DROP TABLE IF EXISTS mt.dns_queries")


def outcome(log):
    return [(r.table_name, r.partition_name, r.action) for r in log.orderBy("partition_name").collect()]


def test_drop_removes_months_below_the_cutoff(spark, table):
    log = maintain.drop_old_partitions(spark, [table], TODAY)
    assert outcome(log) == [(table, "p202512", "DROP"), (table, "p202601", "DROP")]
    assert [r.ym for r in spark.table(table).orderBy("ym").collect()] == MONTHS[2:]
    assert maintain.drop_old_partitions(spark, [table], TODAY).count() == 0


def test_failed_statement_is_logged_and_the_next_one_runs(spark, table):
    log = maintain._run_ddl(spark, [
        ("t", "p1", "ALTER TABLE mt.absent DROP PARTITION (ym = '1')"),
        (table, "p202512", f"ALTER TABLE {table} DROP PARTITION (ym = '202512')")], "DROP", TODAY)
    assert outcome(log) == [("t", "p1", "DROP_FAILED"), (table, "p202512", "DROP")]
    assert log.filter("error_message IS NOT NULL").count() == 1


def test_add_creates_only_missing_months(spark, table):
    log = maintain.add_future_partitions(spark, [table], TODAY)
    assert outcome(log) == [(table, "p202610", "ADD"), (table, "p202611", "ADD")]
    assert maintain.add_future_partitions(spark, [table], TODAY).count() == 0


def test_add_works_on_an_empty_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS mt")
    spark.sql("CREATE TABLE mt.fresh (id INT, ym STRING) USING parquet PARTITIONED BY (ym)")
    assert [p for _, p, _ in outcome(maintain.add_future_partitions(spark, ["mt.fresh"], TODAY))] == [
        "p202609", "p202610", "p202611"]
    spark.sql("DROP TABLE mt.fresh")


def test_retained_and_expired_split_everything(spark, rows):
    df = spark.createDataFrame([(f"{m[:4]}-{m[4:]}-15 00:00:00",) for m in MONTHS], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    kept = maintain.retained(df, "t", ntz("2026-08-31 00:00:00"))
    parts = df.select(F.concat(F.lit("p"), F.date_format("t", "yyyyMM")).alias("partition_name"))
    gone = maintain.expired_partitions(parts, ntz("2026-08-31 00:00:00"))
    assert kept.count() + gone.count() == len(MONTHS)
    assert rows(gone) == [("p202512",), ("p202601",)]


def test_other_names_are_never_chosen(spark):
    parts = spark.createDataFrame([("p_future",), ("p20250",), ("p2025011",), ("x202501",)], "partition_name string")
    assert maintain.expired_partitions(parts, ntz("2026-08-31 00:00:00")).count() == 0


@pytest.mark.parametrize("time,name", [
    ("2020-01-01", "p202604"), ("2026-04-30", "p202604"), ("2026-05-01", "p202605"), ("2026-07-31", "p202607"),
    ("2026-08-01", "p_future")])
def test_range_partition_names(spark, time, name):
    df = spark.range(1).select(maintain.partition_of(ntz(f"{time} 00:00:00"), "202604", "202607").alias("p"))
    assert df.first().p == name


def test_info_counts_rows_and_bytes(spark, tmp_path, rows):
    df = spark.range(0, 1000, 1, 4).select("id", ntz("2024-01-31 00:00:00").alias("ts"))
    path = str(tmp_path / "t")
    maintain.write_partitioned(df, "ts", path)
    maintain.write_partitioned(df.withColumn("ts", ntz("2024-02-01 00:00:00")), "ts", path)
    info = maintain.partition_info(spark, {"t": path})
    assert rows(info, "table_name", "partition_name", "table_rows") == [("t", "p202401", 1000), ("t", "p202402", 1000)]
    assert rows(maintain.partition_counts(info)) == [("t", 2)]
    assert maintain.partition_sample(info, 1).first().partition_name == "p202401"


def test_large_month_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    try:
        df = spark.range(0, 200_000, 1, 8).select(
            F.sha2(F.col("id").cast("string"), 256).alias("v"), ntz("2024-01-31 00:00:00").alias("ts"))
        maintain.write_partitioned(df, "ts", str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "ym=202401").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_recent_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in (1, 2):
        rows = spark.createDataFrame([("t", f"p{i}", "DROP", None, datetime(2026, 1, day)) for i in range(15)],
                                     maintain.MAINTENANCE_LOG)
        maintain.log_maintenance(rows, path)
    newest = maintain.recent_maintenance(spark.read.parquet(path)).collect()
    assert len(newest) == 20 and newest[0].executed_at == datetime(2026, 1, 2)
