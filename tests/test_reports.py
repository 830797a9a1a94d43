from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewatch import schemas
from tidewatch.functions.times import ntz
from tidewatch.operators import filters, reports
from tidewatch.plans import panels
from tidewatch.plans.catalog import Data


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, SMALL)


def test_latest_equals_self_join(data, rows):
    ti, ar = data.threat_indicators, data.ai_analysis_results
    top = ti.groupBy("dns_query_id").agg(F.max("last_scan").alias("top"))
    expected = (ti.alias("i").join(top.alias("t"), "dns_query_id").filter("last_scan = top")
                .join(ar.select(F.col("id").alias("analysis_result_id")), "analysis_result_id"))
    assert rows(data.latest(), "id", "last_scan") == rows(expected, "id", "last_scan")
    assert data.latest().count() == 1454 and data.latest().select("dns_query_id").distinct().count() == 1450


def test_latest_row_with_dangling_verdict_removes_the_query(spark, rows):
    ti = spark.createDataFrame(
        [("a", 1, 2, 10, "2024-01-01", 1), ("b", 1, 2, 99, "2024-01-02", 1), ("c", 2, 2, 10, "2024-01-01", 1),
         ("d", 2, 2, 10, "2024-01-01", 1)],
        "id string, dns_query_id int, type_id int, analysis_result_id int, last_scan string, scan_count int")
    ar = spark.createDataFrame([(10, 3, "l", "e", "p", 1.0)], "id int, threat_score int, threat_label string, "
                               "verdict_summary_en string, analysis_pl string, confidence_score double")
    assert rows(reports.latest_threat_reports(ti, ar), "id") == [("c",), ("d",)]


def test_range_below_the_maximum_is_safe(data, rows):
    start, end = ntz("1999-01-01 00:00:00"), ntz("2000-06-30 00:00:00")
    plain = data.latest().filter(F.col("last_scan").between(start, end))
    assert rows(reports.latest_since(data.threat_indicators, data.ai_analysis_results, start, end)) == rows(plain)


def test_stats_of_the_fixture_and_of_nothing(data):
    assert tuple(data.stats().first())[:3] == (1454, 542, 37.28)
    empty = reports.malicious_stats(data.latest().filter("false"), data.levels).first()
    assert tuple(empty) == (0, None, None, None, None)


def test_positives_and_clean_add_up(data):
    bad = data.trends().filter("total_positives_per_day + total_clean_per_day > total_scans_per_day")
    assert bad.count() == 0


def test_pending_shares_no_query_with_indicators(data):
    seen = data.threat_indicators.select("dns_query_id")
    assert data.pending().count() == 103 and data.pending().join(seen, "dns_query_id", "left_semi").count() == 0


def test_provider_lists_repeat_and_sort(spark, rows):
    details = spark.createDataFrame([("i", 1), ("i", 3), ("i", 1), ("j", 9), ("k", 2)],
                                    "indicator_id string, source_id int")
    expected = [("i", "Abuse_URLhaus, VirusTotal, VirusTotal"), ("k", "Abuse_ThreatFox")]
    assert rows(reports.providers_per_indicator(details, schemas.source_providers(spark))) == expected
    many = spark.createDataFrame([(i, f"p{i:03}") for i in range(300)] + [(300, None)], "id int, name string")
    assert rows(reports.providers_per_indicator(details, many)) == [
        ("i", "p001, p001, p003"), ("j", "p009"), ("k", "p002")]


def test_stats_panel_gates_the_finished_row(data):
    inside, outside = ntz("2001-10-01 00:00:00"), ntz("2001-06-01 00:00:00")
    stats = data.stats()
    assert panels.malicious_stats_panel(stats, inside, ntz("2002-01-01 00:00:00")).first()[0] == 1454
    assert panels.malicious_stats_panel(stats, outside, inside).count() == 0


def test_first_partial_day_falls_out_of_the_trend_panel(spark):
    day = spark.sql("SELECT DATE'2024-01-02' AS scan_date, 1 AS time_sec, 1 AS total_scans_per_day, "
                    "1 AS total_positives_per_day")
    assert panels.daily_trend_panel(day, ntz("2024-01-02 00:00:01"), ntz("2024-01-03 00:00:00")).count() == 0
    assert panels.daily_trend_panel(day, ntz("2024-01-02 00:00:00"), ntz("2024-01-03 00:00:00")).count() == 1


def test_month_filter_prunes_folders(spark, tmp_path):
    from tidewatch.operators import maintain
    from tidewatch.sources.tables import read_table
    maintain.write_partitioned(Data(spark, SMALL).threat_indicators, "last_scan", str(tmp_path / "t"))
    df = filters.time_filter(read_table(spark, "t", str(tmp_path)), "last_scan",
                             ntz("2000-01-15 00:00:00"), ntz("2000-02-10 00:00:00"), "ym")
    scan = next(l for l in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in l)
    pruning = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 200001" in pruning and "<= 200002" in pruning
    assert df.select(F.min("last_scan")).first()[0] >= datetime(2000, 1, 15)


def test_time_range_reaches_the_scan(data):
    df = reports.latest_since(data.threat_indicators, data.ai_analysis_results,
                              ntz("2000-01-01 00:00:00"), ntz("2001-01-01 00:00:00"))
    assert "GreaterThanOrEqual(l_shipdate" in df._jdf.queryExecution().executedPlan().toString()


def test_last_not_null(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "t int, v int")
    assert reports.last_not_null(df, "v", "t").first()[0] == 20
