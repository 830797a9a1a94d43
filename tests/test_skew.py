"""One key holds a third of all rows: results stay whole and the hot key is split."""

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.shaping import spread_join
from tidewatch.operators import enrich, filters, registry, reports
from tidewatch.sources import raw_reports

N = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # Two of three keys are of their own, the rest is key 7.
    yield spark.range(0, N, 1, 12).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1000))
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_join_splits_a_hot_key_beside_an_aggregate(hot):
    facts = hot.withColumn("pad", F.repeat(F.lit("x"), F.lit(40)))
    side = hot.groupBy("k").agg(F.count("*").alias("n"))
    joined = spread_join(facts, side, ["k"], "left")
    assert "skew=true" in final_plan(joined)
    assert joined.agg(F.sum("n")).first()[0] == (N // 3) ** 2 + 2 * N // 3
    # Without it the aggregated side has no shuffle of its own and nothing is split.
    assert "skew=true" not in final_plan(facts.join(side, "k", "left"))


def test_latest_reports_of_a_hot_query(hot, spark):
    ti = hot.select(F.col("id"), F.col("k").alias("dns_query_id"), F.lit(2).alias("type_id"),
                    (F.col("id") % 5).alias("analysis_result_id"), F.lit("2024-01-01").alias("last_scan"),
                    F.lit(1).alias("scan_count"))
    ar = spark.createDataFrame([(i, i + 1, "l", "e", "p", 1.0) for i in range(5)], "id long, threat_score int, "
                               "threat_label string, verdict_summary_en string, analysis_pl string, "
                               "confidence_score double")
    latest = reports.latest_threat_reports(ti, ar)
    assert "skew=true" in final_plan(latest)
    assert latest.count() == N  # every scan of a query is a tie


def test_events_of_a_hot_indicator(hot, spark):
    events = hot.select("id", F.lit("2024-01-01").alias("timestamp"), F.lit(1).cast("bigint").alias("dns_query_id"),
                        F.col("k").cast("string").alias("threat_indicator_id"), F.lit("a").alias("source_ip"),
                        F.lit("b").alias("dest_ip"), F.lit("u").alias("request_url"), F.lit("e").alias("event_type"),
                        F.lit("x").alias("action_taken"))
    ti = hot.select(F.col("k").cast("string").alias("id"), F.lit(1).alias("analysis_result_id")).distinct()
    dns = spark.sql("SELECT 1L AS id, 'd.com' AS domain")
    ar = spark.sql("SELECT 1 AS id, 5 AS threat_score")
    once = ti.select(F.col("id").alias("indicator_id"), F.lit(1).alias("source_id"))
    details = once.unionAll(once.filter("indicator_id = '7'"))
    out = reports.threat_explorer(events, dns, ti, ar, schemas.threat_levels(spark), details,
                                  schemas.source_providers(spark))
    assert "skew=true" in final_plan(out)
    assert out.count() == N
    assert out.filter("providers = 'VirusTotal, VirusTotal'").count() == N // 3


def test_queue_with_a_hot_domain(hot, spark):
    pending = hot.select(F.col("id").alias("dns_query_id"), F.concat(F.lit("d"), "k").alias("fqdn"),
                         F.col("id").cast("string").alias("observable_ip"), F.lit("N/A").alias("source_ip"))
    docs = hot.select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("d"), "k").alias("resource"),
                      F.lit("Abuse_ThreatFox").alias("source_provider"), F.lit("2024").alias("scan_date"),
                      F.lit('{"query_status":"ok","data":[{"malware_printable":"F","confidence_level":1}]}')
                      .alias("raw_data"))
    found = raw_reports.latest_by_provider(docs, {"vt": "VirusTotal", "tf": "Abuse_ThreatFox", "uh": "Abuse_URLhaus"})
    out = enrich.merge_context(pending, found, schemas.threat_levels(spark))
    assert "skew=true" in final_plan(out)
    assert out.filter("tf_active AND tf_families = 'F'").count() == N


def test_hot_domain_against_a_blocklist(hot):
    dns = hot.select("id", F.concat(F.lit("D"), "k").alias("domain"))
    listed = hot.filter("k = 7").select(F.concat(F.lit("d"), "k").alias("domain"))
    blocked, allowed = filters.blocked_queries(dns, listed), filters.allowed_queries(dns, listed)
    assert "skew=true" in final_plan(allowed)
    assert (blocked.count(), allowed.count()) == (N // 3, N - N // 3)


def test_hot_missing_parent(hot, spark):
    parents = hot.filter("k <> 7").select(F.col("k").alias("id"))
    lost = registry.orphans(hot.withColumn("pad", F.repeat(F.lit("x"), F.lit(40))), parents, "k")
    assert "skew=true" in final_plan(lost)
    assert lost.count() == N // 3


def test_copies_of_one_key_shrink_before_the_shuffle(hot):
    df = hot.select("k", F.lit(1).alias("j"), F.col("id").alias("v"))
    first = registry.enforce_unique(df, ["k", "j"], ["v"])
    assert first.count() == 2 * N // 3 + 1
    assert first.filter("k = 7").first().v == 0
    assert "Window" not in final_plan(first)


def test_keys_of_different_types_are_refused(spark):
    with pytest.raises(TypeError):
        spread_join(spark.sql("SELECT 1 AS k"), spark.sql("SELECT 1L AS k"), ["k"])
