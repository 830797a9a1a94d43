"""Reporting joins and aggregates over the core tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.net import is_ipv4
from tidewatch.functions.shaping import spread_join
from tidewatch.functions.text import concat_distinct
from tidewatch.functions.times import epoch_seconds, hour_label
from tidewatch.operators.filters import malicious_legacy, malicious_only, with_level
from tidewatch.session import stored


def pending_analysis(dns: DataFrame, ti: DataFrame) -> DataFrame:
    """DNS rows with an IPv4 answer that no indicator refers to yet.

    `id` is the table's key, so a group is one row. Both the anti-join and the
    grouping use the partitioning on `id`: each side is shuffled once, and the
    indicators shrink to their distinct query ids before they move.
    """
    scanned = ti.select(F.col("dns_query_id").alias("id")).distinct()
    waiting = dns.filter(is_ipv4(F.col("response_ip"))).join(scanned, "id", "left_anti")
    return (waiting.groupBy("id", "source_ip", "domain")
            .agg(concat_distinct(F.col("response_ip")).alias("observable_ip"),
                 F.min("timestamp").alias("first_seen"))
            .select(F.col("id").alias("dns_query_id"), "source_ip", F.col("domain").alias("fqdn"),
                    "observable_ip", "first_seen", F.lit(1).cast("bigint").alias("query_count")))


def next_pending(pending: DataFrame, n: int | None = None) -> DataFrame:
    """The queue in order of arrival; all of it unless `n` is given."""
    ordered = pending.orderBy("first_seen", "dns_query_id")
    return ordered if n is None else ordered.limit(n)


def latest_threat_reports(ti: DataFrame, ar: DataFrame) -> DataFrame:
    """Indicators at the newest scan time of their DNS query, with their verdict.

    Ties stay, and the newest time is found before the verdict join. The maximum
    is a plain aggregate with map-side combine, joined back on query and time: a
    window would bring all scans of one query into one task.
    """
    newest = ti.groupBy("dns_query_id").agg(F.max("last_scan").alias("last_scan"))
    verdicts = ar.withColumnRenamed("id", "analysis_result_id")
    latest = ti.join(newest, ["dns_query_id", "last_scan"]).join(verdicts, "analysis_result_id")
    return latest.select("id", "dns_query_id", "type_id", "analysis_result_id", "last_scan", "scan_count",
                         "threat_score", "threat_label", "verdict_summary_en", "analysis_pl", "confidence_score")


def latest_since(ti: DataFrame, ar: DataFrame, start: Column, end: Column) -> DataFrame:
    """Latest reports with a newest scan inside the range.

    Only the lower bound moves below the maximum: older rows cannot be the
    newest scan of a query that passes, whereas newer rows can hide one.
    """
    recent = ti.filter(F.col("last_scan") >= start)
    return latest_threat_reports(recent, ar).filter(F.col("last_scan") <= end)


def _flag_count(flag: bool) -> Column:
    return F.sum(F.when(F.col("is_malicious_flag") == flag, 1).otherwise(0))


def _percentage(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0)) * 100


def malicious_stats(latest: DataFrame, levels: DataFrame) -> DataFrame:
    """One row; an empty input gives 0 and NULLs."""
    total, bad = F.count("id"), _flag_count(True)
    return with_level(latest, levels).agg(
        total.alias("total_scans"),
        bad.alias("total_malicious_scans"),
        F.round(_percentage(bad, total), 2).alias("malicious_percentage"),
        F.max("last_scan").alias("last_scan"),
        F.min("last_scan").alias("first_scan"))


def malicious_stats_legacy(latest: DataFrame, threshold: int = 5) -> DataFrame:
    """Older form: fixed threshold, percentage not rounded, no dictionary."""
    total = F.count("id")
    bad = F.sum(F.when(F.col("threat_score") > threshold, 1).otherwise(0))
    return latest.agg(
        total.alias("total_scans"), bad.alias("total_malicious_scans"),
        _percentage(bad, total).alias("malicious_percentage"), F.max("last_scan").alias("last_scan"))


def daily_trends(latest: DataFrame, levels: DataFrame) -> DataFrame:
    return (with_level(latest, levels)
            .groupBy(F.to_date("last_scan").alias("scan_date"))
            .agg(epoch_seconds(F.to_date(F.max("last_scan")).cast("timestamp_ntz")).alias("time_sec"),
                 F.count("id").alias("total_scans_per_day"),
                 _flag_count(True).alias("total_positives_per_day"),
                 _flag_count(False).alias("total_clean_per_day"),
                 F.max("threat_score").alias("max_threat_score_that_day"),
                 F.round(F.avg("threat_score"), 4).alias("avg_threat_score"))
            .orderBy(F.desc("scan_date")))


def daily_trends_legacy(latest: DataFrame, threshold: int = 5) -> DataFrame:
    return (latest.groupBy(F.to_date("last_scan").alias("scan_date"))
            .agg(epoch_seconds(F.to_date(F.max("last_scan")).cast("timestamp_ntz")).alias("time_sec"),
                 F.count("id").alias("total_scans_per_day"),
                 F.sum(F.when(F.col("threat_score") > threshold, 1).otherwise(0)).alias("total_positives_per_day"),
                 F.max("threat_score").alias("max_threat_score_that_day")))


def dns_hourly_traffic(dns: DataFrame) -> DataFrame:
    """Traffic per hour, newest first.

    Groups by the hour's number and formats it once per group. `raw_time` is the
    name that the panel asks for, `latest_query` the one that the view defines.
    """
    hour = (epoch_seconds(F.col("timestamp")) / 3600).cast("bigint") * 3600
    return (dns.groupBy(hour.alias("time_sec"))
            .agg(F.count("id").alias("total_queries"),
                 F.countDistinct("domain").alias("unique_domains"),
                 F.countDistinct("source_ip").alias("unique_sources"),
                 F.max("timestamp").alias("latest_query"))
            .select(hour_label(F.col("latest_query")).alias("hour_group"), "time_sec", "total_queries",
                    "unique_domains", "unique_sources", "latest_query",
                    F.col("latest_query").alias("raw_time"))
            .orderBy(F.desc("hour_group")))


def providers_per_indicator(details: DataFrame, providers: DataFrame) -> DataFrame:
    """Provider names of an indicator in order, repeated rows repeated.

    Details are counted per indicator and provider with map-side combine, and the
    list is written from the counts: however many rows an indicator has, its group
    holds a row per provider. Ids without a name are left out.
    """
    counted = details.groupBy("indicator_id", "source_id").agg(F.count("*").cast("int").alias("n"))
    named = counted.join(providers.filter("name is not null").select(F.col("id").alias("source_id"), "name"), "source_id")
    entries = F.array_sort(F.collect_list(F.struct("name", "n")))
    repeated = F.flatten(F.transform(entries, lambda e: F.array_repeat(e["name"], e["n"])))
    return named.groupBy("indicator_id").agg(F.concat_ws(", ", repeated).alias("providers"))


def _explore(ne: DataFrame, dns: DataFrame, ti: DataFrame, verdicts: DataFrame, details: DataFrame,
             providers: DataFrame) -> DataFrame:
    """Events of the given verdicts. Starts from the verdicts, the selective side,
    so that indicators and events are cut down before they are joined further, and
    providers are listed for its indicators alone. Flagged indicators serve twice;
    they are found once and stored, which also tells the planner their size."""
    flagged = stored(ti.select(F.col("id").alias("threat_indicator_id"), "analysis_result_id")
                     .join(verdicts.withColumnRenamed("id", "analysis_result_id"), "analysis_result_id")
                     .drop("analysis_result_id"), "flagged")
    events = (ne.withColumnRenamed("id", "event_id")
              .join(flagged, "threat_indicator_id")
              .join(dns.select(F.col("id").alias("dns_query_id"), F.col("domain").alias("fqdn")), "dns_query_id"))
    wanted = details.join(flagged.select(F.col("threat_indicator_id").alias("indicator_id")), "indicator_id", "left_semi")
    listed = providers_per_indicator(wanted, providers).withColumnRenamed("indicator_id", "threat_indicator_id")
    return spread_join(events, listed, ["threat_indicator_id"], "left")


def threat_explorer(ne: DataFrame, dns: DataFrame, ti: DataFrame, ar: DataFrame, levels: DataFrame,
                    details: DataFrame, providers: DataFrame) -> DataFrame:
    """Malicious network events with domain, providers and recommended action, newest first."""
    verdicts = malicious_only(ar.select("id", "threat_score"), levels).select(
        "id", "threat_score", F.col("description").alias("threat_label"), "action_recommended")
    # The event id makes the order total and keeps equal times spread over the sort's tasks.
    return (_explore(ne, dns, ti, verdicts, details, providers)
            .orderBy(F.desc("timestamp"), "event_id")
            .select("timestamp", "fqdn", "source_ip", "dest_ip", "request_url", "event_type", "providers",
                    "threat_label", "action_recommended", "threat_score", "action_taken"))


def threat_explorer_legacy(ne: DataFrame, dns: DataFrame, ti: DataFrame, ar: DataFrame, levels: DataFrame,
                           details: DataFrame, providers: DataFrame, threshold: int = 5) -> DataFrame:
    """Older form: fixed threshold, fewer columns, no order."""
    verdicts = with_level(malicious_legacy(ar.select("id", "threat_score"), threshold), levels).select(
        "id", "threat_score", F.col("description").alias("threat_label"))
    return _explore(ne, dns, ti, verdicts, details, providers).select(
        "timestamp", "fqdn", "source_ip", "request_url", "providers", "threat_label", "threat_score")


def _alert_rows(ti: DataFrame, dns: DataFrame, verdicts: DataFrame) -> DataFrame:
    flagged = ti.withColumnRenamed("id", "indicator_id").join(
        verdicts.withColumnRenamed("id", "analysis_result_id"), "analysis_result_id")
    queries = dns.select(F.col("id").alias("dns_query_id"), F.col("timestamp").alias("detection_time"),
                         F.col("domain").alias("fqdn"), "record_type", "source_ip",
                         F.col("response_ip").alias("observable_ip"))
    return flagged.join(queries, "dns_query_id").withColumnsRenamed(
        {"description": "level", "verdict_summary_en": "verdict_en"})


def threat_alerts(ti: DataFrame, dns: DataFrame, ar: DataFrame, levels: DataFrame) -> DataFrame:
    """Malicious indicators with their DNS query; newest detection, then highest score."""
    rows = _alert_rows(ti, dns, malicious_only(ar, levels))
    return (rows.orderBy(F.desc("detection_time"), F.desc("threat_score"), "indicator_id")
            .select("indicator_id", "detection_time", "fqdn", "record_type", "source_ip", "observable_ip",
                    "threat_score", F.col("level").alias("threat_label"), "is_malicious_flag",
                    "action_recommended", "verdict_en", "analysis_pl", "confidence_score",
                    "scan_count", "last_scan"))


def threat_alerts_legacy(ti: DataFrame, dns: DataFrame, ar: DataFrame, levels: DataFrame,
                         threshold: int = 0) -> DataFrame:
    rows = _alert_rows(ti, dns, with_level(malicious_legacy(ar, threshold), levels))
    return (rows.orderBy(F.desc("detection_time"), "indicator_id")
            .select("indicator_id", "detection_time", "fqdn", "record_type", "observable_ip", "threat_score",
                    F.col("level").alias("threat_label"), "is_malicious_flag", "verdict_en", "analysis_pl"))


def resolve_ids(df: DataFrame, dictionary: DataFrame, name_col: str, id_col: str, how: str = "inner") -> DataFrame:
    """Name to dictionary id. `inner` drops unknown names (providers), `left` keeps them (types)."""
    return df.join(dictionary.select(F.col("name").alias(name_col), F.col("id").alias(id_col)), name_col, how)


def provider_efficacy(explorer: DataFrame) -> DataFrame:
    return explorer.groupBy("providers").agg(F.count("*").alias("detections"))


def top_fqdns(explorer: DataFrame, k: int = 10) -> DataFrame:
    hits = explorer.groupBy("fqdn").agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), "fqdn").limit(k)


def score_envelope(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.round(F.avg("threat_score"), 4).alias("avg_score"),
                      F.max("threat_score").alias("max_score"), F.min("threat_score").alias("min_score"))


def last_not_null(df: DataFrame, col: str, order: str) -> DataFrame:
    """Panel reducer: the last value of `col` by `order` that is not NULL, the greater one on a tie."""
    return df.filter(F.col(col).isNotNull()).agg(F.max(F.struct(order, F.col(col).alias("value")))["value"].alias(col))
