"""Every query by name: callables over a folder with the test tables.

Queries end in plain columns: dates become strings and decimals doubles, so that
results of different engines compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schemas
from tidewatch.functions import net
from tidewatch.functions.styles import pick_severity, threshold_color
from tidewatch.functions.times import month_key, ntz
from tidewatch.operators import (attribution, bursts, constraints, enrich, filters, maintain, ranges, registry, reports,
                                 similar, upsert)
from tidewatch.plans import panels
from tidewatch.session import scratch_path, stored
from tidewatch.sources import lists, logs, raw_reports, tables
from tidewatch.sources.fixtures import derive
from tidewatch.streaming import jobs, queue, rollups

# Reference times: the data ends in 2001 (scans) and in January 2024 (events).
SCAN_START, SCAN_END = "2001-01-01 00:00:00", "2001-06-30 12:00:00"
SCAN_NOW = "2001-10-31 08:00:00"
DNS_START, DNS_END = "2024-01-08 00:30:00", "2024-01-15 12:00:00"
DNS_NOW = "2024-01-31 00:00:00"
#: Seconds within which a reply belongs to a query of its domain.
ASKED_WITHIN = 21_600
CONTEXT_PROVIDERS = {"vt": "VirusTotal", "tf": "Abuse_ThreatFox", "uh": "Abuse_URLhaus"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Data:
    """The reference tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.levels = schemas.threat_levels(spark)
        self.legacy_levels = schemas.legacy_threat_levels(spark)
        self.providers = schemas.source_providers(spark)
        self.types = schemas.indicator_types(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return derive(self.spark, self.dir, name)

    def stream(self, name: str) -> DataFrame:
        return derive(self.spark, self.dir, name, streaming=True)

    # Compositions that several queries share.
    def latest(self) -> DataFrame:
        return reports.latest_threat_reports(self.threat_indicators, self.ai_analysis_results)

    def stats(self) -> DataFrame:
        return reports.malicious_stats(self.latest(), self.levels)

    def trends(self) -> DataFrame:
        return reports.daily_trends(self.latest(), self.levels)

    def explorer(self) -> DataFrame:
        return reports.threat_explorer(
            self.network_events, self.dns_queries, self.threat_indicators, self.ai_analysis_results,
            self.levels, self.threat_indicator_details, self.providers)

    def alerts(self) -> DataFrame:
        return reports.threat_alerts(self.threat_indicators, self.dns_queries, self.ai_analysis_results, self.levels)

    def pending(self) -> DataFrame:
        return reports.pending_analysis(self.dns_queries, self.threat_indicators)

    def context(self) -> DataFrame:
        queue = stored(self.pending().drop("first_seen", "query_count"), "queue")
        merged = enrich.context_of_queue(queue, self.raw_reports, self.levels, CONTEXT_PROVIDERS)
        # The candidate score comes from outside; here it is derived from the id.
        return merged.withColumn("primary_score", (1 + F.col("dns_query_id") % 5).cast("int"))

    def scored(self) -> DataFrame:
        return enrich.apply_score_policy(enrich.detection_first(self.context()), self.levels)

    def parsed(self) -> DataFrame:
        return enrich.parse_verdicts(self.verdict_texts)

    def details(self) -> DataFrame:
        return enrich.provider_details(self.parsed(), self.raw_reports)

    def partitions(self) -> DataFrame:
        """Month partitions in use, from the rows of the three partitioned tables."""
        out = None
        for name, ts in [("dns_queries", "timestamp"), ("network_events", "timestamp"),
                         ("threat_indicators", "last_scan")]:
            months = getattr(self, name).select(
                F.lit(name).alias("table_name"), F.concat(F.lit("p"), month_key(F.col(ts))).alias("partition_name"))
            out = months if out is None else out.unionAll(months)
        return out.groupBy("table_name", "partition_name").agg(F.count("*").alias("table_rows"))


def _plain(df: DataFrame) -> DataFrame:
    casts = {T.DateType: "string", T.DecimalType: "double"}
    return df.withColumns({f.name: F.col(f.name).cast(casts[type(f.dataType)])
                           for f in df.schema.fields if type(f.dataType) in casts})


def query(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: _plain(fn(Data(spark, sf_dir)))
    return fn


# --- reports ---------------------------------------------------------------

@query
def pending_analysis(d: Data) -> DataFrame:
    return d.pending()


@query
def next_pending(d: Data) -> DataFrame:
    return reports.next_pending(d.pending(), 1)


@query
def pending_in_order(d: Data) -> DataFrame:
    return reports.next_pending(d.pending())


@query
def latest_threat_reports(d: Data) -> DataFrame:
    return d.latest()


@query
def latest_reports_in_range(d: Data) -> DataFrame:
    return reports.latest_since(d.threat_indicators, d.ai_analysis_results, ntz(SCAN_START), ntz(SCAN_END))


@query
def malicious_stats(d: Data) -> DataFrame:
    return d.stats()


@query
def malicious_stats_legacy(d: Data) -> DataFrame:
    stats = reports.malicious_stats_legacy(
        reports.latest_threat_reports(d.threat_indicators, d.legacy_results))
    return stats.withColumn("malicious_percentage", F.round("malicious_percentage", 8))


@query
def daily_trends(d: Data) -> DataFrame:
    return d.trends()


@query
def daily_trends_legacy(d: Data) -> DataFrame:
    return reports.daily_trends_legacy(reports.latest_threat_reports(d.threat_indicators, d.legacy_results))


@query
def dns_hourly_traffic(d: Data) -> DataFrame:
    return reports.dns_hourly_traffic(d.dns_queries)


@query
def providers_per_indicator(d: Data) -> DataFrame:
    return reports.providers_per_indicator(d.threat_indicator_details, d.providers)


@query
def threat_explorer(d: Data) -> DataFrame:
    return d.explorer()


@query
def threat_explorer_legacy(d: Data) -> DataFrame:
    return reports.threat_explorer_legacy(
        d.network_events, d.dns_queries, d.threat_indicators, d.legacy_results, d.legacy_levels,
        d.threat_indicator_details, d.providers)


@query
def threat_alerts(d: Data) -> DataFrame:
    return d.alerts()


@query
def threat_alerts_legacy(d: Data) -> DataFrame:
    return reports.threat_alerts_legacy(d.threat_indicators, d.dns_queries, d.legacy_results, d.legacy_levels)


@query
def verdicts_with_level(d: Data) -> DataFrame:
    return filters.with_level(d.ai_analysis_results, d.levels)


@query
def malicious_verdicts(d: Data) -> DataFrame:
    return filters.malicious_only(d.ai_analysis_results, d.levels)


@query
def malicious_verdicts_legacy(d: Data) -> DataFrame:
    return filters.malicious_legacy(d.legacy_results)


@query
def threat_scale_usage(d: Data) -> DataFrame:
    """Policy lines with the number of stored verdicts of each score."""
    used = d.ai_analysis_results.groupBy(F.col("threat_score").alias("score")).agg(F.count("*").alias("verdicts"))
    return filters.threat_scale(d.levels).join(used, "score", "left")


@query
def resolved_providers(d: Data) -> DataFrame:
    rows = d.raw_reports.select("doc_id", "source_provider")
    return reports.resolve_ids(rows, d.providers, "source_provider", "source_id")


@query
def resolved_types(d: Data) -> DataFrame:
    rows = d.raw_reports.select("doc_id", F.when(F.col("type") == "FQDN", "DOMAIN").otherwise(F.col("type")).alias("t"))
    return reports.resolve_ids(rows, d.types, "t", "type_id", "left")


# --- panels ----------------------------------------------------------------

@query
def provider_efficacy(d: Data) -> DataFrame:
    return reports.provider_efficacy(filters.time_filter(d.explorer(), "timestamp", ntz(SCAN_START), ntz(SCAN_END)))


@query
def top_fqdns(d: Data) -> DataFrame:
    return reports.top_fqdns(filters.time_filter(d.explorer(), "timestamp", ntz("1995-01-01 00:00:00"), ntz(SCAN_END)))


@query
def recent_malicious(d: Data) -> DataFrame:
    return filters.recent_malicious(filters.time_filter(d.explorer(), "timestamp", ntz(SCAN_START), ntz(SCAN_END)))


@query
def score_envelope(d: Data) -> DataFrame:
    return reports.score_envelope(d.alerts())


@query
def malicious_stats_panel(d: Data) -> DataFrame:
    return panels.malicious_stats_panel(d.stats(), ntz(SCAN_START), ntz("2001-12-31 00:00:00"))


@query
def malicious_stats_panel_out_of_range(d: Data) -> DataFrame:
    return panels.malicious_stats_panel(d.stats(), ntz(SCAN_START), ntz(SCAN_END))


@query
def daily_trend_panel(d: Data) -> DataFrame:
    start, end = ntz("2001-01-01 06:00:00"), ntz(SCAN_END)
    # scans before the range are never shown; later ones can replace one that would be
    recent = reports.latest_threat_reports(d.threat_indicators.filter(F.col("last_scan") >= start), d.ai_analysis_results)
    return panels.daily_trend_panel(reports.daily_trends(recent, d.levels), start, end)


@query
def hourly_panel(d: Data) -> DataFrame:
    start, end = ntz(DNS_START), ntz(DNS_END)
    shown = filters.whole_hours(d.dns_queries, "timestamp", start, end)
    return panels.hourly_panel(reports.dns_hourly_traffic(shown), start, end)


@query
def last_malicious_scan(d: Data) -> DataFrame:
    return filters.last_malicious_scan(d.stats())


@query
def last_not_null_positives(d: Data) -> DataFrame:
    rows = d.trends().withColumn("positives", F.nullif(F.col("total_positives_per_day"), F.lit(0)))
    return reports.last_not_null(rows, "positives", "time_sec")


@query
def daily_threshold_colors(d: Data) -> DataFrame:
    share = F.round(F.col("total_positives_per_day") / F.col("total_scans_per_day") * 100, 2)
    return d.trends().select("time_sec", share.alias("share")).withColumn("color", threshold_color(F.col("share")))


# --- addresses, lists, ingest ----------------------------------------------

@query
def answer_kinds(d: Data) -> DataFrame:
    return d.dns_queries.groupBy(net.is_ipv4(F.col("response_ip")).alias("is_ipv4"), "record_type").agg(
        F.count("*").alias("rows"))


@query
def address_ranges(d: Data) -> DataFrame:
    answer = F.coalesce("response_ip", "source_ip")
    return d.dns_queries.select("id", answer.alias("address"), net.is_private(answer).alias("private"),
                                net.in_cidr(answer, net.ACCESS_RANGES).alias("allowed"))


@query
def longest_ranges(d: Data) -> DataFrame:
    """Addresses with the longest range of a table that holds each."""
    addresses = d.dns_queries.select("id", F.coalesce("response_ip", "source_ip").alias("address"))
    return ranges.longest_range(addresses, "address", ranges.compile_ranges(d.range_list))


@query
def address_table(d: Data) -> DataFrame:
    """The table of ranges as compiled, and what is no range."""
    bad = ranges.invalid_ranges(d.range_list).select("range", F.lit(None).cast("int").alias("length"))
    return ranges.compile_ranges(d.range_list).select("range", "length").unionAll(bad)


@query
def blocklist_sources(d: Data) -> DataFrame:
    return lists.blocklist_sources(d.list_addresses)


@query
def blocklist(d: Data) -> DataFrame:
    return lists.compile_blocklist(d.list_lines)


@query
def blocked_queries(d: Data) -> DataFrame:
    return filters.blocked_queries(d.dns_queries, lists.compile_blocklist(d.list_lines))


@query
def allowed_queries(d: Data) -> DataFrame:
    return filters.allowed_queries(d.dns_queries, lists.compile_blocklist(d.list_lines))


@query
def filter_list(d: Data) -> DataFrame:
    return lists.compile_blocklist(d.filter_lines)


@query
def list_junk(d: Data) -> DataFrame:
    return lists.list_junk(d.filter_lines)


@query
def blocked_below(d: Data) -> DataFrame:
    return filters.blocked_below(d.host_queries, lists.compile_blocklist(d.filter_lines))


@query
def allowed_outside(d: Data) -> DataFrame:
    return filters.allowed_outside(d.host_queries, lists.compile_blocklist(d.filter_lines))


@query
def seeded_providers(d: Data) -> DataFrame:
    """Document sources and the known providers as one dictionary of names."""
    found = d.spark.read.parquet(f"{d.dir}/documents.parquet").select(F.col("source").alias("name"))
    return lists.seed_dictionary(d.providers.select("name"), found.unionAll(d.providers.select("name")), "name")


@query
def parsed_log(d: Data) -> DataFrame:
    return logs.parse_dns_lines(d.log_lines, ntz(DNS_NOW))


def _stored_log(d: Data, status: str) -> DataFrame:
    path = scratch_path(d.spark, "dns")
    logs.write_dns(logs.parse_dns_lines(d.log_lines, ntz(DNS_NOW)), path)
    return logs.read_dns(d.spark, path, status)


@query
def stored_log(d: Data) -> DataFrame:
    return _stored_log(d, "accepted")


@query
def rejected_log(d: Data) -> DataFrame:
    return _stored_log(d, "rejected")


@query
def streamed_log(d: Data) -> DataFrame:
    """Ingest from rotated log files by the streaming job, accepted rows; `same_id` rows share the id of each.

    The id itself holds the name of the file, which differs in every run.
    """
    inbox, out = scratch_path(d.spark, "inbox"), scratch_path(d.spark, "dns")
    d.log_lines.write.text(inbox)
    jobs.stream_dns(d.spark, inbox, out, scratch_path(d.spark, "state"), ntz(DNS_NOW),
                    availableNow=True).awaitTermination()
    rows = logs.read_dns(d.spark, out).drop("batch_id")
    return rows.join(rows.groupBy("id").agg(F.count("*").alias("same_id")), "id").drop("id")


@query
def identified_log(d: Data) -> DataFrame:
    """Every line of a log with the key of its DNS row."""
    return logs.identified(d.log_lines, F.lit("log"))


# --- raw reports and enrichment --------------------------------------------

@query
def stored_reports_of_provider(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "raw")
    raw_reports.write_raw_reports(d.raw_reports, path)
    return raw_reports.raw_by_provider(d.spark.read.parquet(path), "Abuse_URLhaus")


@query
def latest_raw(d: Data) -> DataFrame:
    return raw_reports.latest_raw(d.raw_reports)


@query
def deduped_payloads(d: Data) -> DataFrame:
    return raw_reports.dedupe_payloads(d.raw_reports)


@query
def virustotal_hits(d: Data) -> DataFrame:
    return filters.vt_hit(raw_reports.raw_by_provider(d.raw_reports, "VirusTotal")).select("doc_id", "resource")


@query
def abuse_hits(d: Data) -> DataFrame:
    rows = d.raw_reports.filter("source_provider <> 'VirusTotal'")
    return filters.abuse_hit(rows).select("doc_id", "resource", "source_provider")


def _reduced(d: Data, provider: str, reducer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reducer(raw_reports.raw_by_provider(d.raw_reports, provider).select("doc_id", "resource", "raw_data"))


@query
def reduced_virustotal(d: Data) -> DataFrame:
    return _reduced(d, "VirusTotal", enrich.reduce_virustotal)


@query
def reduced_threatfox(d: Data) -> DataFrame:
    return _reduced(d, "Abuse_ThreatFox", enrich.reduce_threatfox)


@query
def reduced_urlhaus(d: Data) -> DataFrame:
    return _reduced(d, "Abuse_URLhaus", enrich.reduce_urlhaus)


CONTEXT_COLUMNS = ["dns_query_id", "fqdn", "observable_ip", "vt_doc_id", "tf_doc_id", "uh_doc_id", "vt_no_data",
                   "tf_no_data", "uh_no_data", "vt_malicious_count", "vt_suspicious_count", "vt_is_big_player",
                   "tf_families", "tf_active", "tf_max_confidence", "uh_active", "primary_hit", "primary_score",
                   "threat_scale"]


@query
def merged_context(d: Data) -> DataFrame:
    return d.context().select(*CONTEXT_COLUMNS)


@query
def detection_first(d: Data) -> DataFrame:
    return enrich.detection_first(d.context()).select(
        "dns_query_id", "primary_hit", "uh_status", "uh_no_data", "uh_active", "uh_report", "uh_reference")


@query
def scored_context(d: Data) -> DataFrame:
    return d.scored().select("dns_query_id", "primary_score", "score", "is_malicious", "threat_label")


@query
def parsed_verdicts(d: Data) -> DataFrame:
    return d.parsed().withColumn("active_providers", F.array_join("active_providers", ","))


@query
def provider_details(d: Data) -> DataFrame:
    return d.details()


@query
def severity_styles(d: Data) -> DataFrame:
    return pick_severity(d.ai_analysis_results.select("id", F.col("threat_score").alias("score")))


@query
def alert_records(d: Data) -> DataFrame:
    named = d.details().groupBy("dns_query_id").agg(
        F.array_join(F.array_sort(F.collect_set("source_provider")), ", ").alias("providers"))
    return enrich.build_alerts(d.parsed().join(named, "dns_query_id", "left"))


# --- registry --------------------------------------------------------------

def _clean(d: Data) -> DataFrame:
    """One row per pending query and provider that found nothing."""
    quiet = {"VirusTotal": (F.col("vt_malicious_count") + F.col("vt_suspicious_count")) == 0,
             "Abuse_ThreatFox": F.col("tf_no_data"), "Abuse_URLhaus": F.col("uh_no_data")}
    found = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in quiet.items()])))
    return d.context().select("dns_query_id", found.alias("provider"))


@query
def clean_scan_indicators(d: Data) -> DataFrame:
    return registry.register_clean_scans(_clean(d), d.types, ntz(DNS_NOW))[1]


@query
def clean_scan_verdicts(d: Data) -> DataFrame:
    return registry.register_clean_scans(_clean(d), d.types, ntz(DNS_NOW))[0]


def _registered(d: Data, part: int) -> DataFrame:
    return registry.register_verdicts(d.parsed(), d.details(), d.types, d.providers, ntz(DNS_NOW))[part]


@query
def registered_verdicts(d: Data) -> DataFrame:
    return _registered(d, 0)


@query
def registered_indicators(d: Data) -> DataFrame:
    return _registered(d, 1)


@query
def registered_links(d: Data) -> DataFrame:
    return _registered(d, 2)


@query
def alerts_of_ingested_log(d: Data) -> DataFrame:
    """The whole chain: log lines, queue, verdict texts, registration, latest report, alert.

    The model's answer is replaced by a text that is made from the queue row.
    """
    now = ntz(DNS_NOW)
    dns = logs.parse_dns_lines(logs.identified(d.log_lines, F.lit("log")), now)
    scanned = d.threat_indicators.withColumn("dns_query_id", F.col("dns_query_id").cast("string"))
    queue = reports.pending_analysis(dns, scanned)
    score = (1 + F.length("observable_ip") % 5).cast("string")
    answer = F.concat(F.lit('{"threat_score": '), score, F.lit(', "verdict_en": "'), "fqdn",
                      F.lit('", "active_providers": []}'))
    verdicts = enrich.parse_verdicts(queue.select("dns_query_id", "fqdn", "observable_ip", answer.alias("output")))
    results, indicators, _ = registry.register_verdicts(
        verdicts, enrich.provider_details(verdicts, d.raw_reports), d.types, d.providers, now)
    latest = reports.latest_threat_reports(indicators, results)
    alerts = reports.threat_alerts(indicators, dns, results, d.levels)
    newest = latest.select(F.col("id").alias("indicator_id"), "dns_query_id")
    return alerts.join(newest, "indicator_id").select(
        "dns_query_id", "fqdn", "observable_ip", "threat_score", F.col("threat_label").alias("level"), "verdict_en",
        "last_scan", "detection_time")


@query
def unique_indicators(d: Data) -> DataFrame:
    rows = d.threat_indicators.unionAll(d.threat_indicators.withColumn("scan_count", F.col("scan_count") + 1))
    return registry.enforce_unique(rows, ["dns_query_id", "analysis_result_id", "last_scan"], ["scan_count", "id"])


@query
def new_links_only(d: Data) -> DataFrame:
    """Detail rows that a target which already holds the second links does not have."""
    rows = d.threat_indicator_details
    return registry.enforce_unique(rows, ["indicator_id", "source_id"], ["id"], rows.filter("id LIKE '%/2'"))


@query
def upserted_indicators(d: Data) -> DataFrame:
    """A stored table after two batches, the second of which holds the first again and runs twice."""
    path, keys = scratch_path(d.spark, "indicators"), ["dns_query_id", "analysis_result_id", "last_scan"]
    rows = d.threat_indicators
    for batch_id, new in ((1, rows.filter("scan_count % 2 = 1")), (2, rows), (2, rows)):
        upsert.upsert(d.spark, new, path, keys, "last_scan", batch_id)
    return upsert.read_upserted(d.spark, path)


@query
def constraint_violations(d: Data) -> DataFrame:
    """Rows that the declared tables refuse, by table and rule."""
    wide = (F.col("confidence_score").cast("decimal(10, 2)") * 20).cast("decimal(10, 2)")
    tables = {
        "dns_queries": logs.parse_dns_lines(d.log_lines, ntz(DNS_NOW)),
        # scores of the older scale, which the newer one does not have
        "ai_analysis_results": d.legacy_results.withColumn("confidence_score", wide),
        "threat_indicators": d.threat_indicators.withColumn("analysis_result_id", F.expr(
            "if(analysis_result_id % 9 = 0, null, analysis_result_id)")),
        "threat_indicator_details": d.threat_indicator_details.withColumn("source_id", F.col("source_id") + 1),
        "network_events": d.network_events,
    }
    return constraints.violations_by_rule(tables, {
        "dic_threat_levels": d.levels, "dic_indicator_types": d.types, "dic_source_providers": d.providers})


@query
def scan_counts(d: Data) -> DataFrame:
    return registry.scan_counts(d.threat_indicators)


@query
def orphaned_rows(d: Data) -> DataFrame:
    """Children without parent over the four logical relations, by relation and key."""
    relations = [
        ("indicator without query", d.threat_indicators, d.dns_queries, "dns_query_id"),
        ("indicator without verdict", d.threat_indicators, d.ai_analysis_results, "analysis_result_id"),
        ("event without query", d.network_events, d.dns_queries, "dns_query_id"),
        ("event without indicator", d.network_events, d.threat_indicators, "threat_indicator_id"),
    ]
    out = None
    for name, child, parent, key in relations:
        rows = registry.orphans(child, parent, key).select(
            F.lit(name).alias("relation"), F.col(key).cast("string").alias("missing_key"), F.col("id").alias("row_id"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query
def remapped_scores(d: Data) -> DataFrame:
    return registry.remap_scores(d.legacy_results).select("id", "threat_score")


# --- partitions ------------------------------------------------------------

@query
def retained_indicators(d: Data) -> DataFrame:
    return maintain.retained(d.threat_indicators, "last_scan", ntz(SCAN_NOW))


@query
def expired_partitions(d: Data) -> DataFrame:
    return maintain.expired_partitions(d.partitions(), ntz(SCAN_NOW))


@query
def planned_partitions(d: Data) -> DataFrame:
    return maintain.plan_future_partitions(d.partitions().select("table_name", "partition_name"),
                                           ntz("2001-09-30 10:00:00"))


@query
def range_partitions(d: Data) -> DataFrame:
    """Rows per range partition when the table starts in 2000 and is planned until 2001-06."""
    name = maintain.partition_of(F.col("last_scan"), "200001", "200106")
    return d.threat_indicators.groupBy(name.alias("partition_name")).agg(F.count("*").alias("table_rows"))


@query
def partition_counts(d: Data) -> DataFrame:
    return maintain.partition_counts(d.partitions())


@query
def partition_sample(d: Data) -> DataFrame:
    return maintain.partition_sample(d.partitions())


def _write_months(d: Data) -> dict[str, str]:
    paths = {}
    for name, ts in [("dns_queries", "timestamp"), ("threat_indicators", "last_scan")]:
        paths[name] = f"{scratch_path(d.spark, 'months')}/{name}"
        maintain.write_partitioned(getattr(d, name), ts, paths[name])
    return paths


@query
def partition_info(d: Data) -> DataFrame:
    """Without the sizes and times, which depend on the files as written."""
    info = maintain.partition_info(d.spark, _write_months(d))
    return info.select("table_name", "partition_name", "partition_expression", "upper_bound", "table_rows")


@query
def stored_partition_rows(d: Data) -> DataFrame:
    info = maintain.partition_info(d.spark, _write_months(d))
    return info.select("table_name", "partition_name", "table_rows", (F.col("total_mb") >= 0).alias("has_size"))


@query
def stored_months_in_range(d: Data) -> DataFrame:
    """Range read of a month-partitioned table; the month filter prunes folders."""
    base = scratch_path(d.spark, "months")
    maintain.write_partitioned(d.threat_indicators, "last_scan", f"{base}/threat_indicators")
    stored = tables.read_table(d.spark, "threat_indicators", base)
    return filters.time_filter(stored, "last_scan", ntz(SCAN_START), ntz(SCAN_END), "ym")


@query
def recent_maintenance(d: Data) -> DataFrame:
    """Newest log entries of a maintenance run, written to and read from the log."""
    path = scratch_path(d.spark, "log")
    dropped = maintain.expired_partitions(d.partitions(), ntz(SCAN_NOW)).withColumn("action", F.lit("DROP"))
    added = maintain.plan_future_partitions(
        d.partitions().select("table_name", "partition_name"), ntz(SCAN_NOW)).withColumn("action", F.lit("ADD"))
    at = {"DROP": "2001-11-01 02:00:00", "ADD": "2001-11-01 03:00:00"}
    for rows, action in ((dropped, "DROP"), (added, "ADD")):
        maintain.log_maintenance(rows.withColumns({
            "error_message": F.lit(None).cast("string"), "executed_at": ntz(at[action])}), path)
    return maintain.recent_maintenance(d.spark.read.parquet(path))


# --- streams and bursts ----------------------------------------------------

@query
def streamed_hourly_traffic(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "hourly")
    jobs.drain(jobs.stream_hourly(d.stream("dns_queries")), out, scratch_path(d.spark, "state"))
    return d.spark.read.parquet(out)


@query
def streamed_pending(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "queue")
    jobs.stream_pending(d.stream("dns_queries"), lambda: d.threat_indicators, out,
                        scratch_path(d.spark, "state"), availableNow=True).awaitTermination()
    return d.spark.read.parquet(out).drop("batch_id")


@query
def streamed_queue(d: Data) -> DataFrame:
    """Entries that a stateful queue still holds after streams of rows and of indicators."""
    out = scratch_path(d.spark, "queue")
    queue.stream_queue(d.stream("dns_queries"), d.stream("threat_indicators").filter("dns_query_id > 0"), out,
                       scratch_path(d.spark, "state"), again_seconds=86400, availableNow=True).awaitTermination()
    return queue.open_entries(d.spark.read.parquet(out))


@query
def rolled_up_traffic(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "traffic")
    rollups.stream_traffic(d.stream("dns_queries"), path, scratch_path(d.spark, "state"),
                           availableNow=True).awaitTermination()
    return rollups.hourly_traffic(d.spark, path)


@query
def rolled_up_bursts(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "failures")
    rollups.stream_failures(d.stream("failures"), "source", "failed_at", path, scratch_path(d.spark, "state"), 3, 86400,
                            availableNow=True).awaitTermination()
    return rollups.burst_rows(d.spark, path)


@query
def burst_offenders(d: Data) -> DataFrame:
    return bursts.burst_offenders(d.failures, "source", "failed_at", 3, 86400)


@query
def burst_offenders_ten_minutes(d: Data) -> DataFrame:
    return bursts.burst_offenders(d.failures, "source", "failed_at", 2, 600)


@query
def streamed_bursts(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "bursts")
    jobs.stream_bursts(d.stream("failures"), "source", "failed_at", out, scratch_path(d.spark, "state"), 3, 86400,
                       availableNow=True).awaitTermination()
    return d.spark.read.parquet(out).drop("batch_id")


# --- planned items ---------------------------------------------------------

@query
def verdict_documents(d: Data) -> DataFrame:
    return similar.verdict_documents(d.ai_analysis_results, d.threat_indicators, d.dns_queries)


@query
def missing_embeddings(d: Data) -> DataFrame:
    return similar.missing_embeddings(d.ai_analysis_results, d.verdict_vectors)


def _new_vectors(d: Data) -> DataFrame:
    """Vectors of observables that have no stored verdict yet."""
    return registry.orphans(d.verdict_vectors, d.ai_analysis_results, "verdict_id").withColumnRenamed(
        "verdict_id", "query_id")


@query
def similar_verdicts(d: Data) -> DataFrame:
    corpus = similar.verdict_corpus(d.verdict_vectors, d.ai_analysis_results, d.threat_indicators, ntz(SCAN_NOW))
    return similar.similar_verdicts(_new_vectors(d), corpus)


@query
def reference_material(d: Data) -> DataFrame:
    known = d.ai_analysis_results.select(F.col("id").alias("verdict_id"))
    knowledge = d.verdict_vectors.join(known, "verdict_id", "left_semi")
    return similar.reference_material(_new_vectors(d), knowledge, threshold=0.25)


@query
def attributed_queries(d: Data) -> DataFrame:
    return similar.attribute_users(d.dns_queries, d.user_devices)


@query
def attributed_replies(d: Data) -> DataFrame:
    """Replies with the client that asked and its user."""
    found = attribution.attribute_replies(d.dns_queries, d.user_devices, ASKED_WITHIN)
    return found.select("id", "domain", "asked_by", "query_id", "asked_at", "user_name", "device")


@query
def attributed_queue(d: Data) -> DataFrame:
    """The queue, whose rows are replies, with the client that asked for each."""
    queue = d.pending().drop("source_ip", "query_count").withColumnsRenamed({"fqdn": "domain", "first_seen": "timestamp"})
    return attribution.last_query(queue, d.dns_queries.filter("query_type = 'query'"), ASKED_WITHIN)


@query
def hash_mismatches(d: Data) -> DataFrame:
    """File hashes now against a master list in which some files have moved or changed."""
    files = d.file_hashes
    current = files.select("path", F.sha2("content", 256).alias("hash"), "seen_at")
    moved, changed = F.col("seen_at") % 7 == 0, F.col("seen_at") % 5 == 0
    master = files.select(
        F.when(moved, F.concat(F.lit("/old"), "path")).otherwise(F.col("path")).alias("path"),
        F.sha2(F.concat("content", F.when(changed, "x").otherwise("")), 256).alias("hash"))
    return similar.hash_mismatches(current, master)


@query
def verdict_equivalence(d: Data) -> DataFrame:
    old = d.threat_indicators.join(
        d.ai_analysis_results.select(F.col("id").alias("analysis_result_id"), "threat_score"), "analysis_result_id")
    legacy = registry.remap_scores(d.legacy_results).select(F.col("id").alias("analysis_result_id"), "threat_score")
    return similar.verdict_equivalence(old, d.threat_indicators.join(legacy, "analysis_result_id"))


@query
def migration_report(d: Data) -> DataFrame:
    old = {n: getattr(d, n) for n in ("dns_queries", "threat_indicators", "threat_indicator_details")}
    new = {**old, "threat_indicators": old["threat_indicators"].filter("scan_count > 1")}
    return similar.migration_report(old, new, d.raw_reports)
