"""SQL equivalents of the registered queries, for a second engine.

Each statement derives the reference tables it names from the test tables (the
same derivations as `sources.fixtures`) and then states the query on its own
terms in plain SQL.
"""

from __future__ import annotations

import re

from tidewatch import schemas
from tidewatch.plans import catalog as c
from tidewatch.sources.fixtures import TABLES, derivation_sql
from tidewatch.sources.logs import LINE_PATTERN


def _values(rows: list[tuple], columns: str) -> str:
    def literal(v) -> str:
        return str(v) if isinstance(v, (int, bool)) else "'" + v + "'"
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def _ipv4(column: str) -> str:
    """Four numbers of one to three digits between dots, none above 255."""
    return (f"(regexp_full_match({column}, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}')"
            f" AND list_max([try_cast(part AS int) FOR part IN string_split({column}, '.')]) <= 255)")


VIEWS: dict[str, str] = {
    "levels": _values(schemas.THREAT_LEVELS, "score, description, is_malicious_flag, action_recommended"),
    "legacy_levels": _values(schemas.LEGACY_THREAT_LEVELS, "score, description, is_malicious_flag"),
    "providers": _values(schemas.SOURCE_PROVIDERS, "id, name"),
    "types": _values(schemas.INDICATOR_TYPES, "id, name"),
    **{name: derivation_sql(name) for name in TABLES},
    # Queue: DNS rows with an IPv4 answer and no indicator.
    "pending": f"""
        SELECT q.id AS dns_query_id, q.source_ip, q.domain AS fqdn,
               string_agg(DISTINCT q.response_ip, ', ' ORDER BY q.response_ip) AS observable_ip,
               min(q.timestamp) AS first_seen, count(DISTINCT q.id) AS query_count
        FROM dns_queries q
        WHERE {_ipv4('q.response_ip')}
          AND NOT EXISTS (SELECT 1 FROM threat_indicators i WHERE i.dns_query_id = q.id)
        GROUP BY q.id, q.source_ip, q.domain""",
    # Newest scans of every query, ties included.
    "newest": """
        SELECT * FROM threat_indicators
        QUALIFY last_scan = max(last_scan) OVER (PARTITION BY dns_query_id)""",
    "latest": """
        SELECT n.id, n.dns_query_id, n.type_id, n.analysis_result_id, n.last_scan, n.scan_count, a.threat_score,
               a.threat_label, a.verdict_summary_en, a.analysis_pl,
               cast(a.confidence_score AS double) AS confidence_score
        FROM newest n JOIN ai_analysis_results a ON a.id = n.analysis_result_id""",
    "legacy_latest": """
        SELECT n.*, a.threat_score FROM newest n JOIN legacy_results a ON a.id = n.analysis_result_id""",
    "stats": """
        SELECT count(l.id) AS total_scans,
               cast(sum(cast(v.is_malicious_flag AS int)) AS bigint) AS total_malicious_scans,
               round(100 * avg(cast(v.is_malicious_flag AS int)), 2) AS malicious_percentage,
               max(l.last_scan) AS last_scan, min(l.last_scan) AS first_scan
        FROM latest l JOIN levels v ON v.score = l.threat_score""",
    "trends": """
        SELECT cast(l.last_scan AS date) AS scan_date,
               cast(epoch(cast(max(l.last_scan) AS date)) AS bigint) AS time_sec,
               count(l.id) AS total_scans_per_day,
               count(*) FILTER (WHERE v.is_malicious_flag) AS total_positives_per_day,
               count(*) FILTER (WHERE NOT v.is_malicious_flag) AS total_clean_per_day,
               max(l.threat_score) AS max_threat_score_that_day,
               round(avg(l.threat_score), 4) AS avg_threat_score
        FROM latest l JOIN levels v ON v.score = l.threat_score
        GROUP BY cast(l.last_scan AS date)""",
    "hourly": """
        SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:00:00') AS hour_group,
               cast(epoch(date_trunc('hour', timestamp)) AS bigint) AS time_sec,
               count(id) AS total_queries, count(DISTINCT domain) AS unique_domains,
               count(DISTINCT source_ip) AS unique_sources, max(timestamp) AS latest_query,
               max(timestamp) AS raw_time
        FROM dns_queries GROUP BY date_trunc('hour', timestamp)""",
    "named": """
        SELECT t.indicator_id, string_agg(p.name, ', ' ORDER BY p.name) AS providers
        FROM threat_indicator_details t JOIN providers p ON p.id = t.source_id GROUP BY t.indicator_id""",
    "explorer": """
        SELECT e.timestamp, q.domain AS fqdn, e.source_ip, e.dest_ip, e.request_url, e.event_type, n.providers,
               v.description AS threat_label, v.action_recommended, a.threat_score, e.action_taken
        FROM network_events e
        JOIN dns_queries q ON q.id = e.dns_query_id
        JOIN threat_indicators i ON i.id = e.threat_indicator_id
        JOIN ai_analysis_results a ON a.id = i.analysis_result_id
        JOIN levels v ON v.score = a.threat_score AND v.is_malicious_flag
        LEFT JOIN named n ON n.indicator_id = i.id""",
    "alerts": """
        SELECT i.id AS indicator_id, q.timestamp AS detection_time, q.domain AS fqdn, q.record_type, q.source_ip,
               q.response_ip AS observable_ip, a.threat_score, v.description AS threat_label, v.is_malicious_flag,
               v.action_recommended, a.verdict_summary_en AS verdict_en, a.analysis_pl,
               cast(a.confidence_score AS double) AS confidence_score, i.scan_count, i.last_scan
        FROM threat_indicators i, dns_queries q, ai_analysis_results a, levels v
        WHERE q.id = i.dns_query_id AND a.id = i.analysis_result_id AND v.score = a.threat_score
          AND v.is_malicious_flag""",
    "numbered_lines": """
        SELECT value, sha256('log' || chr(10) || value || chr(10) || row_number() OVER (PARTITION BY value)) AS id
        FROM log_lines""",
    "filter_words": r"""
        SELECT unnest(CASE WHEN len(w) = 1 THEN w ELSE w[2:] END) AS entry FROM (
          SELECT regexp_split_to_array(lower(t), '[ \t]+') AS w FROM (
            SELECT trim(regexp_replace(trim(value), '(^|\s)#.*', '')) AS t FROM filter_lines
            WHERE trim(value)[1] NOT IN ('!', '[')) WHERE t <> '')""",
    "filter_names": r"""
        SELECT entry, CASE WHEN length(name) <= 253 AND NOT regexp_full_match(name, '[0-9.]+')
                 AND list_bool_and([regexp_full_match(x, '[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?') FOR x IN p])
                 AND len(p) > 1 AND length(p[-1]) > 1 AND name <> 'localhost.localdomain' THEN name END AS domain
        FROM (SELECT *, string_split(name, '.') AS p FROM (
          SELECT entry, regexp_replace(rtrim(CASE WHEN entry LIKE '||%' AND contains(entry, '^')
            THEN split_part(entry[3:], '^', 1) ELSE entry END, '.'), '^[*]?[.]', '') AS name FROM filter_words))""",
    "below": """
        SELECT q.id, q.domain, min_by(n.domain, length(n.domain)) AS listed FROM host_queries q
        JOIN (SELECT DISTINCT domain FROM filter_names) n
          ON rtrim(lower(q.domain), '.') = n.domain OR suffix(rtrim(lower(q.domain), '.'), '.' || n.domain)
        GROUP BY q.id, q.domain""",
    "range_parts": """
        SELECT range, split_part(range, '/', 1) AS base,
               CASE WHEN contains(range, '/') THEN try_cast(split_part(range, '/', 2) AS int)
                    WHEN contains(range, ':') THEN 128 ELSE 32 END AS bits
        FROM (SELECT DISTINCT range FROM range_list)""",
    "good_ranges": """
        SELECT *, CASE WHEN contains(base, ':') THEN 6 ELSE 4 END AS family,
               list_reduce([try_cast(x AS bigint) FOR x IN string_split(base, '.')], lambda a, b: a * 256 + b) AS n
        FROM range_parts WHERE contains(base, ':') OR bits <= 32 AND contains(base, '.')""",
    "asked": f"""
        SELECT r.id, max_by(q.id, (q.timestamp, q.id)) AS query_id, max_by(q.source_ip, (q.timestamp, q.id)) AS asked_by,
               max(q.timestamp) AS asked_at
        FROM dns_queries r JOIN dns_queries q ON q.domain = r.domain AND q.timestamp <= r.timestamp
          AND q.timestamp >= r.timestamp - INTERVAL {c.ASKED_WITHIN} SECONDS
        WHERE r.query_type = 'reply' AND q.query_type = 'query' GROUP BY r.id""",
    "blocked_names": """
        SELECT DISTINCT name AS domain FROM (
          SELECT CASE WHEN len(w) = 1 THEN w ELSE w[2:] END AS names FROM (
            SELECT regexp_split_to_array(lower(trim(split_part(value, '#', 1))), '[ \\t]+') AS w FROM list_lines
            WHERE trim(split_part(value, '#', 1)) <> '')), unnest(names) AS u(name)
        WHERE name NOT IN ('localhost', 'localhost.localdomain', 'local', 'broadcasthost', '0.0.0.0')""",
    "log_parts": f"""
        SELECT regexp_extract(value, '{LINE_PATTERN}', 1) AS action, regexp_extract(value, '{LINE_PATTERN}', 2) AS named,
               regexp_extract(value, '{LINE_PATTERN}', 3) AS domain, regexp_extract(value, '{LINE_PATTERN}', 4) AS val
        FROM log_lines WHERE regexp_matches(value, '{LINE_PATTERN}')""",
    "parsed_lines": f"""
        SELECT timestamp '{c.DNS_NOW}' AS timestamp, action AS query_type,
               CASE WHEN named <> '' THEN named WHEN val = 'NXDOMAIN' THEN 'N/A'
                    WHEN contains(val, ':') THEN 'AAAA'
                    WHEN contains(val, '.') AND val NOT IN ('<CNAME>', 'NODATA') THEN 'A' ELSE 'OTHER' END
                 AS record_type,
               domain, CASE action WHEN 'query' THEN val ELSE 'N/A' END AS source_ip,
               CASE action WHEN 'reply' THEN val END AS response_ip
        FROM log_parts""",
    "stored_lines": """
        SELECT *, '202401' AS ym, length(domain) <= 255 AND length(source_ip) <= 45
               AND coalesce(length(response_ip), 0) <= 45 AND length(record_type) <= 10 AS fits
        FROM parsed_lines""",
    "vt": """
        SELECT doc_id, resource, scan_date,
               json_extract(raw_data, '$.data.attributes.last_analysis_stats') IS NULL AS vt_no_data,
               coalesce(cast(json_extract(raw_data, '$.data.attributes.last_analysis_stats.malicious') AS bigint), 0)
                 AS vt_malicious_count,
               coalesce(cast(json_extract(raw_data, '$.data.attributes.last_analysis_stats.suspicious') AS bigint), 0)
                 AS vt_suspicious_count,
               coalesce(cast(json_extract(raw_data, '$.data.attributes.last_analysis_stats.undetected') AS bigint), 0)
                 AS vt_undetected_count,
               json_extract_string(raw_data, '$.data.attributes.as_owner') AS vt_owner,
               coalesce(regexp_matches(json_extract_string(raw_data, '$.data.attributes.as_owner'),
                 '(?i)aws|amazon|cloudflare|google|microsoft|github'), false) AS vt_is_big_player,
               cast(json_extract(raw_data, '$.data.attributes.last_analysis_date') AS bigint) AS vt_scan_date
        FROM raw_reports WHERE source_provider = 'VirusTotal'""",
    "tf_lists": """
        SELECT doc_id, resource, scan_date, json_extract_string(raw_data, '$.query_status') = 'ok' AS found,
               list_sort(list_distinct(list_filter(json_extract_string(raw_data, '$.data[*].malware_printable'),
                 lambda x: x IS NOT NULL AND x <> 'null'))) AS names,
               list_sort(list_distinct(json_extract_string(raw_data, '$.data[*].threat_type'))) AS kinds,
               list_max([cast(x AS bigint) for x in json_extract_string(raw_data, '$.data[*].confidence_level')]) AS top
        FROM raw_reports WHERE source_provider = 'Abuse_ThreatFox'""",
    "tf": """
        SELECT doc_id, resource, scan_date, NOT found AS tf_no_data,
               CASE WHEN found AND len(names) > 0 THEN array_to_string(names, ', ') END AS tf_families,
               CASE WHEN found THEN concat(CASE WHEN len(names) > 0 THEN array_to_string(names, ', ')
                 ELSE 'unnamed' END, ': ', array_to_string(kinds, ', ')) END AS tf_report,
               found AND coalesce(top >= 0, false) AS tf_active,
               CASE WHEN found THEN top END AS tf_max_confidence
        FROM tf_lists""",
    "uh_lists": """
        SELECT doc_id, resource, scan_date, json_extract_string(raw_data, '$.query_status') = 'ok' AS found,
               json_extract_string(raw_data, '$.urls[*].url_status') AS states,
               json_extract_string(raw_data, '$.urlhaus_reference') AS link
        FROM raw_reports WHERE source_provider = 'Abuse_URLhaus'""",
    "uh": """
        SELECT doc_id, resource, scan_date, NOT found AS uh_no_data,
               CASE WHEN found THEN concat(len(list_filter(states, lambda x: x = 'online')), ' of ', len(states),
                 ' URLs online') END AS uh_report,
               found AND list_contains(states, 'online') AS uh_active,
               CASE WHEN found THEN link END AS uh_reference
        FROM uh_lists""",
    "ctx": """
        WITH v AS (SELECT * FROM vt QUALIFY row_number() OVER
                     (PARTITION BY resource ORDER BY scan_date DESC, doc_id DESC) = 1),
             t AS (SELECT * FROM tf QUALIFY row_number() OVER
                     (PARTITION BY resource ORDER BY scan_date DESC, doc_id DESC) = 1),
             u AS (SELECT * FROM uh QUALIFY row_number() OVER
                     (PARTITION BY resource ORDER BY scan_date DESC, doc_id DESC) = 1)
        SELECT p.dns_query_id, p.fqdn, p.observable_ip, v.doc_id AS vt_doc_id, t.doc_id AS tf_doc_id,
               u.doc_id AS uh_doc_id, coalesce(v.vt_no_data, true) AS vt_no_data,
               coalesce(t.tf_no_data, true) AS tf_no_data, coalesce(u.uh_no_data, true) AS uh_no_data,
               coalesce(v.vt_malicious_count, 0) AS vt_malicious_count,
               coalesce(v.vt_suspicious_count, 0) AS vt_suspicious_count,
               coalesce(v.vt_is_big_player, false) AS vt_is_big_player, t.tf_families,
               coalesce(t.tf_active, false) AS tf_active, t.tf_max_confidence,
               coalesce(u.uh_active, false) AS uh_active, u.uh_report, u.uh_reference,
               coalesce(v.vt_malicious_count, 0) > 0 OR coalesce(v.vt_suspicious_count, 0) > 0
                 OR NOT coalesce(t.tf_no_data, true) AS primary_hit,
               cast(1 + p.dns_query_id % 5 AS int) AS primary_score
        FROM pending p LEFT JOIN v ON v.resource = p.observable_ip
        LEFT JOIN t ON t.resource = p.fqdn LEFT JOIN u ON u.resource = p.fqdn""",
    "gated": """
        SELECT *, CASE WHEN NOT primary_hit THEN 'skip' WHEN uh_no_data THEN 'no_result' ELSE 'real' END AS uh_status
        FROM ctx""",
    "texts": r"""
        SELECT dns_query_id, fqdn, observable_ip, output, CASE WHEN json_valid(body) THEN body END AS doc FROM (
          SELECT *, regexp_replace(trim(replace(replace(output, '```json' || chr(10), ''), '```', ''),
            ' ' || chr(9) || chr(10) || chr(13)), '[\r\n]+', ' ', 'g') AS body FROM verdict_texts)""",
    "opened": """
        SELECT *, CASE WHEN json_type(doc, '$.active_providers') = 'ARRAY'
                  THEN json_extract_string(doc, '$.active_providers[*]') END AS active FROM texts""",
    "listed": """
        SELECT DISTINCT dns_query_id, CASE WHEN provider = 'virustotal' THEN observable_ip ELSE fqdn END AS resource,
               CASE provider WHEN 'virustotal' THEN 'VirusTotal' WHEN 'threatfox' THEN 'Abuse_ThreatFox'
                 WHEN 'urlhaus' THEN 'Abuse_URLhaus' END AS source_provider
        FROM opened, unnest(active) AS u(provider)""",
    "detail_rows": """
        SELECT l.resource, l.source_provider, l.dns_query_id, max_by(r.doc_id, (r.scan_date, r.doc_id)) AS doc_id
        FROM listed l JOIN raw_reports r ON r.resource = l.resource AND r.source_provider = l.source_provider
        GROUP BY ALL""",
    "clean_pairs": """
        SELECT dns_query_id, provider FROM (
          SELECT dns_query_id, 'VirusTotal' AS provider FROM ctx
            WHERE vt_malicious_count + vt_suspicious_count = 0
          UNION ALL SELECT dns_query_id, 'Abuse_ThreatFox' FROM ctx WHERE tf_no_data
          UNION ALL SELECT dns_query_id, 'Abuse_URLhaus' FROM ctx WHERE uh_no_data)""",
    "months": """
        SELECT table_name, concat('p', strftime(ts, '%Y%m')) AS partition_name, count(*) AS table_rows FROM (
          SELECT 'dns_queries' AS table_name, timestamp AS ts FROM dns_queries
          UNION ALL SELECT 'network_events', timestamp FROM network_events
          UNION ALL SELECT 'threat_indicators', last_scan FROM threat_indicators) GROUP BY ALL""",
    "vector_pairs": """
        SELECT q.verdict_id AS query_id, k.verdict_id,
               round(list_cosine_similarity(q.vector::double[], k.vector::double[]), 6) AS similarity
        FROM verdict_vectors q, verdict_vectors k
        WHERE q.verdict_id NOT IN (SELECT id FROM ai_analysis_results)
          AND k.verdict_id IN (SELECT id FROM ai_analysis_results)""",
}

STAMP = "20240131000000"
# Scores up to 2, 3, and all others.
STYLE = """
    CASE WHEN score <= 2 THEN '#4caf50' WHEN score = 3 THEN '#ff9800' ELSE '#f44336' END AS accent,
    CASE WHEN score <= 2 THEN '✅ INFO: DNS watch' WHEN score = 3 THEN '⚠️ REVIEW: DNS watch'
         ELSE '🚨 ALERT: DNS watch' END AS header_text,
    CASE WHEN score <= 2 THEN 'Clean / Monitor' WHEN score = 3 THEN 'Suspicious'
         ELSE 'Malicious / Critical' END AS badge"""

SQL: dict[str, str] = {
    "pending_analysis": "SELECT * FROM pending",
    "pending_in_order": "SELECT * FROM pending",
    "next_pending": "SELECT * FROM pending ORDER BY first_seen, dns_query_id LIMIT 1",
    "latest_threat_reports": "SELECT * FROM latest",
    "latest_reports_in_range": f"""
        SELECT * FROM latest WHERE last_scan BETWEEN timestamp '{c.SCAN_START}' AND timestamp '{c.SCAN_END}'""",
    "malicious_stats": "SELECT * FROM stats",
    "malicious_stats_legacy": """
        SELECT count(id) AS total_scans, count(*) FILTER (WHERE threat_score > 5) AS total_malicious_scans,
               round(count(*) FILTER (WHERE threat_score > 5) / nullif(count(id), 0) * 100, 8) AS malicious_percentage,
               max(last_scan) AS last_scan FROM legacy_latest""",
    "daily_trends": "SELECT * REPLACE (cast(scan_date AS varchar) AS scan_date) FROM trends",
    "daily_trends_legacy": """
        SELECT cast(cast(last_scan AS date) AS varchar) AS scan_date,
               cast(epoch(cast(max(last_scan) AS date)) AS bigint) AS time_sec, count(id) AS total_scans_per_day,
               count(*) FILTER (WHERE threat_score > 5) AS total_positives_per_day,
               max(threat_score) AS max_threat_score_that_day
        FROM legacy_latest GROUP BY cast(last_scan AS date)""",
    "dns_hourly_traffic": "SELECT * FROM hourly",
    "providers_per_indicator": "SELECT * FROM named",
    "threat_explorer": "SELECT * FROM explorer",
    "threat_explorer_legacy": """
        SELECT e.timestamp, q.domain AS fqdn, e.source_ip, e.request_url, n.providers,
               v.description AS threat_label, a.threat_score
        FROM network_events e
        JOIN dns_queries q ON q.id = e.dns_query_id
        JOIN threat_indicators i ON i.id = e.threat_indicator_id
        JOIN legacy_results a ON a.id = i.analysis_result_id AND a.threat_score > 5
        JOIN legacy_levels v ON v.score = a.threat_score
        LEFT JOIN named n ON n.indicator_id = i.id""",
    "threat_alerts": "SELECT * FROM alerts",
    "threat_alerts_legacy": """
        SELECT i.id AS indicator_id, q.timestamp AS detection_time, q.domain AS fqdn, q.record_type,
               q.response_ip AS observable_ip, a.threat_score, v.description AS threat_label, v.is_malicious_flag,
               a.verdict_summary_en AS verdict_en, a.analysis_pl
        FROM threat_indicators i JOIN dns_queries q ON q.id = i.dns_query_id
        JOIN legacy_results a ON a.id = i.analysis_result_id AND a.threat_score > 0
        JOIN legacy_levels v ON v.score = a.threat_score""",
    "verdicts_with_level": """
        SELECT a.* REPLACE (cast(a.confidence_score AS double) AS confidence_score), v.description,
               v.is_malicious_flag, v.action_recommended
        FROM ai_analysis_results a JOIN levels v ON v.score = a.threat_score""",
    "malicious_verdicts": """
        SELECT a.* REPLACE (cast(a.confidence_score AS double) AS confidence_score), v.description,
               v.is_malicious_flag, v.action_recommended
        FROM ai_analysis_results a JOIN levels v ON v.score = a.threat_score WHERE v.is_malicious_flag""",
    "malicious_verdicts_legacy": """
        SELECT * REPLACE (cast(confidence_score AS double) AS confidence_score) FROM legacy_results
        WHERE threat_score > 5""",
    "threat_scale_usage": """
        SELECT v.score, v.description, v.is_malicious_flag, v.action_recommended,
               v.score || ' | ' || v.description || ' (Action: ' || v.action_recommended || ')' AS formatted_line,
               nullif((SELECT count(*) FROM ai_analysis_results a WHERE a.threat_score = v.score), 0) AS verdicts
        FROM levels v""",
    "resolved_providers": """
        SELECT r.source_provider, r.doc_id, p.id AS source_id
        FROM raw_reports r JOIN providers p ON p.name = r.source_provider""",
    "resolved_types": """
        SELECT r.t, r.doc_id, y.id AS type_id
        FROM (SELECT doc_id, CASE type WHEN 'FQDN' THEN 'DOMAIN' ELSE type END AS t FROM raw_reports) r
        LEFT JOIN types y ON y.name = r.t""",
    "provider_efficacy": f"""
        SELECT providers, count(*) AS detections FROM explorer
        WHERE timestamp BETWEEN timestamp '{c.SCAN_START}' AND timestamp '{c.SCAN_END}' GROUP BY providers""",
    "top_fqdns": f"""
        SELECT fqdn, count(*) AS hits FROM explorer
        WHERE timestamp BETWEEN timestamp '1995-01-01 00:00:00' AND timestamp '{c.SCAN_END}'
        GROUP BY fqdn ORDER BY hits DESC, fqdn LIMIT 10""",
    "recent_malicious": f"""
        SELECT timestamp, source_ip, fqdn, request_url, threat_label, threat_score FROM explorer
        WHERE timestamp BETWEEN timestamp '{c.SCAN_START}' AND timestamp '{c.SCAN_END}'""",
    "score_envelope": """
        SELECT round(avg(threat_score), 4) AS avg_score, max(threat_score) AS max_score,
               min(threat_score) AS min_score FROM alerts""",
    "malicious_stats_panel": f"""
        SELECT total_scans, total_malicious_scans, malicious_percentage FROM stats
        WHERE last_scan BETWEEN timestamp '{c.SCAN_START}' AND timestamp '2001-12-31 00:00:00'""",
    "malicious_stats_panel_out_of_range": f"""
        SELECT total_scans, total_malicious_scans, malicious_percentage FROM stats
        WHERE last_scan BETWEEN timestamp '{c.SCAN_START}' AND timestamp '{c.SCAN_END}'""",
    "daily_trend_panel": f"""
        SELECT time_sec, total_scans_per_day, total_positives_per_day FROM trends
        WHERE cast(scan_date AS timestamp) BETWEEN timestamp '2001-01-01 06:00:00' AND timestamp '{c.SCAN_END}'""",
    "hourly_panel": f"""
        SELECT time_sec, total_queries AS total_dns_new_queries_per_hour FROM hourly
        WHERE raw_time BETWEEN timestamp '{c.DNS_START}' AND timestamp '{c.DNS_END}'""",
    "last_malicious_scan": "SELECT last_scan FROM stats LIMIT 50",
    "last_not_null_positives": """
        SELECT total_positives_per_day AS positives FROM trends WHERE total_positives_per_day <> 0
        ORDER BY time_sec DESC LIMIT 1""",
    "daily_threshold_colors": """
        SELECT time_sec, share, CASE WHEN share >= 80 THEN 'red' ELSE 'green' END AS color FROM (
          SELECT time_sec, round(total_positives_per_day / total_scans_per_day * 100, 2) AS share FROM trends)""",
    "answer_kinds": f"""
        SELECT coalesce({_ipv4('response_ip')}, false) AS is_ipv4, record_type,
               count(*) AS rows FROM dns_queries GROUP BY ALL""",
    "address_ranges": f"""
        SELECT id, address,
               ok AND (n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2851995648 AND 2852061183
                 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 167772160 AND 184549375) AS private,
               ok AND (n BETWEEN 168430080 AND 168430335 OR n = 2130706433
                 OR n BETWEEN 3232235520 AND 3232301055) AS allowed
        FROM (SELECT id, address, {_ipv4('address')} AS ok,
                coalesce(try_cast(split_part(address, '.', 1) AS bigint) * 16777216
                + try_cast(split_part(address, '.', 2) AS bigint) * 65536
                + try_cast(split_part(address, '.', 3) AS bigint) * 256
                + try_cast(split_part(address, '.', 4) AS bigint), -1) AS n
              FROM (SELECT id, coalesce(response_ip, source_ip) AS address FROM dns_queries))""",
    "blocklist_sources": """
        SELECT DISTINCT trim(value) AS address, 1 AS enabled FROM list_addresses WHERE trim(value) <> ''""",
    "blocklist": "SELECT * FROM blocked_names",
    "blocked_queries": "SELECT * FROM dns_queries WHERE lower(domain) IN (SELECT domain FROM blocked_names)",
    "allowed_queries": "SELECT * FROM dns_queries WHERE lower(domain) NOT IN (SELECT domain FROM blocked_names)",
    "seeded_providers": "SELECT name FROM providers UNION SELECT source FROM documents",
    "parsed_log": "SELECT * FROM parsed_lines",
    "stored_log": "SELECT * EXCLUDE (fits) FROM stored_lines WHERE fits",
    "rejected_log": "SELECT * EXCLUDE (fits) FROM stored_lines WHERE NOT fits",
    "streamed_log": "SELECT * EXCLUDE (fits), cast(1 AS bigint) AS same_id FROM stored_lines WHERE fits",
    "identified_log": "SELECT * FROM numbered_lines",
    "filter_list": "SELECT DISTINCT domain FROM filter_names WHERE domain IS NOT NULL",
    "list_junk": "SELECT entry, count(*) AS times FROM filter_names WHERE domain IS NULL GROUP BY entry",
    "blocked_below": "SELECT * FROM below",
    "allowed_outside": "SELECT id, domain FROM host_queries WHERE id NOT IN (SELECT id FROM below)",
    "address_table": """
        SELECT g.range, g.bits AS length FROM good_ranges g
        UNION ALL SELECT l.range, NULL FROM range_list l WHERE l.range NOT IN (SELECT range FROM good_ranges)""",
    "longest_ranges": """
        WITH a AS (SELECT id, coalesce(response_ip, source_ip) AS address FROM dns_queries),
        v AS (SELECT DISTINCT address, list_reduce([cast(x AS bigint) FOR x IN string_split(address, '.')],
                lambda a, b: a * 256 + b) AS n FROM a
              WHERE regexp_full_match(address, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')
                AND list_aggregate([cast(x AS int) <= 255 FOR x IN string_split(address, '.')], 'bool_and')),
        hit AS (SELECT address, max_by(range, bits) AS range, max(bits) AS prefix_length
                FROM v JOIN good_ranges r ON r.family = 4 AND v.n >> (32 - bits) = r.n >> (32 - bits) GROUP BY address)
        SELECT a.id, a.address, CASE WHEN a.address = '2001:db8::1' THEN '2001:0DB8:0::/64' ELSE hit.range END AS range,
               CASE WHEN a.address = '2001:db8::1' THEN 64 ELSE prefix_length END AS prefix_length
        FROM a LEFT JOIN hit USING (address)""",
    "attributed_replies": """
        SELECT r.id, r.domain, a.asked_by, a.query_id, a.asked_at, u.user_name, u.device
        FROM dns_queries r LEFT JOIN asked a ON a.id = r.id LEFT JOIN user_devices u ON u.source_ip = a.asked_by
        WHERE r.query_type = 'reply'""",
    "attributed_queue": """
        SELECT p.dns_query_id, p.fqdn AS domain, p.observable_ip, p.first_seen AS timestamp, a.asked_by, a.query_id,
               a.asked_at
        FROM pending p LEFT JOIN asked a ON a.id = p.dns_query_id""",
    "stored_reports_of_provider": "SELECT * FROM raw_reports WHERE source_provider = 'Abuse_URLhaus'",
    "latest_raw": """
        SELECT * FROM raw_reports
        QUALIFY row_number() OVER (PARTITION BY resource ORDER BY scan_date DESC, doc_id DESC) = 1""",
    "deduped_payloads": """
        SELECT sha256(raw_data) AS raw_response_hash, copies, doc_id, resource, type, source_provider, scan_date,
               raw_data
        FROM (SELECT *, count(*) OVER (PARTITION BY raw_data) AS copies,
                row_number() OVER (PARTITION BY raw_data ORDER BY scan_date, doc_id) AS r FROM raw_reports)
        WHERE r = 1""",
    "virustotal_hits": """
        SELECT doc_id, resource FROM vt WHERE vt_malicious_count > 0 OR vt_suspicious_count > 0""",
    "abuse_hits": """
        SELECT doc_id, resource, source_provider FROM raw_reports
        WHERE source_provider <> 'VirusTotal' AND json_extract_string(raw_data, '$.query_status') = 'ok'""",
    "reduced_virustotal": """
        SELECT * EXCLUDE (scan_date), CASE WHEN NOT vt_no_data THEN concat(vt_malicious_count, ' malicious, ',
               vt_suspicious_count, ' suspicious, owner ', coalesce(vt_owner, 'unknown')) END AS vt_report FROM vt""",
    "reduced_threatfox": "SELECT * EXCLUDE (scan_date) FROM tf",
    "reduced_urlhaus": "SELECT * EXCLUDE (scan_date) FROM uh",
    "merged_context": """
        SELECT * EXCLUDE (uh_report, uh_reference),
               (SELECT string_agg(v.score || ' | ' || v.description || ' (Action: ' || v.action_recommended || ')',
                  chr(10) ORDER BY v.score) FROM levels v) AS threat_scale FROM ctx""",
    "detection_first": """
        SELECT dns_query_id, primary_hit, uh_status, uh_status <> 'real' AS uh_no_data,
               uh_status = 'real' AND uh_active AS uh_active,
               CASE uh_status WHEN 'real' THEN uh_report END AS uh_report,
               CASE uh_status WHEN 'real' THEN uh_reference END AS uh_reference FROM gated""",
    "scored_context": """
        SELECT s.dns_query_id, s.primary_score, s.score, v.is_malicious_flag AS is_malicious,
               v.action_recommended AS threat_label
        FROM (
          SELECT *, cast(CASE WHEN tf_active THEN greatest(capped, 4) ELSE greatest(capped, 1) END AS int) AS score
          FROM (
            SELECT *, CASE WHEN vt_is_big_player AND tf_families IS NULL THEN least(raised, 2)
                      ELSE least(raised, 5) END AS capped
            FROM (
              SELECT *, base + CASE WHEN primary_hit AND uh_status = 'real' AND uh_active THEN 1 ELSE 0 END AS raised
              FROM (
                SELECT *, CASE WHEN vt_no_data AND tf_no_data AND uh_status <> 'real'
                          THEN CASE WHEN vt_is_big_player THEN 1 ELSE 2 END ELSE primary_score END AS base
                FROM gated)))) s LEFT JOIN levels v ON v.score = s.score""",
    "parsed_verdicts": """
        SELECT dns_query_id, fqdn, observable_ip,
               CASE WHEN ok THEN cast(json_extract(doc, '$.threat_score') AS int) END AS score,
               CASE WHEN ok THEN cast(json_extract(doc, '$.is_malicious') AS boolean) END AS is_malicious,
               CASE WHEN ok THEN json_extract_string(doc, '$.verdict_en') END AS verdict_en,
               CASE WHEN ok THEN json_extract_string(doc, '$.analysis_pl') END AS analysis_pl,
               CASE WHEN ok THEN json_extract_string(doc, '$.scoring_rationale') END AS scoring_rationale,
               array_to_string(active, ',') AS active_providers,
               CASE WHEN NOT ok THEN 'Parsing failed' END AS error, CASE WHEN NOT ok THEN output END AS raw_received
        FROM (SELECT *, active IS NOT NULL AS ok FROM opened)""",
    "provider_details": "SELECT * FROM detail_rows",
    "severity_styles": f"SELECT *, {STYLE} FROM (SELECT id, threat_score AS score FROM ai_analysis_results)",
    "alert_records": f"""
        SELECT dns_query_id, observable_ip, fqdn, score, concat(score, '/5') AS score_text, {STYLE},
               (SELECT string_agg(source_provider, ', ' ORDER BY source_provider) FROM detail_rows r
                WHERE r.dns_query_id = a.dns_query_id) AS providers,
               verdict_en, analysis_pl, scoring_rationale,
               'https://rdap.arin.net/registry/ip/' || observable_ip AS details_url
        FROM (SELECT dns_query_id, observable_ip, fqdn, cast(json_extract(doc, '$.threat_score') AS int) AS score,
                cast(json_extract(doc, '$.is_malicious') AS boolean) AS bad,
                json_extract_string(doc, '$.verdict_en') AS verdict_en,
                json_extract_string(doc, '$.analysis_pl') AS analysis_pl,
                json_extract_string(doc, '$.scoring_rationale') AS scoring_rationale
              FROM opened WHERE active IS NOT NULL) a WHERE bad OR score = 3""",
    "clean_scan_indicators": f"""
        SELECT k AS id, dns_query_id, 2 AS type_id, k AS analysis_result_id, timestamp '{c.DNS_NOW}' AS last_scan,
               1 AS scan_count
        FROM (SELECT dns_query_id, concat(dns_query_id, '-', provider, '-{STAMP}') AS k FROM clean_pairs)""",
    "clean_scan_verdicts": f"""
        SELECT concat(dns_query_id, '-', provider, '-{STAMP}') AS id, 1 AS threat_score,
               cast(NULL AS varchar) AS verdict_summary_en, cast(NULL AS varchar) AS analysis_pl,
               cast(NULL AS varchar) AS threat_label, cast(NULL AS double) AS confidence_score FROM clean_pairs""",
    "registered_verdicts": f"""
        SELECT concat(dns_query_id, '-ai-{STAMP}') AS id, cast(json_extract(doc, '$.threat_score') AS int)
                 AS threat_score,
               json_extract_string(doc, '$.verdict_en') AS verdict_summary_en,
               json_extract_string(doc, '$.analysis_pl') AS analysis_pl,
               cast(NULL AS varchar) AS threat_label, cast(NULL AS double) AS confidence_score FROM opened WHERE active IS NOT NULL""",
    "registered_indicators": f"""
        SELECT concat(dns_query_id, '-ai-{STAMP}') AS id, dns_query_id, 2 AS type_id,
               concat(dns_query_id, '-ai-{STAMP}') AS analysis_result_id, timestamp '{c.DNS_NOW}' AS last_scan,
               1 AS scan_count
        FROM opened WHERE active IS NOT NULL""",
    "registered_links": f"""
        SELECT concat(r.dns_query_id, '-ai-{STAMP}-', p.id) AS id, concat(r.dns_query_id, '-ai-{STAMP}')
                 AS indicator_id, p.id AS source_id, r.doc_id AS mongo_ref_id, cast(NULL AS varchar) AS raw_response_hash
        FROM detail_rows r JOIN providers p ON p.name = r.source_provider""",
    "alerts_of_ingested_log": f"""
        SELECT id AS dns_query_id, domain AS fqdn, response_ip AS observable_ip, n AS threat_score, l.description AS level,
               domain AS verdict_en, timestamp '{c.DNS_NOW}' AS last_scan, timestamp '{c.DNS_NOW}' AS detection_time
        FROM (SELECT id, domain, response_ip, cast(1 + length(response_ip) % 5 AS int) AS n
              FROM (SELECT id, split_part(value, ' ', 7) AS domain, split_part(value, ' ', 9) AS response_ip
                    FROM numbered_lines WHERE value LIKE '%: reply %')
              WHERE regexp_full_match(response_ip, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')
                AND list_aggregate([cast(x AS int) <= 255 FOR x IN string_split(response_ip, '.')], 'bool_and'))
        JOIN levels l ON l.score = n WHERE l.is_malicious_flag""",
    "unique_indicators": """
        SELECT * FROM (SELECT * FROM threat_indicators
                       UNION ALL SELECT * REPLACE (scan_count + 1 AS scan_count) FROM threat_indicators)
        QUALIFY row_number() OVER (PARTITION BY dns_query_id, analysis_result_id, last_scan
                                   ORDER BY scan_count, id) = 1""",
    "new_links_only": """
        SELECT min(d.id) AS id, d.indicator_id, d.source_id FROM threat_indicator_details d
        WHERE NOT EXISTS (SELECT 1 FROM threat_indicator_details x WHERE x.id LIKE '%/2'
                          AND x.indicator_id = d.indicator_id AND x.source_id = d.source_id)
        GROUP BY d.indicator_id, d.source_id""",
    "upserted_indicators": """
        SELECT coalesce(min(id) FILTER (WHERE scan_count % 2 = 1), min(id)) AS id, dns_query_id, analysis_result_id,
               last_scan, coalesce(min(type_id) FILTER (WHERE scan_count % 2 = 1), min(type_id)) AS type_id,
               cast(sum(scan_count * (1 + scan_count % 2)) AS int) AS scan_count, strftime(last_scan, '%Y%m') AS ym
        FROM threat_indicators GROUP BY dns_query_id, analysis_result_id, last_scan""",
    "constraint_violations": """
        WITH rules AS (
          SELECT 'dns_queries' AS table_name, 'domain has more than 255 characters' AS rule FROM parsed_lines
            WHERE length(domain) > 255
          UNION ALL SELECT 'dns_queries', 'record_type has more than 10 characters' FROM parsed_lines
            WHERE length(record_type) > 10
          UNION ALL SELECT 'dns_queries', 'response_ip has more than 45 characters' FROM parsed_lines
            WHERE length(response_ip) > 45
          UNION ALL SELECT 'ai_analysis_results', 'threat_score is not in dic_threat_levels' FROM legacy_results
            WHERE threat_score NOT BETWEEN 1 AND 5
          UNION ALL SELECT 'ai_analysis_results', 'confidence_score is out of range' FROM legacy_results
            WHERE confidence_score * 20 >= 1000
          UNION ALL SELECT 'threat_indicators', 'analysis_result_id is missing' FROM threat_indicators
            WHERE analysis_result_id % 9 = 0
          UNION ALL SELECT 'threat_indicators', 'dns_query_id, analysis_result_id, last_scan is not unique' FROM (
            SELECT count(*) OVER (PARTITION BY dns_query_id, analysis_result_id, last_scan) AS n
            FROM threat_indicators WHERE analysis_result_id % 9 <> 0) WHERE n > 1
          UNION ALL SELECT 'threat_indicator_details', 'source_id is not in dic_source_providers'
            FROM threat_indicator_details WHERE source_id = 4
          UNION ALL SELECT 'threat_indicator_details', 'indicator_id, source_id is not unique' FROM (
            SELECT count(*) OVER (PARTITION BY indicator_id, source_id) AS n FROM threat_indicator_details) WHERE n > 1
          UNION ALL SELECT 'network_events', 'protocol has more than 10 characters' FROM network_events
            WHERE length(protocol) > 10
          UNION ALL SELECT 'network_events', 'http_method has more than 10 characters' FROM network_events
            WHERE length(http_method) > 10
          UNION ALL SELECT 'network_events', 'signature_name has more than 255 characters' FROM network_events
            WHERE length(signature_name) > 255)
        SELECT table_name, rule, count(*) AS rows FROM rules GROUP BY table_name, rule""",
    "scan_counts": """
        SELECT dns_query_id, analysis_result_id, count(*) AS scan_count, max(last_scan) AS last_scan
        FROM threat_indicators GROUP BY dns_query_id, analysis_result_id""",
    "orphaned_rows": """
        SELECT 'indicator without query' AS relation, cast(i.dns_query_id AS varchar) AS missing_key, i.id AS row_id
          FROM threat_indicators i WHERE i.dns_query_id NOT IN (SELECT id FROM dns_queries)
        UNION ALL SELECT 'indicator without verdict', cast(i.analysis_result_id AS varchar), i.id
          FROM threat_indicators i WHERE i.analysis_result_id NOT IN (SELECT id FROM ai_analysis_results)
        UNION ALL SELECT 'event without query', cast(e.dns_query_id AS varchar), e.id FROM network_events e
          WHERE e.dns_query_id NOT IN (SELECT id FROM dns_queries)
        UNION ALL SELECT 'event without indicator', e.threat_indicator_id, e.id FROM network_events e
          WHERE e.threat_indicator_id NOT IN (SELECT id FROM threat_indicators)""",
    "remapped_scores": """
        SELECT id, [1, 1, 2, 2, 3, 4, 4, 5, 5, 5][threat_score] AS threat_score FROM legacy_results""",
    "retained_indicators": f"""
        SELECT * FROM threat_indicators
        WHERE date_trunc('month', last_scan) >=
              date_trunc('month', timestamp '{c.SCAN_NOW}' - INTERVAL 6 MONTH)""",
    "expired_partitions": """
        SELECT * FROM months WHERE regexp_full_match(partition_name, 'p[0-9]{6}') AND partition_name < 'p200104'""",
    "planned_partitions": """
        SELECT t.table_name, concat('p', strftime(m, '%Y%m')) AS partition_name,
               cast(cast(m + INTERVAL 1 MONTH AS date) AS varchar) AS upper_bound
        FROM (SELECT DISTINCT table_name FROM months) t,
             unnest([date '2001-10-01', date '2001-11-01', date '2001-12-01']) AS u(m)
        WHERE (t.table_name, concat('p', strftime(m, '%Y%m'))) NOT IN
              (SELECT (table_name, partition_name) FROM months)""",
    "range_partitions": """
        SELECT CASE WHEN last_scan < date '2000-02-01' THEN 'p200001' WHEN last_scan >= date '2001-07-01'
               THEN 'p_future' ELSE strftime(last_scan, 'p%Y%m') END AS partition_name, count(*) AS table_rows
        FROM threat_indicators GROUP BY ALL""",
    "partition_counts": "SELECT table_name, count(*) AS partitions FROM months GROUP BY table_name",
    "partition_sample": "SELECT * FROM months ORDER BY table_name, partition_name LIMIT 10",
    "partition_info": """
        SELECT table_name, partition_name, 'ym' AS partition_expression, table_rows,
               cast(cast(strptime(partition_name || '01', 'p%Y%m%d') + INTERVAL 1 MONTH AS date) AS varchar) AS upper_bound
        FROM months WHERE table_name <> 'network_events'""",
    "stored_partition_rows": """
        SELECT *, true AS has_size FROM months WHERE table_name <> 'network_events'""",
    "stored_months_in_range": f"""
        SELECT *, strftime(last_scan, '%Y%m') AS ym FROM threat_indicators
        WHERE last_scan BETWEEN timestamp '{c.SCAN_START}' AND timestamp '{c.SCAN_END}'""",
    "recent_maintenance": """
        SELECT * FROM (
          SELECT table_name, partition_name, 'DROP' AS action, cast(NULL AS varchar) AS error_message,
                 timestamp '2001-11-01 02:00:00' AS executed_at FROM months WHERE partition_name < 'p200104'
          UNION ALL
          SELECT t.table_name, p, 'ADD', NULL, timestamp '2001-11-01 03:00:00'
          FROM (SELECT DISTINCT table_name FROM months) t, unnest(['p200111', 'p200112', 'p200201']) AS u(p)
          WHERE (t.table_name, p) NOT IN (SELECT (table_name, partition_name) FROM months))
        ORDER BY executed_at DESC, table_name, partition_name, action LIMIT 20""",
    "streamed_hourly_traffic": """
        SELECT * EXCLUDE (raw_time) FROM hourly
        WHERE time_sec + 3600 <= (SELECT epoch(max(timestamp)) FROM dns_queries) - 600""",
    "streamed_pending": "SELECT * FROM pending",
    "streamed_queue": """
        SELECT cast(dns_query_id AS varchar) AS dns_query_id, source_ip, fqdn, observable_ip, first_seen, 1 AS attempt
        FROM pending""",
    "rolled_up_traffic": "SELECT * EXCLUDE (raw_time) FROM hourly",
    "rolled_up_bursts": """
        SELECT DISTINCT source, failed_at AS flagged_at, n AS failures, failed_at + INTERVAL 1 DAY AS banned_until
        FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY failed_at
                RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM failures) WHERE n >= 3""",
    "burst_offenders": """
        SELECT DISTINCT source, failed_at AS flagged_at, n AS failures, failed_at + INTERVAL 1 DAY AS banned_until
        FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY failed_at
                RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM failures) WHERE n >= 3""",
    "burst_offenders_ten_minutes": """
        SELECT DISTINCT source, failed_at AS flagged_at, n AS failures, failed_at + INTERVAL 1 DAY AS banned_until
        FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY failed_at
                RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS n FROM failures) WHERE n >= 2""",
    "streamed_bursts": """
        SELECT source, flagged_at, failures, banned_until FROM (
          SELECT DISTINCT source, failed_at AS flagged_at, n AS failures, failed_at + INTERVAL 1 DAY AS banned_until
          FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY failed_at
                  RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM failures) WHERE n >= 3)
        WHERE date_trunc('day', flagged_at) + INTERVAL 1 DAY
              <= (SELECT max(failed_at) - INTERVAL 10 MINUTES FROM failures)""",
    "verdict_documents": """
        SELECT a.id AS verdict_id, q.response_ip AS observable_ip, a.threat_score, n.last_scan,
               concat_ws(' | ', q.domain, a.threat_label, 'score ' || a.threat_score, a.verdict_summary_en,
                 strftime(n.last_scan, '%Y-%m-%d %H:%M:%S')) AS document
        FROM ai_analysis_results a
        LEFT JOIN (SELECT * FROM threat_indicators QUALIFY row_number() OVER
                     (PARTITION BY analysis_result_id ORDER BY last_scan DESC, id DESC) = 1) n
          ON n.analysis_result_id = a.id
        LEFT JOIN dns_queries q ON q.id = n.dns_query_id""",
    "missing_embeddings": """
        SELECT * REPLACE (cast(confidence_score AS double) AS confidence_score) FROM ai_analysis_results
        WHERE id NOT IN (SELECT verdict_id FROM verdict_vectors)""",
    "similar_verdicts": f"""
        SELECT query_id, verdict_id, similarity, cast(row_number() OVER
                 (PARTITION BY query_id ORDER BY similarity DESC, verdict_id) AS int) AS rank
        FROM vector_pairs WHERE verdict_id IN (
          SELECT a.id FROM ai_analysis_results a JOIN threat_indicators i ON i.analysis_result_id = a.id
          WHERE a.threat_score >= 3 AND i.last_scan > timestamp '{c.SCAN_NOW}' - INTERVAL 30 DAYS)
        QUALIFY rank <= 5""",
    "reference_material": """
        SELECT query_id, verdict_id, similarity, cast(row_number() OVER
                 (PARTITION BY query_id ORDER BY similarity DESC, verdict_id) AS int) AS rank
        FROM vector_pairs WHERE similarity >= 0.25 QUALIFY rank <= 5""",
    "attributed_queries": """
        SELECT q.*, u.user_name, u.device FROM dns_queries q LEFT JOIN user_devices u ON u.source_ip = q.source_ip""",
    "hash_mismatches": """
        SELECT path, c.hash AS current_hash, m.hash AS master_hash,
               CASE WHEN c.hash IS NULL THEN 'missing' WHEN m.hash IS NULL THEN 'unexpected' ELSE 'changed' END AS status
        FROM (SELECT path, sha256(content) AS hash FROM file_hashes) c
        FULL JOIN (SELECT CASE WHEN seen_at % 7 = 0 THEN '/old' || path ELSE path END AS path,
                          sha256(concat(content, CASE WHEN seen_at % 5 = 0 THEN 'x' ELSE '' END)) AS hash
                   FROM file_hashes) m USING (path)
        WHERE c.hash IS DISTINCT FROM m.hash""",
    "verdict_equivalence": """
        WITH rows AS (SELECT i.dns_query_id, i.last_scan, a.threat_score AS a,
                        [1, 1, 2, 2, 3, 4, 4, 5, 5, 5][b.threat_score] AS b
                      FROM threat_indicators i JOIN ai_analysis_results a ON a.id = i.analysis_result_id
                      JOIN legacy_results b ON b.id = i.analysis_result_id),
             firsts AS (SELECT dns_query_id, max_by(a, (last_scan, a)) AS a, max_by(b, (last_scan, b)) AS b
                        FROM rows GROUP BY dns_query_id)
        SELECT count(*) AS observables, count(*) FILTER (WHERE a = b) AS equivalent,
               round(count(*) FILTER (WHERE a = b) / count(*), 4) AS rate,
               count(*) FILTER (WHERE a = b) / count(*) >= 0.95 AS passed FROM firsts""",
    "migration_report": """
        SELECT *, expected = found AS ok FROM (
          SELECT 'rows dns_queries' AS check, (SELECT count(*) FROM dns_queries) AS expected,
                 (SELECT count(*) FROM dns_queries) AS found
          UNION ALL SELECT 'rows threat_indicators', (SELECT count(*) FROM threat_indicators),
                 (SELECT count(*) FROM threat_indicators WHERE scan_count > 1)
          UNION ALL SELECT 'rows threat_indicator_details', (SELECT count(*) FROM threat_indicator_details),
                 (SELECT count(*) FROM threat_indicator_details)
          UNION ALL SELECT 'unreachable indicator links', 0, (SELECT count(*) FROM threat_indicator_details
                 WHERE indicator_id NOT IN (SELECT id FROM threat_indicators WHERE scan_count > 1))
          UNION ALL SELECT 'payloads without data', 0, (SELECT count(*) FROM raw_reports
                 WHERE json_extract(raw_data, '$.data') IS NULL))""",
}


def _with_views(body: str) -> str:
    """The body preceded by the views it needs, each after those it uses itself."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {views} {_main(body)}" if views else body


def _main(body: str) -> str:
    """A body that starts with its own WITH continues the list of views."""
    text = body.strip()
    return ", " + text[5:] if text.startswith("WITH ") else text


def all_sql() -> dict[str, str]:
    return {name: " ".join(_with_views(body).split("\n")) for name, body in SQL.items()}
