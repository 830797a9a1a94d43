"""The reference tables, derived from the test data.

Each table is a list of (source, expressions) parts that are united; the failures have
a condition as well, as they are the failed events.
The expressions use SQL that Spark and DuckDB share, so that both engines start
from the same rows; what is compared are the operators on top. All of it is
column-wise: no derivation shuffles, and every source row gives a row. Some keys are
shifted to values without a partner (negative numbers, a `none-` prefix). They leave
queries without indicator, indicators without verdict and events without link, which
the operators must meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAIN = "concat('d', cast(user_id as string), '.example.com')"
ANSWER_IP = "concat(cast(1 + user_id % 223 as string), '.', cast(event_id % 256 as string), '.7.9')"
CLIENT_IP = "concat('192.168.1.', cast(user_id % 20 as string))"
INDICATOR_ID = ("concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', "
                "cast(year(l_shipdate) * 1000 + dayofyear(l_shipdate) as string))")
ISO_TS = "concat(replace(cast(date_trunc('second', ts) as string), ' ', 'T'), 'Z')"
HAS_ANSWER = "event_id % 3 <> 0 AND event_id % 10 NOT IN (1, 2, 3, 4)"


def shifted(key: str, condition: str) -> str:
    """A text key, or where the condition fails one that has no partner."""
    return f"CASE WHEN {condition} THEN {key} ELSE concat('none-', {key}) END"


def negated(key: str, condition: str) -> str:
    """A number, or where the condition fails its negative, which has no partner."""
    return f"CASE WHEN {condition} THEN {key} ELSE -{key} END"


LINKED = "l_orderkey % 4 <> 0"
STORED_ID = shifted(INDICATOR_ID, LINKED)

VT_JSON = ("CASE WHEN event_id % 11 = 0 THEN '{\"error\":{\"code\":\"NotFoundError\"}}' ELSE concat("
           "'{\"data\":{\"attributes\":{\"last_analysis_stats\":{\"malicious\":', cast(event_id % 4 as string), "
           "',\"suspicious\":', cast(event_id % 5 % 2 as string), ',\"undetected\":60},\"as_owner\":\"', "
           "CASE user_id % 4 WHEN 0 THEN 'Google LLC' WHEN 1 THEN 'Cloudflare, Inc.' ELSE 'Harbour Hosting' END, "
           "'\",\"last_analysis_date\":', cast(1700000000 + event_id as string), '}}}') END")
TF_JSON = ("CASE WHEN event_id % 3 = 0 THEN '{\"query_status\":\"no_result\",\"data\":\"no results\"}' ELSE concat("
           "'{\"query_status\":\"ok\",\"data\":[{\"malware_printable\":', "
           "CASE WHEN event_id % 5 = 0 THEN 'null' ELSE concat('\"Family', cast(event_id % 6 as string), '\"') END, "
           "',\"threat_type\":\"botnet_cc\",\"confidence_level\":', cast(event_id % 101 as string), "
           "'},{\"malware_printable\":', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '\"Family9\"' END, "
           "',\"threat_type\":\"payload\",\"confidence_level\":50}]}') END")
UH_JSON = ("CASE WHEN event_id % 5 = 0 THEN '{\"query_status\":\"no_results\"}' ELSE concat("
           "'{\"query_status\":\"ok\",\"urlhaus_reference\":\"https://lists.example/host/', cast(user_id as string), "
           "'\",\"urls\":[{\"url\":\"http://', cast(user_id as string), '.example.com/a\",\"url_status\":\"', "
           "CASE WHEN event_id % 2 = 0 THEN 'online' ELSE 'offline' END, "
           "'\",\"threat\":\"malware_download\"},{\"url\":\"http://b.example.com\",\"url_status\":\"offline\","
           "\"threat\":\"malware_download\"}]}') END")
VERDICT_TEXT = (
    "CASE event_id % 7 WHEN 0 THEN concat('{\"threat_score\": 4, broken ', cast(event_id as string)) "
    "WHEN 1 THEN '{\"threat_score\": 2, \"is_malicious\": false}' "
    "ELSE concat('```json', chr(10), '{\"threat_score\": ', cast(1 + event_id % 5 as string), "
    "', \"is_malicious\": ', CASE WHEN event_id % 5 >= 3 THEN 'true' ELSE 'false' END, ',', chr(10), "
    "'\"verdict_en\": \"verdict ', cast(event_id as string), '\", \"analysis_pl\": \"opis ', "
    "cast(user_id as string), '\",', chr(10), '\"scoring_rationale\": \"rule\", \"active_providers\": ', "
    "CASE event_id % 4 WHEN 0 THEN '[\"virustotal\"]' WHEN 1 THEN '[\"virustotal\", \"threatfox\"]' "
    "WHEN 2 THEN '[\"urlhaus\", \"other\"]' ELSE '[]' END, '}', chr(10), '```') END")
LOG_LINE = (
    "concat('Jan  1 00:00:00 dnsmasq[77]: ', CASE event_id % 9 "
    f"WHEN 0 THEN concat('query[A] ', {DOMAIN}, ' from ', {CLIENT_IP}) "
    f"WHEN 1 THEN concat('reply ', {DOMAIN}, ' is ', {ANSWER_IP}) "
    f"WHEN 2 THEN concat('forwarded ', {DOMAIN}, ' to 10.10.10.2') "
    f"WHEN 3 THEN concat('reply ', {DOMAIN}, ' is <CNAME>') "
    f"WHEN 4 THEN concat('reply ', {DOMAIN}, ' is NXDOMAIN') "
    f"WHEN 5 THEN concat('reply ', {DOMAIN}, ' is 2001:db8::', cast(event_id % 10000 as string)) "
    f"WHEN 6 THEN concat('query[type=65] ', {DOMAIN}, ' from ', {CLIENT_IP}) "
    f"WHEN 7 THEN concat('reply ', repeat('a', cast(240 + event_id % 20 as int)), '.com is NODATA-IPv6') "
    f"ELSE concat('query[HTTPS]  ', {DOMAIN}, '  from  ', {CLIENT_IP}) END)")

TABLES: dict[str, list[tuple]] = {
    "dns_queries": [("events", [
        "event_id AS id",
        "date_trunc('second', ts) AS timestamp",
        "CASE WHEN event_id % 3 = 0 THEN 'query' ELSE 'reply' END AS query_type",
        "CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 10 = 1 THEN 'N/A' WHEN event_id % 10 = 2 THEN 'OTHER' "
        "WHEN event_id % 10 = 3 THEN 'AAAA' ELSE 'A' END AS record_type",
        f"{DOMAIN} AS domain",
        f"CASE WHEN event_id % 3 = 0 THEN {CLIENT_IP} ELSE 'N/A' END AS source_ip",
        "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'NXDOMAIN' "
        "WHEN event_id % 10 = 2 THEN '<CNAME>' WHEN event_id % 10 = 3 THEN '2001:db8::1' "
        f"WHEN event_id % 10 = 4 THEN '999.1.2.3' ELSE {ANSWER_IP} END AS response_ip",
    ])],
    "threat_indicators": [("lineitem", [
        f"{STORED_ID} AS id", f"{negated('l_orderkey', LINKED)} AS dns_query_id", "2 AS type_id",
        "l_partkey AS analysis_result_id", "l_shipdate AS last_scan", "cast(l_quantity as int) AS scan_count",
    ])],
    "ai_analysis_results": [("part", [
        f"{negated('p_partkey', 'p_partkey % 50 <> 0')} AS id", "1 + p_size % 5 AS threat_score", "p_type AS threat_label",
        "p_name AS verdict_summary_en", "p_brand AS analysis_pl",
        "cast(p_size * 1.5 as decimal(5, 2)) AS confidence_score",
    ])],
    # Verdicts on the older ten-point scale.
    "legacy_results": [("part", [
        f"{negated('p_partkey', 'p_partkey % 50 <> 0')} AS id", "1 + p_size % 10 AS threat_score", "p_type AS threat_label",
        "p_name AS verdict_summary_en", "p_brand AS analysis_pl",
        "cast(p_size * 1.5 as decimal(5, 2)) AS confidence_score",
    ])],
    "threat_indicator_details": [
        ("lineitem", [f"concat({STORED_ID}, '/1') AS id",
                      f"{shifted(STORED_ID, 'l_linenumber <> 7')} AS indicator_id",
                      "cast(1 + l_suppkey % 4 as int) AS source_id"]),
        ("lineitem", [f"concat({STORED_ID}, '/2') AS id",
                      f"{shifted(STORED_ID, 'l_linenumber IN (2, 4, 6)')} AS indicator_id",
                      "cast(1 + (l_suppkey + 1) % 4 as int) AS source_id"]),
    ],
    "network_events": [("lineitem", [
        "concat(cast(l_orderkey as string), '@', cast(l_linenumber as string), '@', cast(l_partkey as string), '@', "
        "cast(l_suppkey as string)) AS id",
        "l_shipdate + l_linenumber * INTERVAL '1' HOUR AS timestamp",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_orderkey END AS dns_query_id",
        f"CASE WHEN l_linenumber = 3 THEN NULL ELSE {INDICATOR_ID} END AS threat_indicator_id",
        "concat('192.168.1.', cast(l_suppkey % 20 as string)) AS source_ip",
        "'203.0.113.9' AS dest_ip",
        "cast(l_partkey % 65536 as int) AS dest_port",
        "CASE l_linenumber WHEN 1 THEN 'TCP' WHEN 2 THEN 'UDP' WHEN 3 THEN 'ICMP-REDIRECT' END AS protocol",
        "'tls' AS application_protocol",
        "concat('agent/', cast(l_suppkey as string)) AS user_agent",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'GET' ELSE 'PROPPATCHES' END AS http_method",
        "cast(l_linenumber as int) AS severity",
        "CASE WHEN l_partkey % 10 = 0 THEN repeat('s', 256) ELSE 's' END AS signature_name",
        "concat('https://d', cast(l_partkey as string), '.example.com/p') AS request_url",
        "CASE l_returnflag WHEN 'R' THEN 'alert' WHEN 'A' THEN 'flow' ELSE 'http_request' END AS event_type",
        "CASE WHEN l_returnflag = 'R' THEN 'blocked' ELSE 'allowed' END AS action_taken",
    ])],
    "raw_reports": [
        ("events", ["concat('vt-', cast(event_id as string)) AS doc_id", f"{shifted(ANSWER_IP, HAS_ANSWER)} AS resource", "'IP' AS type",
                    "'VirusTotal' AS source_provider", f"{ISO_TS} AS scan_date", f"{VT_JSON} AS raw_data"]),
        ("events", ["concat('tf-', cast(event_id as string)) AS doc_id", f"{shifted(DOMAIN, 'user_id % 3 <> 0')} AS resource", "'FQDN' AS type",
                    "'Abuse_ThreatFox' AS source_provider", f"{ISO_TS} AS scan_date", f"{TF_JSON} AS raw_data"]),
        ("events", ["concat('uh-', cast(event_id as string)) AS doc_id", f"{shifted(DOMAIN, 'user_id % 2 = 0')} AS resource", "'FQDN' AS type",
                    "'Abuse_URLhaus' AS source_provider", f"{ISO_TS} AS scan_date", f"{UH_JSON} AS raw_data"]),
    ],
    # Model output for observables: free text that should hold one JSON object.
    "verdict_texts": [("events", [
        f"{negated('event_id', HAS_ANSWER)} AS dns_query_id", f"{DOMAIN} AS fqdn", f"{ANSWER_IP} AS observable_ip",
        f"{VERDICT_TEXT} AS output",
    ])],
    "log_lines": [("events", [f"{LOG_LINE} AS value"])],
    "list_lines": [("pages", [
        "CASE page_id % 4 WHEN 0 THEN concat('0.0.0.0 ', split_part(split_part(url, '://', 2), '/', 1), ' # listed') "
        "WHEN 1 THEN concat('  ', upper(split_part(split_part(url, '://', 2), '/', 1))) "
        "WHEN 2 THEN '# a comment' ELSE concat('127.0.0.1 localhost d', cast(page_id as string), '.example.com') END "
        "AS value"])],
    # Every syntax that downloaded lists use, and names below the listed ones.
    "filter_lines": [("pages", [
        "CASE page_id % 9 WHEN 0 THEN concat('||d', cast(page_id as string), '.example.com^') "
        "WHEN 1 THEN concat('*.d', cast(page_id as string), '.example.com') "
        "WHEN 2 THEN concat('  D', cast(page_id as string), '.Example.com.') "
        "WHEN 3 THEN concat('0.0.0.0 cdn1.d', cast(page_id as string), '.example.com  d', cast(page_id as string), "
        "'.example.com # two') "
        "WHEN 4 THEN concat('! comment ', cast(page_id % 7 as string)) WHEN 5 THEN '[Adblock Plus 2.0]' "
        "WHEN 6 THEN concat('@@||d', cast(page_id as string), '.example.com^') "
        "WHEN 7 THEN concat('::1 ip6-localhost b.d', cast(page_id as string), '.example.com') "
        "ELSE concat('||', split_part(split_part(url, '://', 2), '/', 1), '^$third-party') END AS value"])],
    "host_queries": [("events", [
        "event_id AS id",
        f"CASE event_id % 4 WHEN 0 THEN {DOMAIN} WHEN 1 THEN concat('cdn', cast(event_id % 3 as string), '.', {DOMAIN}) "
        f"WHEN 2 THEN upper(concat('a.b.', {DOMAIN}, '.')) ELSE concat('x', {DOMAIN}) END AS domain"])],
    # Nested ranges of both families, and texts that are none.
    "range_list": [
        ("nation", ["concat(cast(1 + n_nationkey * 9 as string), '.0.0.0/8') AS range"]),
        ("supplier", ["concat(cast(1 + s_suppkey % 223 as string), '.', cast(s_suppkey % 256 as string), '.0.0/16') AS range"]),
        ("customer", ["concat(cast(1 + c_custkey % 223 as string), '.', cast(c_custkey % 256 as string), '.7.', "
                      "CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '0/27' END) AS range"]),
        ("region", ["CASE r_regionkey WHEN 0 THEN '2001:db8::/32' WHEN 1 THEN '2001:0DB8:0::/64' WHEN 2 THEN 'fe80::/10' "
                    "WHEN 3 THEN 'no range' ELSE '10.0.0.0/33' END AS range"])],
    "list_addresses": [("pages", [
        "CASE WHEN page_id % 5 = 0 THEN '   ' ELSE concat('  ', split_part(url, '?', 1), ' ') END AS value"])],
    "user_devices": [("customer", [
        "concat('192.168.1.', cast(c_custkey as string)) AS source_ip", "c_name AS user_name",
        "c_mktsegment AS device"])],
    "failures": [("events", [
        "user_id AS source", "date_trunc('second', ts) AS failed_at"], "event_type = 'error'")],
    "verdict_vectors": [("embeddings", ["vec_id AS verdict_id", "embedding AS vector"])],
    "file_hashes": [("documents", [
        "concat('/srv/', source, '/', cast(doc_id as string)) AS path", "n_chars AS seen_at", "text AS content"])],
}

# Wall-clock columns that a SQL expression above would give a session zone.
_NTZ = {"timestamp", "failed_at"}


def derive(spark: SparkSession, sf_dir: str, table: str, streaming: bool = False) -> DataFrame:
    """One reference table from the parquet files of a scale-factor folder."""
    parts = []
    for source, expressions, *condition in TABLES[table]:
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        if streaming:
            rows = (spark.readStream.schema(rows.schema)
                    .option("pathGlobFilter", f"{source}.parquet").parquet(sf_dir))
        parts.append(rows.filter(condition[0] if condition else "true").selectExpr(*expressions))
    df = reduce(DataFrame.unionAll, parts)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c in _NTZ})


def derivation_sql(table: str) -> str:
    """The same derivation for a SQL engine that has the source tables as views."""
    return " UNION ALL ".join(
        f"SELECT {', '.join(expressions)} FROM {source} WHERE {condition[0] if condition else 'true'}"
        for source, expressions, *condition in TABLES[table])
