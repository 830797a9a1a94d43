"""Declared table schemas and the fixed dictionary rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DNS_QUERIES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("query_type", T.StringType(), False),
    T.StructField("record_type", T.StringType()),
    T.StructField("domain", T.StringType(), False),
    T.StructField("source_ip", T.StringType(), False),
    T.StructField("response_ip", T.StringType()),
])

RAW_REPORTS = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("resource", T.StringType(), False),
    T.StructField("type", T.StringType()),
    T.StructField("source_provider", T.StringType(), False),
    T.StructField("scan_date", T.StringType(), False),
    T.StructField("raw_data", T.StringType()),
])

MAINTENANCE_LOG = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("partition_name", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("executed_at", T.TimestampNTZType(), False),
])

# Column lengths that a stored DNS row must respect.
DNS_LENGTHS = {"query_type": 10, "record_type": 10, "domain": 255, "source_ip": 45, "response_ip": 45}
DNS_REQUIRED = ["timestamp", "query_type", "domain", "source_ip"]

# The three dictionaries.
INDICATOR_TYPES = [(1, "FQDN"), (2, "IP"), (3, "HASH")]
SOURCE_PROVIDERS = [(1, "VirusTotal"), (2, "Abuse_ThreatFox"), (3, "Abuse_URLhaus"), (4, "urlscan.io")]
THREAT_LEVELS = [
    (1, "Clean / Trusted infrastructure", False, "Allow"),
    (2, "Low Risk / Monitor", False, "Monitor"),
    (3, "Suspicious - manual review needed", False, "Review"),
    (4, "Malicious - confirmed threat", True, "Block"),
    (5, "Critical - active threat, immediate alert", True, "Block + Alert"),
]
# The older ten-point scale, for the legacy report forms.
LEGACY_THREAT_LEVELS = [
    (1, "Safe / Clean", False),
    (2, "Low Risk", False),
    (3, "Informational / CDN", False),
    (4, "Unverified / New", False),
    (5, "Suspicious - review needed", False),
    (6, "Likely Malicious - investigation required", True),
    (7, "Malicious - known threat", True),
    (8, "High Risk - immediate attention", True),
    (9, "Confirmed Malware - to be blocked", True),
    (10, "Critical Threat - active attack", True),
]


def _dictionary(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Rows as SQL VALUES, whose exact size the planner knows: it broadcasts them
    by its own size check, whereas rows sent from Python have an unknown size."""
    def literal(value) -> str:
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def indicator_types(spark: SparkSession) -> DataFrame:
    return _dictionary(spark, INDICATOR_TYPES, "id, name")


def source_providers(spark: SparkSession) -> DataFrame:
    return _dictionary(spark, SOURCE_PROVIDERS, "id, name")


def threat_levels(spark: SparkSession) -> DataFrame:
    return _dictionary(spark, THREAT_LEVELS, "score, description, is_malicious_flag, action_recommended")


def legacy_threat_levels(spark: SparkSession) -> DataFrame:
    return _dictionary(spark, LEGACY_THREAT_LEVELS, "score, description, is_malicious_flag")
