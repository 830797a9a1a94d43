"""Writing verdicts and indicators, and keeping their keys.

Keys are natural: the table's unique columns joined to a string. They are the
same on every run and retry, cannot collide, and need no global counter, which
generated numbers or 64-bit hashes would not give at this size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.reports import resolve_ids


def _verdict_columns() -> list[Column]:
    """Columns of the verdict table that a new row leaves open."""
    return [F.lit(None).cast("string").alias("threat_label"),
            F.lit(None).cast("decimal(5, 2)").alias("confidence_score")]


def _first_scan(key: Column, now: Column) -> list[Column]:
    return [key.alias("analysis_result_id"), now.cast("timestamp_ntz").alias("last_scan"),
            F.lit(1).alias("scan_count")]


def _stamp(now: Column) -> Column:
    return F.date_format(now, "yyyyMMddHHmmss")


def register_clean_scans(clean: DataFrame, types: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Baseline verdicts and indicators for observables that a provider has nothing on.

    `clean` has one row per (dns_query_id, provider), so a query scanned clean
    by several providers gets several indicators of the same second.
    """
    keyed = clean.select("dns_query_id", F.concat_ws(
        "-", F.col("dns_query_id").cast("string"), "provider", _stamp(now)).alias("id"))
    nothing = F.lit(None).cast("string")
    verdicts = keyed.select("id", F.lit(1).alias("threat_score"), nothing.alias("verdict_summary_en"),
                            nothing.alias("analysis_pl"), *_verdict_columns())
    typed = resolve_ids(keyed.withColumn("type_name", F.lit("IP")), types, "type_name", "type_id", "left")
    indicators = typed.select("id", "dns_query_id", "type_id", *_first_scan(F.col("id"), now))
    return verdicts, indicators


def register_verdicts(verdicts: DataFrame, details: DataFrame, types: DataFrame, providers: DataFrame,
                      now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdict, indicator and provider rows for parsed verdicts; all three share one key."""
    key = F.concat_ws("-", F.col("dns_query_id").cast("string"), F.lit("ai"), _stamp(now))
    good = verdicts.filter("error IS NULL").withColumn("id", key)
    results = good.select("id", F.col("score").alias("threat_score"),
                          F.col("verdict_en").alias("verdict_summary_en"), "analysis_pl", *_verdict_columns())
    typed = resolve_ids(good.select("id", "dns_query_id").withColumn("type_name", F.lit("IP")),
                        types, "type_name", "type_id", "left")
    indicators = typed.select("id", "dns_query_id", "type_id", *_first_scan(F.col("id"), now))
    links = resolve_ids(details, providers, "source_provider", "source_id").select(
        F.concat_ws("-", key, F.col("source_id").cast("string")).alias("id"),
        key.alias("indicator_id"), "source_id", F.col("doc_id").alias("mongo_ref_id"),
        F.lit(None).cast("string").alias("raw_response_hash"))
    return results, indicators, links


def enforce_unique(df: DataFrame, keys: list[str], order: list[str], target: DataFrame | None = None) -> DataFrame:
    """First row per key by `order`, without keys that `target` already holds.

    A minimum with map-side combine: copies of one key meet as one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
             .select(*keys, "r.*").select(*df.columns))
    if target is None:
        return first
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def scan_counts(ti: DataFrame) -> DataFrame:
    """How often each (query, verdict) pair was scanned, and when last."""
    return ti.groupBy("dns_query_id", "analysis_result_id").agg(
        F.count("*").alias("scan_count"), F.max("last_scan").alias("last_scan"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose non-NULL logical key has no parent.

    The parent's key is unique, so it needs no aggregate first; both sides are
    shuffled for this join, and a hot key among the children can be split.
    """
    known = parent.select(F.col(parent_key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def remap_scores(df: DataFrame, score: str = "threat_score") -> DataFrame:
    """Ten-point scores on the five-point scale: 1-2, 3-4, 5, 6-7 and 8-10."""
    s, out = F.col(score), F.lit(None).cast("int")
    # Old range, new score.
    for low, high, new in [(1, 2, 1), (3, 4, 2), (5, 5, 3), (6, 7, 4), (8, 10, 5)]:
        out = F.when(s.between(low, high), new).otherwise(out)
    return df.withColumn(score, out)
