"""Predicates and gates on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.functions.times import month_key


def with_level(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds the level's columns by score; a score outside the dictionary drops the row.

    No broadcast hint: the planner broadcasts the dictionary because it measures
    its size, and would shuffle should someone pass a large one.
    """
    return df.join(levels.withColumnRenamed("score", "threat_score"), "threat_score")


def malicious_only(df: DataFrame, levels: DataFrame) -> DataFrame:
    return with_level(df, levels.filter("is_malicious_flag"))


def malicious_legacy(df: DataFrame, threshold: int = 5) -> DataFrame:
    """Older rule on the ten-point scale: 5 for reports, 0 for alerts."""
    return df.filter(F.col("threat_score") > threshold)


def threat_scale(levels: DataFrame) -> DataFrame:
    """Levels with one policy line each, in score order; NULL parts give a NULL line."""
    line = F.concat(F.col("score").cast("string"), F.lit(" | "), "description",
                    F.lit(" (Action: "), "action_recommended", F.lit(")"))
    return levels.withColumn("formatted_line", line).orderBy("score")


def time_filter(df: DataFrame, col: str, start: Column, end: Column, month: str | None = None) -> DataFrame:
    """Inclusive range. For a month-partitioned table name its month column in
    `month`, because a range on the time column alone prunes no folder."""
    out = df.filter(F.col(col).between(start, end))
    if month:
        out = out.filter(F.col(month).between(month_key(start), month_key(end)))
    return out


def vt_hit(df: DataFrame, raw: str = "raw_data") -> DataFrame:
    """Reports in which an engine called the resource malicious or suspicious."""
    stats = "$.data.attributes.last_analysis_stats."
    count = [F.get_json_object(raw, stats + k).try_cast("bigint") for k in ("malicious", "suspicious")]
    return df.filter(F.coalesce(count[0] > 0, F.lit(False)) | F.coalesce(count[1] > 0, F.lit(False)))


def abuse_hit(df: DataFrame, raw: str = "raw_data") -> DataFrame:
    return df.filter(F.get_json_object(raw, "$.query_status") == "ok")


def needs_alert(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("is_malicious"), F.lit(False)) | F.coalesce(F.col("score") == 3, F.lit(False)))


def recent_malicious(explorer: DataFrame) -> DataFrame:
    """Table panel of the explorer, newest first."""
    cols = ["timestamp", "source_ip", "fqdn", "request_url", "threat_label", "threat_score"]
    return explorer.select(*cols).orderBy(F.desc("timestamp"), *cols[1:])


def last_malicious_scan(stats: DataFrame) -> DataFrame:
    return stats.select("last_scan").limit(50)


def blocked_queries(dns: DataFrame, blocklist: DataFrame) -> DataFrame:
    return _by_list(dns, blocklist, "left_semi")


def allowed_queries(dns: DataFrame, blocklist: DataFrame) -> DataFrame:
    return _by_list(dns, blocklist, "left_anti")


def _by_list(dns: DataFrame, blocklist: DataFrame, how: str) -> DataFrame:
    keyed = dns.withColumn("_name", F.lower("domain"))
    names = blocklist.select(F.col("domain").alias("_name")).distinct()
    return spread_join(keyed, names, ["_name"], how).drop("_name")


def listed_parents(dns: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Rows with `listed`: the shortest listed domain that the queried name is or lies below, NULL if none.

    A distinct name is joined as itself and as each of its parents, label by label; a name
    has 127 labels at most. A final dot and upper case make no difference.
    """
    name = F.regexp_replace(F.lower("domain"), r"\.$", "")
    keyed = dns.withColumn("_name", name)
    labels = F.split("_name", r"\.")
    parent = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = keyed.select("_name").distinct().filter("_name <> ''").select("_name", F.explode(parent).alias("parent"))
    names = blocklist.select(F.col("domain").alias("parent")).distinct()
    hits = spread_join(parents, names, ["parent"])
    shortest = hits.groupBy("_name").agg(F.min(F.struct(F.char_length("parent").alias("n"), "parent"))["parent"].alias("listed"))
    return spread_join(keyed, shortest, ["_name"], "left").drop("_name")


def blocked_below(dns: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Queries of listed domains and of all names below them, with the listed domain."""
    return listed_parents(dns, blocklist).filter("listed is not null")


def allowed_outside(dns: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Queries of names that are not listed and lie below no listed domain."""
    return listed_parents(dns, blocklist).filter("listed is null").drop("listed")


def whole_hours(df: DataFrame, col: str, start: Column, end: Column) -> DataFrame:
    """Rows of all hours that the range touches.

    Unlike the range itself this may be applied before hours are summed up: no hour is
    cut, and the bounds reach the scan.
    """
    first = F.date_trunc("hour", start).cast("timestamp_ntz")
    after = F.date_trunc("hour", end).cast("timestamp_ntz") + F.expr("interval 1 hour")
    return df.filter((F.col(col) >= first) & (F.col(col) < after))
