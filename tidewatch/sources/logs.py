"""Resolver log: reading, parsing, and storing DNS rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once
from tidewatch.functions.times import month_key, to_whole_seconds
from tidewatch.schemas import DNS_LENGTHS, DNS_REQUIRED
from tidewatch.sources.tables import with_text_month

# Fixed pattern: the part of a log line that names an action, a domain and a value.
LINE_PATTERN = r"(query|reply)(?:\[([A-Z0-9]+)\])?\s+(\S+)\s+(?:is|from)\s+(\S+)"


#: Equal lines of one file that one task writes out; more are shared among tasks.
RUN = 10_000


def identified(lines: DataFrame, source: Column) -> DataFrame:
    """The lines as `value` with `id`, the key of the DNS row: a SHA-256 of file, line and occurrence.

    Equal lines of one file are events of their own, so they are numbered. As nothing tells
    them apart, counting them is enough: a line and its count give all its rows, and the ids
    are the same on every replay of the file. Counts are summed where the lines are read; the
    rows of a line that is repeated very often are written out by many tasks.
    """
    counted = lines.select(source.alias("_source"), "value").groupBy("_source", "value").agg(F.count("*").alias("_n"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {RUN}"))))
    # one run of a line stays where it is, further ones are dealt out
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = runs.filter(f"_n > {RUN}").repartition(tasks, "_source", "value", "_run")
    runs = runs.filter(f"_n <= {RUN}").unionAll(often)
    first = F.col("_run") * RUN + 1
    rows = runs.withColumn("_k", F.explode(F.sequence(first, F.least(F.col("_n"), first + (RUN - 1)))))
    name = F.concat_ws("\n", "_source", "value", F.col("_k").cast("string"))
    return rows.select("value", F.sha2(name, 256).alias("id"))


def raw_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Log lines as `value` with the name of their `file`. The log must be rotated into the folder `path`."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    return lines.select("value", F.col("_metadata.file_name").alias("file"))


def read_dns_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as `value` with their `id`."""
    return identified(raw_log(spark, path), F.col("file"))


def parse_dns_lines(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed DNS rows from `value`, with `id` if the lines have one; lines of any other form are dropped.

    The pattern runs once for the whole match, which holds exactly four
    blank-separated words; the fields are cut from those.
    """
    now = F.current_timestamp() if now is None else now
    matched = evaluate_once(lines, F.regexp_extract("value", LINE_PATTERN, 0), "match")
    kept = [c for c in ("id",) if c in lines.columns]
    found = matched.filter("match <> ''").select(*kept, F.split("match", r"\s+").alias("w"))
    head, value = F.col("w")[0], F.col("w")[3]
    action = F.substring_index(head, "[", 1)
    named = F.when(head.contains("["), F.rtrim(F.substring_index(head, "[", -1), F.lit("]")))
    inferred = (
        F.when(value == "NXDOMAIN", "N/A")
        .when(value.contains(".") & ~value.contains(":") & ~value.isin("<CNAME>", "NODATA"), "A")
        .when(value.contains(":"), "AAAA")
        .otherwise("OTHER"))
    return found.select(
        *kept,
        now.cast("timestamp_ntz").alias("timestamp"),
        action.alias("query_type"),
        F.coalesce(named, inferred).alias("record_type"),
        F.col("w")[1].alias("domain"),
        F.when(action == "query", value).otherwise("N/A").alias("source_ip"),
        F.when(action == "reply", value).alias("response_ip"))


def fits_table() -> Column:
    """True if a DNS row respects the column lengths and has no missing required value."""
    lengths = [F.coalesce(F.char_length(c) <= n, F.lit(True)) for c, n in DNS_LENGTHS.items()]
    present = [F.col(c).isNotNull() for c in DNS_REQUIRED]
    return reduce(lambda a, b: a & b, lengths + present)


def write_dns(df: DataFrame, path: str, mode: str = "append", extra_partitions: list[str] | None = None) -> None:
    """Store rows under `row_status=accepted` or `row_status=rejected`, by month.

    Times are kept in whole seconds and domains in lower case, so that later
    comparisons ignore case without a collation. One pass over the input serves both tables. The rebalance hint gathers each
    month into files of a good size and splits a month that is too big for one task.
    """
    parts = ["row_status", "ym", *(extra_partitions or [])]
    df = df.withColumns({"timestamp": to_whole_seconds(F.col("timestamp")), "domain": F.lower("domain")})
    out = df.withColumns({
        "row_status": F.when(fits_table(), "accepted").otherwise("rejected"),
        "ym": F.coalesce(month_key(F.col("timestamp")), F.lit("unknown"))})
    writer = out.hint("rebalance", *parts).write.mode(mode)
    # Overwriting replaces only the folders that these rows belong to.
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_dns(spark: SparkSession, path: str, status: str = "accepted") -> DataFrame:
    """Rows that `write_dns` accepted, or the rejected ones."""
    return with_text_month(spark.read.parquet(path).filter(F.col("row_status") == status).drop("row_status"))
