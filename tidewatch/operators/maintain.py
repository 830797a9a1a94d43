"""Month-partitioned tables: layout, retention, look-ahead, inventory and log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import month_key
from tidewatch.schemas import MAINTENANCE_LOG

RETENTION_MONTHS = 6
LOOKAHEAD_MONTHS = 3
CATCH_ALL = "p_future"


def with_month(df: DataFrame, ts_col: str) -> DataFrame:
    return df.withColumn("ym", month_key(F.col(ts_col)))


def write_partitioned(df: DataFrame, ts_col: str, path: str, mode: str = "append") -> None:
    """Store by month. The rebalance hint writes a month in files of a good size
    and splits a large month over tasks, where a repartition by month would not."""
    with_month(df, ts_col).hint("rebalance", "ym").write.mode(mode).partitionBy("ym").parquet(path)


def partition_of(ts: Column, first: str, last: str) -> Column:
    """Name of the range partition that holds a time, given the first and last month.

    The first partition has no lower bound; later months go to the catch-all.
    """
    month = month_key(ts)
    return (F.when(month > last, CATCH_ALL)
            .when(month < first, f"p{first}")
            .otherwise(F.concat(F.lit("p"), month)))


def cutoff_month(now: Column, months: int = RETENTION_MONTHS) -> Column:
    """First month that is kept; a month end is clamped as in calendar arithmetic."""
    return month_key(F.add_months(F.to_date(now), -months))


def retained(df: DataFrame, ts_col: str, now: Column, months: int = RETENTION_MONTHS) -> DataFrame:
    """Rows of the months that retention keeps.

    The raw time is compared with the first day of the oldest month kept, so that the
    bound reaches the files' statistics; month folders are pruned where `ym` exists.
    """
    first = F.trunc(F.add_months(F.to_date(now), -months), "month").cast("timestamp_ntz")
    kept = df.filter(F.col(ts_col) >= first)
    return kept.filter(F.col("ym") >= cutoff_month(now, months)) if "ym" in df.columns else kept


def expired_partitions(partitions: DataFrame, now: Column, months: int = RETENTION_MONTHS) -> DataFrame:
    """Partitions below the cutoff; names that are not `pYYYYMM` are never chosen."""
    name = F.col("partition_name")
    return partitions.filter(name.rlike("^p[0-9]{6}$") & (F.substring(name, 2, 6) < cutoff_month(now, months)))


def plan_future_partitions(existing: DataFrame, now: Column, months: int = LOOKAHEAD_MONTHS) -> DataFrame:
    """Month partitions to create per table: the next months that do not exist yet.

    `existing` has table_name and partition_name. `upper_bound` is the first day
    after the month.
    """
    first = F.trunc(F.to_date(now), "month")
    ahead = F.sequence(F.add_months(first, 1), F.add_months(first, months), F.expr("interval 1 month"))
    wanted = (existing.select("table_name").distinct()
              .select("table_name", F.explode(ahead).alias("month_start"))
              .select("table_name", F.concat(F.lit("p"), month_key(F.col("month_start"))).alias("partition_name"),
                      F.add_months("month_start", 1).alias("upper_bound")))
    return wanted.join(existing, ["table_name", "partition_name"], "left_anti")


def log_maintenance(rows: DataFrame, path: str) -> None:
    rows.select(*MAINTENANCE_LOG.names).write.mode("append").parquet(path)


def recent_maintenance(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("executed_at"), "table_name", "partition_name", "action").limit(n)


def _run_ddl(spark: SparkSession, jobs: list[tuple[str, str, str]], action: str, now: datetime) -> DataFrame:
    """Run one statement per partition; a failure is logged and the next one runs."""
    rows = []
    for table, partition, statement in jobs:
        try:
            spark.sql(statement)
            rows.append((table, partition, action, None, now))
        except Exception as error:  # noqa: BLE001 - any failed statement is an outcome to log
            rows.append((table, partition, f"{action}_FAILED", str(error).splitlines()[0], now))
    return spark.createDataFrame(rows, MAINTENANCE_LOG)


def _partitions(spark: SparkSession, table: str) -> list[dict[str, str]]:
    """The partitions of a catalog table, each as level name to value."""
    rows = spark.sql(f"SHOW PARTITIONS {table}").collect()
    return [dict(level.split("=", 1) for level in row.partition.split("/")) for row in rows]


def _spec(levels: dict[str, str]) -> str:
    return ", ".join(f"{name} = '{value}'" for name, value in levels.items())


def _is_month(value: str | None) -> bool:
    return bool(value) and len(value) == 6 and value.isdigit()


def drop_old_partitions(spark: SparkSession, tables: list[str], now: datetime,
                        months: int = RETENTION_MONTHS) -> DataFrame:
    """Drop every expired month of catalog tables that have a level `ym`; returns log rows.

    Other levels, such as the row status of the DNS table, may stand beside it. Works
    on partition names only, a handful per table and year once months are compacted.
    """
    cutoff = spark.range(1).select(cutoff_month(F.lit(now), months)).first()[0]
    jobs = [(t, f"p{p['ym']}", f"ALTER TABLE {t} DROP IF EXISTS PARTITION ({_spec(p)})")
            for t in tables for p in _partitions(spark, t) if _is_month(p.get("ym")) and p["ym"] < cutoff]
    return _run_ddl(spark, jobs, "DROP", now)


def add_future_partitions(spark: SparkSession, tables: list[str], now: datetime,
                          months: int = LOOKAHEAD_MONTHS) -> DataFrame:
    """Create the next months of catalog tables where they are missing; returns log rows.

    Where further levels stand beside `ym`, a month is created for each of their
    values that occurs, such as accepted and rejected rows.
    """
    beside, existing = {}, []
    for table in tables:
        found = _partitions(spark, table)
        beside[table] = {tuple((k, v) for k, v in p.items() if k != "ym"): list(p) for p in found} or {(): ["ym"]}
        have: dict[str, set] = {}
        for p in found:
            have.setdefault(p.get("ym"), set()).add(tuple((k, v) for k, v in p.items() if k != "ym"))
        # a month counts as existing if every combination of the other levels has it
        existing += [(table, f"p{m}") for m, others in have.items() if _is_month(m) and len(others) == len(beside[table])]
        existing.append((table, "p000000"))
    plan = plan_future_partitions(
        spark.createDataFrame(existing, "table_name string, partition_name string"), F.lit(now), months)
    jobs = []
    for r in plan.orderBy("table_name", "partition_name").collect():
        for others, order in beside[r.table_name].items():
            levels = {**dict(others), "ym": r.partition_name[1:]}
            spec = _spec({name: levels[name] for name in order})
            jobs.append((r.table_name, r.partition_name,
                         f"ALTER TABLE {r.table_name} ADD IF NOT EXISTS PARTITION ({spec})"))
    return _run_ddl(spark, jobs, "ADD", now)


def partition_info(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows and size of each month folder of stored tables (name to path), in name order.

    Reads no column: a scan without columns takes its counts from the files' footers.
    There are no indexes, so the total is the data size. `upper_bound` is the first day
    after the month, `update_time` the newest file's.
    """
    out = None
    for name, path in tables.items():
        files = (spark.read.parquet(path)
                 .groupBy("ym", F.col("_metadata.file_path").alias("f"))
                 .agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("b"),
                      F.max("_metadata.file_modification_time").alias("t")))
        info = files.groupBy(F.lit(name).alias("table_name"), F.concat(F.lit("p"), "ym").alias("partition_name")).agg(
            F.sum("n").alias("table_rows"), F.round(F.sum("b") / 1048576, 2).alias("data_mb"),
            F.max("t").alias("update_time"))
        month = F.try_to_timestamp(F.concat(F.substring("partition_name", 2, 6), F.lit("01")), F.lit("yyyyMMdd"))
        info = info.withColumns({"partition_expression": F.lit("ym"),
                                 "upper_bound": F.add_months(month.cast("date"), 1)})
        info = info.withColumn("total_mb", F.col("data_mb"))
        out = info if out is None else out.unionAll(info)
    return out.orderBy("table_name", "partition_name")


def partition_counts(info: DataFrame) -> DataFrame:
    return info.groupBy("table_name").agg(F.count("*").alias("partitions"))


def partition_sample(info: DataFrame, n: int = 10) -> DataFrame:
    return info.orderBy("table_name", "partition_name").limit(n)
