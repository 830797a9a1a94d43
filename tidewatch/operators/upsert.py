"""Merging new rows into a stored table, by copy on write of the folders they touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewatch.functions.times import month_key
from tidewatch.sources.tables import with_text_month

#: Key ranges of a month. They are part of the table's layout and must not change.
BUCKETS = 16
#: Rows of a folder per task; a larger folder is shared by tasks that have keys of their own.
ROWS = 1_000_000
#: New rows per key of a folder from which repeated keys are merged before the rows meet the stored ones.
REPEATED = 1.5


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], ts: str, batch_id: int,
           count: str = "scan_count", buckets: int = BUCKETS) -> int:
    """Merges rows into the table at `path`; returns how many folders were written.

    A key that is not stored becomes a row; one that is keeps its row, and the number in
    `count` is added to it. Of several new rows of one key the smallest stays, with the sum
    of their counts. Each row notes the newest batch that reached it, and a batch adds
    nothing to a row that has seen it or a later one. Batches come in order, so one that
    runs again, after whatever failure, completes what is missing and changes nothing else.

    The table lies in folders of month and key range. Only folders with rows to add are read
    and written; the others keep their files. Which these are is found from the keys alone.
    Then each row moves once: new and stored rows are dealt out by folder, merged by key and
    written where they are. Spark replaces the folders when all tasks have ended, so none is
    replaced while it is read. `new` is read up to three times and must give the same rows each
    time. The time is one of the keys, and keys should not be NULL (`operators.constraints`
    keeps such rows out); a NULL is a value like any other here.
    """
    if ts not in keys:
        raise ValueError("the time must be one of the keys, as it names the folder")
    key_hash = F.xxhash64(*keys)
    place = {"ym": month_key(F.col(ts)), "key_range": F.pmod(key_hash, F.lit(buckets)).cast("int")}
    columns, by = new.columns, ["ym", "key_range"]
    rest = [c for c in columns if c not in (*keys, count)]
    placed = new.withColumns(place)
    added = {tuple(r[:2]): r for r in placed.groupBy(*by).agg(
        F.count("*").alias("rows"), F.approx_count_distinct(key_hash).alias("keys")).collect()}  # months times key ranges
    old, held = _stored(spark, path), {}
    if old is not None and added:
        held = {tuple(r[:2]): r for r in old.filter(_lies_in(set(added))).groupBy(*by).agg(
            F.count("*").alias("rows"), F.max("last_batch").alias("newest")).collect()}
    late = {f for f, r in held.items() if r.newest >= batch_id}
    folders = set(added) - late
    if late:
        folders |= _incomplete(placed, old, keys, place, batch_id, late)
    if not folders:
        return 0

    fresh, many = placed.filter(_lies_in(folders)), {f for f in folders if added[f].rows > REPEATED * added[f]["keys"]}
    if many:
        merged = fresh.filter(_lies_in(many)).groupBy(*keys).agg(
            F.min(F.struct(*rest)).alias("r"), F.sum(count).cast(new.schema[count].dataType).alias(count))
        merged = merged.select(*keys, count, "r.*")
        fresh = merged.unionByName(fresh.filter(_lies_in(folders - many)).select(*columns))
    rows = fresh.select(*columns, F.lit(None).cast("bigint").alias("last_batch"))
    if old is not None:
        rows = rows.unionAll(old.filter(_lies_in(folders)).select(*columns, "last_batch"))
    # rows of a folder go to one task, or of a large one to several by key, where they are merged and written
    tasks: dict[int, set] = {}
    for f in folders:
        size = added[f].rows + (held[f].rows if f in held else 0)
        tasks.setdefault(1 << (size // ROWS).bit_length(), set()).add(f)
    share = F.lit(0)
    for n in sorted(set(tasks) - {1}):
        share = F.when(_lies_in(tasks[n]), F.pmod(F.shiftright(key_hash, 32), F.lit(n))).otherwise(share)
    dealt = rows.withColumns(place).withColumn("_cell", F.xxhash64(*by, share)).drop(*by).repartition("_cell")
    is_new = F.col("last_batch").isNull()
    found = dealt.groupBy("_cell", *keys).agg(
        F.min(F.when(~is_new, F.struct(*rest, count, "last_batch"))).alias("s"),
        F.min(F.when(is_new, F.struct(*rest))).alias("n"), F.sum(F.when(is_new, F.col(count))).alias("_more"))
    kept, adds = F.col("s").isNotNull(), F.col("n").isNotNull() & F.coalesce(F.col("s.last_batch") < batch_id, F.lit(True))
    total = F.when(~kept, F.col("_more")).when(adds, F.col(f"s.{count}") + F.coalesce("_more", F.lit(0))).otherwise(F.col(f"s.{count}"))
    whole = found.select(*keys, *[F.when(kept, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in rest],
                         total.cast(new.schema[count].dataType).alias(count),
                         F.when(adds, batch_id).otherwise(F.col("s.last_batch")).cast("bigint").alias("last_batch"))
    (whole.select(*columns, "last_batch").withColumns(place).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
    return len(folders)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the table; None if nothing is stored."""
    try:
        return with_text_month(spark.read.parquet(path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _lies_in(folders: set[tuple[str | None, int]]) -> Column:
    """Whether a row is in one of the folders; of a stored table the literals prune the others."""
    of_month: dict[str | None, list[int]] = {}
    for month, key_range in folders:
        of_month.setdefault(month, []).append(key_range)
    alike: dict[tuple[int, ...], list[str | None]] = {}  # months that share their key ranges are one test
    for month, ranges in of_month.items():
        alike.setdefault(tuple(sorted(ranges)), []).append(month)
    tests = [F.lit(False)]
    for ranges, months in alike.items():
        in_month = F.col("ym").isin(sorted(m for m in months if m is not None))
        in_month = in_month | F.col("ym").isNull() if None in months else in_month
        tests.append(in_month & F.col("key_range").isin(list(ranges)))
    return reduce(Column.__or__, tests)


def _incomplete(placed: DataFrame, old: DataFrame, keys: list[str], place: dict[str, Column], batch_id: int,
                folders: set[tuple[str | None, int]]) -> set[tuple[str | None, int]]:
    """Those of the folders in which a key of the batch is new or has seen neither it nor a later one."""
    seen = old.filter(_lies_in(folders) & (F.col("last_batch") >= batch_id)).select(*keys, F.lit(True).alias("seen"))
    asked = placed.filter(_lies_in(folders)).select(*keys, F.lit(False).alias("seen"))
    unseen = asked.unionAll(seen).groupBy(*keys).agg(F.max("seen").alias("seen")).filter("not seen")
    return {tuple(r) for r in unseen.withColumns(place).select(*place).distinct().collect()}


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an upserted table, with its month as text and without the columns of its bookkeeping."""
    return with_text_month(spark.read.parquet(path)).drop("key_range", "last_batch")
