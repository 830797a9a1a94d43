"""Archive of raw provider documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_raw_reports(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append documents, one folder per provider; a large provider is split over tasks."""
    (df.hint("rebalance", "source_provider").write.mode(mode)
       .partitionBy("source_provider").parquet(path))


def raw_by_provider(df: DataFrame, provider: str) -> DataFrame:
    """Documents of one provider; prunes to its folder on a stored archive."""
    return df.filter(F.col("source_provider") == provider)


def _newest(cols: list[str], when: Column | None = None) -> Column:
    row, order = F.struct(*cols), F.struct("scan_date", "doc_id")
    if when is not None:
        row, order = F.when(when, row), F.when(when, order)
    return F.max_by(row, order)


def latest_raw(df: DataFrame, keys: tuple[str, ...] = ("resource",)) -> DataFrame:
    """Newest document per key, the higher doc_id on a tie.

    An aggregate rather than a ranking: each map task sends one document per
    key, so a resource with very many documents does not gather in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(_newest(rest).alias("d"))
    return latest.select(*keys, *[F.col("d")[c].alias(c) for c in rest])


def latest_by_provider(df: DataFrame, providers: dict[str, str]) -> DataFrame:
    """One row per resource with the newest document of each provider.

    `providers` maps an output prefix to a provider name and yields the columns
    `<prefix>_raw` and `<prefix>_doc_id`. All providers share one shuffle.
    """
    aggs = [_newest(["raw_data", "doc_id"], F.col("source_provider") == name).alias(prefix)
            for prefix, name in providers.items()]
    wide = (df.filter(F.col("source_provider").isin(list(providers.values())))
              .groupBy("resource").agg(*aggs))
    return wide.select("resource", *[
        F.col(p)[field].alias(f"{p}_{out}")
        for p in providers for field, out in (("raw_data", "raw"), ("doc_id", "doc_id"))])


def newest_payloads(df: DataFrame, provider: str, wanted: DataFrame) -> DataFrame:
    """resource, doc_id and raw_data of one provider's newest document of each wanted resource.

    `wanted` has distinct `resource`. The provider's folder is read without payloads,
    cut down to the wanted resources and reduced to one document id each; payloads are
    read in a second pass and, where the ids are few, stay out of any shuffle.
    """
    docs = raw_by_provider(df, provider)
    newest = (docs.select("resource", "scan_date", "doc_id").join(wanted, "resource", "left_semi")
              .groupBy("resource").agg(F.max(F.struct("scan_date", "doc_id"))["doc_id"].alias("doc_id")))
    return docs.select("resource", "doc_id", "raw_data").join(newest, ["resource", "doc_id"])


def dedupe_payloads(df: DataFrame) -> DataFrame:
    """One document per distinct payload: the oldest, then the lower doc_id."""
    cols = df.columns
    hashed = df.withColumn("raw_response_hash", F.sha2("raw_data", 256))
    kept = hashed.groupBy("raw_response_hash").agg(
        F.min_by(F.struct(*cols), F.struct("scan_date", "doc_id")).alias("d"),
        F.count("*").alias("copies"))
    return kept.select("raw_response_hash", "copies", "d.*")
