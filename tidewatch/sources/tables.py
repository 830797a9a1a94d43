"""Relational tables for the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Table `name` stored as parquet under `path`; month folders become text column `ym`."""
    return with_text_month(spark.read.parquet(f"{path.rstrip('/')}/{name}"))


def with_text_month(df: DataFrame) -> DataFrame:
    """Folder names are read back as numbers; months are compared as text everywhere."""
    return df.withColumn("ym", F.col("ym").cast("string")) if "ym" in df.columns else df


def read_jdbc_table(spark: SparkSession, name: str, url: str, properties: dict[str, str],
                    column: str, bounds: tuple[int, int], tasks: int) -> DataFrame:
    """The same table from a live database, read in `tasks` ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=bounds[0], upperBound=bounds[1],
                           numPartitions=tasks, properties=properties)
