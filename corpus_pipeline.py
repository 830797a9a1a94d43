"""A training corpus from `documents`: five stages, each over all that the one before kept.

Quality rules drop bad texts, near-duplicates keep one text of each group, texts with
a benchmark passage go, personal data is masked, and what is left is packed. Every
stage is written as Parquet and read again, so a lost executor repeats one stage only.

Defined cases, the same in every stage: an empty table gives an empty one; columns beside
those of `documents` are left behind, whatever their names; NULL ids are rows like any other.
Each stage states what it does with NULL, empty and repeated texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, packing, pii, quality, simhash
from tidewatch.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base rules or lie outside the fences of their language and source.

    NULL and empty texts have no words and are rejected; a NULL language or source is a group of
    its own; equal rows get equal verdicts.
    """
    return quality.keep_good(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of fingerprints at most 3 bits apart.

    Of repeated rows one stays; NULL ids come after all others; NULL and empty texts share the
    fingerprint zero, so one of them stays.
    """
    return simhash.one_of_each(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item.

    NULL and empty texts hold none and stay, as does everything if the benchmark is empty;
    repeated rows stay or go together.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data, plain and disguised, and counts the characters anew.

    All rows stay, repeated ones too; a NULL text stays NULL, with a NULL count.
    """
    masked = pii.mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens.

    A NULL text is empty, and an empty text its end mark alone; only longer texts than a sequence
    are cut; repeated rows are packed one by one.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", best_fit),
]

#: Components of near copies and a tokenizer cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
