"""The registered queries of this package and their SQL, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (alignment, decontaminate, density, language, licenses, oracles, packing, pii, quality, sharding,
                           simhash, spelling, tokens, warc)
from tidewatch.session import scratch_path, stored

SHARDS = 16
#: Of so many runs of letters of a document, one is misspelled.
MISSPELLED = 199


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.struct("doc_id", F.coalesce(language.fold(F.col("doc_id")) == 0, F.lit(False))
                                           .alias("held_out")).alias("key"))
    model = language.fit(docs.filter(language.fold(F.col("doc_id")) != 0), key="doc_id")
    return language.predict(docs, model, "key").select("id.doc_id", "id.held_out", "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id",
        "offset")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a source's folders, with every 20th document as a licence file."""
    folder = F.concat_ws("/", F.lit(""), "source", (F.col("doc_id") % 8).cast("string"))
    path = F.when(F.col("doc_id") % 20 == 0, F.concat(folder, F.lit("/LICENSE"))).otherwise(
        F.concat_ws("/", folder, (F.col("doc_id") % 3).cast("string"), F.concat("doc_id", F.lit(".txt"))))
    files = _table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licenses.scan(files).select("row.doc_id", "row.path", "own_license", "own_score", "license", "via")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_at").cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_by_section(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.planned(_table(spark, sf_dir, "pages")), path)
    found = warc.read_archives(spark, path, with_payload=False)
    return found.select(
        warc.page_of(F.col("record_id")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).cast("bigint").alias("refers_to"), "error")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measures = quality.measured(docs).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    measures = stored(measures, "measures")
    found = quality.judged(measures, quality.fences(measures))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, of which a fixed share loses a letter."""
    runs = spelling.letter_runs(_table(spark, sf_dir, "documents"))
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")
    drawn = runs.select("run", F.crc32(F.encode(name, "utf-8")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("bigint")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + F.lit(2)))
    words = drawn.select(F.when(F.col("h") % MISSPELLED == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.word_counts(words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_simhash": op2_simhash,
    "op3_personal_data": op3_personal_data,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_main_text": op11_main_text,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

SQL = oracles.SQL
