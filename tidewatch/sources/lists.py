"""Dictionary seeds and blocklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Host names that hosts-format lists carry for the machine itself.
LOCAL_NAMES = ["localhost", "localhost.localdomain", "local", "broadcasthost", "0.0.0.0"]


def seed_dictionary(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`existing` plus those rows whose key it does not hold yet."""
    # of rows with one new key, the smallest counts
    first = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    fresh = first.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def blocklist_sources(lines: DataFrame) -> DataFrame:
    """Distinct list addresses from text lines, trimmed, blanks skipped, all enabled."""
    address = F.trim("value", F.lit(" \t\r\n")).alias("address")
    return (lines.select(address).filter(F.col("address") != "")
            .dropDuplicates().withColumn("enabled", F.lit(1)))


def load_blocklist_sources(spark: SparkSession, path: str) -> DataFrame:
    return blocklist_sources(spark.read.text(path))


# Fixed pattern: a domain of two labels at least, in lower case.
DOMAIN_PATTERN = (r"^(?=.{1,253}$)([a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")


def list_entries(lines: DataFrame) -> DataFrame:
    """`entry` (as written, in lower case) and `domain` of every entry of downloaded lists; NULL if it names none.

    Understands plain domains, hosts lines (`0.0.0.0 name ...`), wildcards (`*.name`), filter
    rules of a whole domain (`||name^`, with options after `$`) and names with a final dot; all of
    them mean the domain. Comments (`#`, `!`), headers (`[...]`) and blanks are no entries.
    """
    line = F.trim("value", F.lit(" \t\r\n"))
    text = F.trim(F.regexp_replace(line, r"(^|\s)#.*", ""), F.lit(" \t\r\n"))
    words = F.split(F.lower(text), r"[ \t]+")
    names = F.when(F.size(words) > 1, F.slice(words, 2, F.size(words))).otherwise(words)
    kept = lines.filter((text != "") & ~line.rlike(r"^[!\[]"))
    entries = kept.select(F.explode(names).alias("entry"))
    ruled = F.regexp_extract("entry", r"^\|\|([^/^$|]+)\^(\$.*)?$", 1)
    plain = F.when(ruled != "", ruled).otherwise(F.col("entry"))
    name = F.regexp_replace(F.regexp_replace(plain, r"^(\*\.|\.)", ""), r"\.$", "")
    good = name.rlike(DOMAIN_PATTERN) & ~name.rlike(r"^[0-9.]+$") & ~name.isin(LOCAL_NAMES)
    return entries.select("entry", F.when(good, name).alias("domain"))


def compile_blocklist(lines: DataFrame) -> DataFrame:
    """Distinct lower-case domains of downloaded lists; the machine's own names and junk are left out."""
    return list_entries(lines).select("domain").filter("domain is not null").dropDuplicates()


def list_junk(lines: DataFrame) -> DataFrame:
    """Entries that name no domain, with how often each occurs."""
    return list_entries(lines).filter("domain is null").groupBy("entry").agg(F.count("*").alias("times"))
