"""Address ranges as a table: the longest prefix that holds an address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.net import address_hex, prefix_of
from tidewatch.functions.shaping import evaluate_once, spread_join


def compile_ranges(ranges: DataFrame, col: str = "range") -> DataFrame:
    """`range`, `length`, `prefix` of every valid range of a table, one row per prefix.

    A range is an address with an optional `/length`; bits below the length are ignored and
    an address alone is a range of itself. Of several spellings of one prefix the smallest
    text counts. NULLs and texts that are no range are left out, see `invalid_ranges`.
    """
    parsed = _parsed(ranges, col).filter("prefix is not null")
    return parsed.groupBy("length", "prefix").agg(F.min("range").alias("range")).select("range", "length", "prefix")


def invalid_ranges(ranges: DataFrame, col: str = "range") -> DataFrame:
    """The texts of a table that are no range."""
    return _parsed(ranges, col).filter("range is not null and prefix is null").select("range")


def _parsed(ranges: DataFrame, col: str) -> DataFrame:
    text = F.trim(F.col(col))
    rows = evaluate_once(ranges.select(F.col(col).alias("range"), text.alias("t")),
                         address_hex(F.substring_index("t", "/", 1)), "hex")
    bits = F.char_length("hex") * 4
    stated = F.regexp_extract("t", "^[^/]*/([0-9]{1,3})$", 1)
    # a mapped range states its length for the long form; one that holds more than IPv4 stays in it
    mapped = F.col("t").contains(":") & (bits == 32) & (stated != "")
    wide = mapped & (stated.cast("int") < 96)
    less = F.when(mapped & ~wide, 96).otherwise(0)
    length = F.when(~F.col("t").contains("/"), bits).when(stated != "", stated.cast("int") - less)
    long_form = F.when(wide, F.concat(F.lit("0" * 20 + "ffff"), "hex")).otherwise(F.col("hex"))
    rows = rows.withColumns({"length": length.cast("int"), "hex": long_form})
    good = F.col("hex").isNotNull() & (F.col("length") >= 0) & (F.col("length") <= bits)
    return rows.select("range", "length", F.when(good, prefix_of(F.col("hex"), F.col("length"))).alias("prefix"))


def longest_range(df: DataFrame, col: str, ranges: DataFrame) -> DataFrame:
    """Rows of `df` with `range` and `prefix_length` of the longest compiled range that holds the address, else NULL.

    Each distinct address is cut to every prefix length in use for its family (there are 162
    at most), and each cut is one key of an equi-join; no range is compared with an address
    it does not hold. The result goes back to the rows by a join that can split a hot address.
    """
    named = df.withColumn("_address", F.col(col))
    addresses = named.select("_address").distinct().filter("_address is not null")
    addresses = evaluate_once(addresses, address_hex(F.col("_address")), "hex").filter("hex is not null")
    # the family is part of a prefix, so lengths of both families can be tried on one text
    in_use = ranges.agg(F.sort_array(F.collect_set("length")).alias("lengths"))
    cut = addresses.withColumn("lengths", in_use.scalar())
    cut = cut.select("_address", "hex", F.explode("lengths").alias("length")).filter(
        F.col("length") <= F.char_length("hex") * 4)
    cut = cut.select("_address", "length", prefix_of(F.col("hex"), F.col("length")).alias("prefix"))
    hits = spread_join(cut, ranges.select("length", "prefix", "range"), ["length", "prefix"])
    best = hits.groupBy("_address").agg(F.max(F.struct("length", "range")).alias("best"))
    found = spread_join(named, best, ["_address"], "left")
    return found.withColumns({"range": F.col("best.range"), "prefix_length": F.col("best.length")}).drop("_address", "best")


def in_ranges(df: DataFrame, col: str, ranges: DataFrame) -> DataFrame:
    """Rows whose address lies in a range of the table."""
    return longest_range(df, col, ranges).filter("range is not null").drop("range", "prefix_length")
