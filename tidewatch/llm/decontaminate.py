"""Benchmark decontamination: windows of training tokens against a hash set of test n-grams.

The windows of all test items are hashed, de-duplicated and stored; their true size
lets Spark broadcast the set where it is small and shuffle by hash where it is not.
Documents are scanned in place: all window hashes of a text are exploded and probed
in one stage, a hit is verified word by word, and only hits are grouped.

Only built-in functions. Defined cases: NULL texts have no words; an item of fewer
than `n` words is one window of its own length; an item without words is ignored;
rows with equal id and text share one verdict, rows with equal id and other text do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once
from tidewatch.llm.texts import ascii_lower, with_window_hashes
from tidewatch.session import stored

#: Everything that is no digit, no letter and ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def test_items(benchmark: DataFrame, n: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """`item`, its words `w` and its window length `k`."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    return items.filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(n)))


def test_windows(items: DataFrame, k: int) -> DataFrame:
    """Distinct windows of length `k`: hash, words and the items that hold each."""
    hashed = with_window_hashes(items.filter(F.col("k") == k), "w", k, "hashes")
    windows = hashed.select("item", "w", F.posexplode("hashes").alias("at", "h"))
    windows = windows.select("item", "h", F.slice("w", F.col("at") + 1, k).alias("window"))
    return windows.groupBy("h", "window").agg(F.collect_set("item").alias("items"))


def _key(doc: str, text: str) -> list[Column]:
    return [F.col(doc).alias("key_id"), F.xxhash64(F.col(text)).alias("key_text")]


def candidates(docs: DataFrame, windows: dict[int, DataFrame], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with a window hash of the set: its keys and `found`, the positions (from 1) and windows.

    Only positions and hashes are exploded; the words stay behind.
    """
    scanned = evaluate_once(docs.select(*_key(doc, text), F.col(text).alias("text")), words_of(F.col("text")), "w")
    parts = []
    for k, tests in windows.items():
        hashed = with_window_hashes(scanned.filter(F.size("w") >= k).drop("text"), "w", k, "hashes")
        probes = hashed.select("key_id", "key_text", F.posexplode("hashes").alias("at", "h"))
        parts.append(probes.join(tests, "h").select(
            "key_id", "key_text", F.struct((F.col("at") + 1).alias("at"), "window", "items").alias("hit")))
    union = parts[0]
    for more in parts[1:]:
        union = union.unionAll(more)
    return union.groupBy("key_id", "key_text").agg(F.collect_set("hit").alias("found"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`row` (the input columns), `words`, `hit_at` (sorted hit word positions, from 1) and `items`.

    The windows' lengths, at most `n` numbers, are all that the driver reads.
    """
    items = stored(test_items(benchmark, n, item, item_text), "test-items")
    lengths = sorted(r.k for r in items.select("k").distinct().collect())
    windows = {k: stored(test_windows(items, k), "test-windows") for k in lengths}
    # one copy of the text is moved; its words are split again behind the join
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_key(doc, text))
    if windows:
        found = stored(candidates(docs, windows, doc, text), "candidates")
        found = found.select(F.col("key_id").alias("hit_id"), F.col("key_text").alias("hit_text"), "found")
        rows = rows.join(found, F.col("key_id").eqNullSafe(F.col("hit_id"))
                         & (F.col("key_text") == F.col("hit_text")), "left")
    else:
        rows = rows.withColumn("found", F.lit(None).cast("array<struct<at:int,window:array<string>,items:array<string>>>"))
    kind = rows.schema["found"].dataType
    rows = evaluate_once(rows, words_of(F.col(f"row.{text}")), "words")
    equal = F.filter("found", lambda x: F.slice("words", x["at"], F.size(x["window"])) == x["window"])
    rows = evaluate_once(rows.select("row", "words", "found"), F.coalesce(equal, F.array().cast(kind)), "hits")
    covered = F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + F.size(x["window"]) - 1))
    return rows.select(
        "row", "words", F.sort_array(F.array_distinct(F.flatten(covered))).alias("hit_at"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))).alias("items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of a test item, all columns."""
    return find_leaks(docs, benchmark, n, doc, text, item, item_text).filter(F.size("hit_at") == 0).select("row.*")


def cut_words(words: Column, hit_at: Column) -> Column:
    """The normalised words outside all hit spans, as one text: the gentler form of removal."""
    left = F.when(F.size(words) > 0, F.array_except(F.sequence(F.lit(1), F.size(words)), hit_at))
    return F.coalesce(F.array_join(F.transform(left, lambda at: F.get(words, at - 1)), " "), F.lit(""))
