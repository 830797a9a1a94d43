"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

Each text is measured; the measures of a language and source are summed up in
mergeable quantile sketches (KLL). Sketches of one group meet in two steps, the first
dealt over `PARTS` tasks, so that a group over all of a table's tasks is never merged
by one of them; languages and the whole merge the sketches of their sources. A text
outside the fences of its group is rejected. Fences are Tukey's: a quartile plus `spread` times the
interquartile range, and a margin for measures that hardly vary in their group.
The quartiles of a group of n texts weigh n / (n + `inertia`) against those of its
language, and the language's in the same way against those of all texts, so thresholds
move smoothly as a source grows and no size changes the rule.

Only built-in functions. Defined cases: NULL text has no words and fails; NULL
language or source is a group of its own; repeated rows are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once
from tidewatch.llm.texts import NOT_SPACE, space_words, with_window_hashes
from tidewatch.session import stored

MEASURES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate"]
#: Added to the fence of each measure.
MARGINS = {"word_length": 1.0, "symbol_rate": 0.1, "dup_line_rate": 0.4, "repeat_rate": 0.3}
SPREAD = 3.0
INERTIA = 200
#: Size of a sketch: exact up to so many texts, then within about 1/1,500 in rank.
SKETCH = 8192
PARTS = 64


def _covered(starts: Column, width: int) -> Column:
    """How many positions lie in windows of `width` that begin at the sorted starts."""
    steps = F.transform(starts, lambda s, i: F.least(
        F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
    return F.aggregate(steps, F.lit(0), lambda total, n: total + n)


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`row` (the input columns), the group and the counts and measures of each text.

    n_repeat_words counts the words inside 3-word windows that occur at least twice.
    Most texts repeat no window, as their distinct hashes prove; only the others
    sort them.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    df = docs.select(F.struct(*docs.columns).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                     F.col(text).alias("body"))
    parts = F.struct(
        space_words(F.col("body")).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    df = evaluate_once(df, parts, "parts").select("row", "lang", "source", "parts.*")
    last = F.size("words") - 3
    df = df.select(
        "row", "lang", "source", "words", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    df = with_window_hashes(df, "words", 3, "hashes").drop("words")
    # the highest bits of each hash and its position in one number, so that equal hashes sort side by side
    digits = F.length(F.bin(F.col("n_words"))).cast("int")
    packed = F.sort_array(F.transform("hashes", lambda h, i: F.call_function(
        "shiftleft", F.call_function("shiftright", h, digits), digits).bitwiseOR(i.cast("bigint"))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = evaluate_once(df, F.when(repeats, packed), "packed")
    at = F.transform("packed", lambda p: p.bitwiseAND(F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), digits) - 1).cast("int"))
    df = evaluate_once(df, at, "at").drop("packed")
    hash_at = F.transform("at", lambda p: F.get("hashes", p))
    df = evaluate_once(df, hash_at, "ordered").drop("hashes")
    twice = F.transform("ordered", lambda h, i: F.when(
        (F.get("ordered", i - 1) == h) | (F.get("ordered", i + 1) == h), F.get("at", i)))
    df = evaluate_once(df, F.sort_array(F.array_compact(twice)), "starts").drop("ordered", "at")
    df = df.withColumn("n_repeat_words", F.coalesce(
        F.when(F.col("starts").isNotNull(), _covered(F.col("starts"), 3)), F.lit(0)).cast("long")).drop("starts")
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "word_length": F.col("word_chars") / per_word,
        "symbol_rate": F.col("n_symbols") / per_word,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / per_word,
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }).drop("n_lines")


def _merged(sketches: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """One row per group: `n` and the merged sketch of each measure, first per `part` of a group."""
    def step(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES))

    return step(step(sketches.withColumn("part", part), *keys, "part"), *keys)


def _dealt(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(PARTS))


def quartiles(measures: DataFrame, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`n` and `q`, the quartiles of each measure, per language and source, per language, and of all.

    The rows are sketched once; no texts, no rows.
    """
    parted = measures.filter("n_words > 0").withColumn("part", F.spark_partition_id() % PARTS)
    sketched = parted.groupBy("lang", "source", "part").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(m).cast("double"), sketch).alias(m) for m in MEASURES))
    own = stored(_merged(sketched, ["lang", "source"], F.col("part")), "sketches")
    tongue = stored(_merged(own, ["lang"], _dealt("source")), "language-sketches")
    whole = _merged(tongue.withColumn("all", F.lit(0)), ["all"], _dealt("lang"))
    # one array per measure, so that a sketch is read once
    found = F.struct(*(F.kll_sketch_get_quantile_double(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in MEASURES))
    own, tongue, whole = (t.withColumn("q", found).drop(*MEASURES) for t in (own, tongue, whole))
    return own, tongue, whole


def fences(measures: DataFrame, inertia: int = INERTIA, spread: float = SPREAD, sketch: int = SKETCH,
           margins: dict[str, float] | None = None) -> DataFrame:
    """Lower and upper fence of each measure, per language and source that occurs."""
    margins = margins or MARGINS
    own, tongue, whole = quartiles(measures, sketch)
    own = stored(own, "quartiles")
    tongue = stored(tongue.select(F.col("lang").alias("l2"), F.col("n").alias("n2"), F.col("q").alias("q2")), "quartiles")
    overall = whole.select("q.*").first()  # one row, none of an empty table
    joined = own.join(tongue, F.col("lang").eqNullSafe(F.col("l2")), "left")

    def blended(m: str, i: int) -> Column:
        share, share2 = F.col("n") / (F.col("n") + inertia), F.col("n2") / (F.col("n2") + inertia)
        of_all = F.lit(overall[m][i] if overall else None).cast("double")
        return share * F.col(f"q.{m}")[i] + (1 - share) * (share2 * F.col(f"q2.{m}")[i] + (1 - share2) * of_all)

    bounds = []
    for m in MEASURES:
        low, high = blended(m, 0), blended(m, 1)
        reach = spread * (high - low) + margins[m]
        bounds += [(low - reach).alias(f"{m}_low"), (high + reach).alias(f"{m}_high")]
    return joined.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), *bounds)


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `kept`: passes the base rules and lies inside all fences of its group."""
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    same = F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source"))
    joined = measures.join(limits, same, "left")
    return joined.select(*measures.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass; measured once for the fences and once to filter, so no text is moved."""
    limits = stored(fences(measured(docs)), "limits")
    return judged(measured(docs), limits).filter("kept").select("row.*")
