"""Spelling variants by permuterm rotations.

Each word is marked with a terminator and rotated. The rotation that ends with the letter
to be edited starts with everything else, so words that differ in that letter alone share
this prefix, and the word without the letter is the prefix itself. In the sorted rotations
such words stand together, as one range that skips the edited letter; scanning the range
gives the neighbours of each of its members.

A range holds the words `x?y` for one `x` and `y`, and `xy`: no more members than the
alphabet has letters, and one, however many words there are. Each member passes on how
many neighbours it has there and the most frequent one, never the pairs. A letter out of a
run of equal letters can be left out in several ways, which give one word: only the last
letter of a run links the longer word to the shorter one, so no pair is counted twice.

Defined cases: NULL texts have no words; repeated rows count repeatedly; a NULL id is the
empty text where a document's id is used; words must not hold the terminator U+0000.
Without words the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once, spread_join
from tidewatch.llm.texts import ascii_lower
from tidewatch.session import stored

TERMINATOR = "\u0000"
NO_LETTER = "[^a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word is a variant of a near word that is so many times as frequent.
FACTOR = 5


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and `run`: every maximal run of Latin letters, with A-Z in lower case."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    slim = evaluate_once(slim, ascii_lower(F.col("text")), "lower")
    return slim.select("id", F.explode(F.split("lower", NO_LETTER)).alias("run")).filter("run <> ''")


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """`word` and `n` of the words that are long and frequent enough."""
    long = words.filter(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _rotation(word: Column, keep: Column, skip: Column | int) -> Column:
    """`word` from after its first `keep + skip` letters, the terminator, its first `keep` letters."""
    return F.concat(F.substr(word, keep + skip + F.lit(1)), F.lit(TERMINATOR), F.substr(word, F.lit(1), keep))


def rotations(words: DataFrame) -> DataFrame:
    """`range` (the prefix), `letter` (the one skipped, NULL if none is), `last` of its run, `n`."""
    word, size = F.col("word"), F.char_length("word")

    def skipping(i: Column) -> Column:
        letter = F.substr(word, i + F.lit(1), F.lit(1))
        return F.struct(_rotation(word, i, F.lit(1)).alias("range"), letter.alias("letter"),
                        (F.substr(word, i + F.lit(2), F.lit(1)) != letter).alias("last"))

    def whole(i: Column) -> Column:
        return F.struct(_rotation(word, i, F.lit(0)).alias("range"), F.lit(None).cast("string").alias("letter"),
                        F.lit(True).alias("last"))

    marks = F.concat(F.transform(F.sequence(F.lit(0), size - 1), skipping),
                     F.transform(F.sequence(F.lit(0), size), whole))
    return words.select("n", F.explode(marks).alias("r")).select("r.range", "r.letter", "r.last", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """`word`, `n_near`, `best` and `best_n` (its most frequent near word, the first of several) of `word`, `n`.

    Words without a near word have no row.
    """
    member = F.struct((-F.col("n")).alias("rank"), F.concat(
        F.substring_index("range", TERMINATOR, -1), F.coalesce("letter", F.lit("")),
        F.substring_index("range", TERMINATOR, 1)).alias("word"), F.col("letter").isNull().alias("whole"), "last")
    ranges = rotations(words).groupBy("range").agg(F.array_sort(F.collect_list(member)).alias("members"))
    ranges = ranges.filter(F.size("members") > 1).select("members")

    def near(x: Column) -> Column:
        # two words of equal length, or the whole range and a word with the last letter of a run more
        others = F.filter("members", lambda y: (y["word"] != x["word"]) & (
            (~x["whole"] & ~y["whole"]) | ((x["whole"] | y["whole"]) & x["last"] & y["last"])))
        return F.struct(x["word"].alias("word"), F.size(others).cast("bigint").alias("n"),
                        F.get(others, F.lit(0)).alias("best"))

    found = ranges.select(F.explode(F.transform("members", near)).alias("f")).filter("f.n > 0")
    best = F.min(F.struct("f.best.rank", "f.best.word"))
    return found.groupBy("f.word").agg(F.sum("f.n").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.rank")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """`word` and `root`, the end of the chain of forms, for every `word` with a `form`.

    Pointers are doubled: a round replaces each by the pointer of its target. Forms are
    more frequent than their words by a factor, so chains end and are short.
    """
    step = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = spread_join(step, onward, ["root"], "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"),
                                    F.col("next").isNotNull().alias("moved")), "roots")
        step = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return step


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of every word of `word`, `n`.

    The form is the most frequent word one inserted, deleted or replaced letter away, if it
    is `factor` times as frequent; the root is reached by following forms.
    """
    words = stored(words.select("word", "n"), "words")
    near = stored(neighbours(words), "near")
    found = words.join(near, "word", "left")
    is_form = F.col("best_n") >= F.col("n") * factor
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = stored(found, "variants")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
