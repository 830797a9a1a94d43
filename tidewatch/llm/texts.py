"""Text helpers shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def space_words(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` does the same, faster, on pure ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def with_window_hashes(df: DataFrame, words: str, k: int, name: str) -> DataFrame:
    """Adds a 64-bit hash of every run of `k` words, in order; empty if there are fewer words.

    Each word is hashed once; hashes of runs of 2, 4, 8, … words come from pairs of
    shorter runs, and `k` from its binary digits. A slice per window would copy the
    whole text each time.
    """
    columns = df.columns
    runs, width, digits = {1: f"{name}_1"}, 1, k
    df = evaluate_once(df, F.transform(words, lambda w: F.xxhash64(w)), runs[1])

    def joined(a: str, at: int, b: str) -> Column:
        rest = F.slice(b, at + 1, F.greatest(F.size(b) - at, F.lit(0)))
        return F.zip_with(F.col(a), rest, lambda x, y: F.xxhash64(x, y))

    while 2 * width <= k:
        runs[2 * width] = f"{name}_{2 * width}"
        df = evaluate_once(df, joined(runs[width], width, runs[width]), runs[2 * width])
        width *= 2
    done, whole = width, runs[width]
    while (digits := k - done) > 0:
        width = 1 << (digits.bit_length() - 1)
        df = evaluate_once(df, joined(whole, done, runs[width]), f"{name}_to_{done + width}")
        done, whole = done + width, f"{name}_to_{done + width}"
    # beyond the last full run, shorter ones were padded
    return df.select(*columns, F.slice(whole, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))).alias(name))
