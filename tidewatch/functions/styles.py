"""Severity styling and panel thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Highest score of the band, accent colour, header word, badge.
SEVERITY_BANDS = [
    (2, "#4caf50", "✅ INFO", "Clean / Monitor"),
    (3, "#ff9800", "⚠️ REVIEW", "Suspicious"),
    (None, "#f44336", "🚨 ALERT", "Malicious / Critical"),
]


def _band(score: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (top, *_), value in reversed(list(zip(SEVERITY_BANDS[:-1], values[:-1]))):
        out = F.when(score <= top, F.lit(value)).otherwise(out)
    return out


def pick_severity(df: DataFrame, score: str = "score", product: str = "DNS watch") -> DataFrame:
    """Adds accent, header_text and badge; `product` is the name behind the header word."""
    accents, words, badges = ([band[i] for band in SEVERITY_BANDS] for i in (1, 2, 3))
    return df.withColumns({
        "accent": _band(F.col(score), accents),
        "header_text": F.concat(_band(F.col(score), words), F.lit(f": {product}")),
        "badge": _band(F.col(score), badges),
    })


def threshold_color(col: Column, limit: float = 80) -> Column:
    return F.when(col >= limit, "red").otherwise("green")
