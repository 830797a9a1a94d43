"""Time helpers that do not depend on the session time zone for NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(col: Column) -> Column:
    """Seconds since 1970 of a wall-clock value, read as UTC."""
    day = F.unix_date(F.to_date(col)).cast("bigint") * 86400
    return day + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def hour_label(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:00:00")


def month_key(col: Column) -> Column:
    """`yyyyMM`, the month partition of a row."""
    return F.date_format(col, "yyyyMM")


def ntz(text: str) -> Column:
    """A timestamp literal without zone."""
    return F.lit(text).cast("timestamp_ntz")


def as_instant(col: Column) -> Column:
    """A wall-clock value of whole seconds as an instant, read as UTC; streams need one for a watermark."""
    return F.timestamp_seconds(epoch_seconds(col))


def as_wall_clock(col: Column) -> Column:
    """The inverse of `as_instant`."""
    return ntz("1970-01-01 00:00:00") + F.make_dt_interval(secs=F.unix_seconds(col).cast("decimal(18, 6)"))


def to_whole_seconds(col: Column) -> Column:
    """A wall-clock value rounded to seconds, as the stored tables keep it."""
    half = F.make_dt_interval(secs=F.lit("0.5").cast("decimal(18, 6)"))
    return ntz("1970-01-01 00:00:00") + F.make_dt_interval(secs=epoch_seconds(col + half).cast("decimal(18, 6)"))
