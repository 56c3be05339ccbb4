"""Instants. All arithmetic is on integer microseconds; nothing depends on the session zone
except the text forms, which assume UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("bigint"))


def bucket_seconds(ts: Column, seconds: int) -> Column:
    """Epoch second of the grid cell holding ``ts``. Floors before the epoch too."""
    whole = F.floor(F.unix_micros(ts) / F.lit(MICRO)).cast("bigint")
    return whole - F.pmod(whole, F.lit(seconds))


def window_bucket(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(bucket_seconds(ts, seconds))


def iso_utc(ts: Column) -> Column:
    """``2026-09-01T10:00:00+00:00``, with six fraction digits only when they are not zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(F.unix_micros(ts), F.lit(MICRO))
    shown = F.when(fraction == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
    )
    return F.concat(base, shown, F.lit("+00:00"))


def iso_utc_full(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


_OFFSET = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"
_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?" + _OFFSET
)


def parse_sensor_time(text: Column) -> Column:
    """Sensor time with an offset to UTC; text without an offset or malformed gives NULL.
    The offset guard matters: Spark alone would read a naive string in the session zone."""
    trimmed = F.trim(text)
    spaced = F.regexp_replace(F.upper(trimmed), "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    dotted = F.regexp_replace(spaced, ",", ".")
    return F.when(trimmed.rlike(_SHAPE), F.try_to_timestamp(dotted))
