"""Event time from the tables' timestamps, as integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000)


def from_iso(text: Column) -> Column:
    """Milliseconds of an ISO 8601 time; without an offset it is UTC; null for what is none."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_millis(zoned.try_cast("timestamp"))


def to_iso(ms: Column) -> Column:
    """ISO 8601 in UTC, with milliseconds."""
    whole = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def later(ms: Column, *, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0, millis: int = 0) -> Column:
    """A time so much later; negative numbers for earlier."""
    return ms + ((((days * 24 + hours) * 60 + minutes) * 60 + seconds) * 1000 + millis)


def since(ms: Column, before: Column) -> Column:
    """Milliseconds from an earlier time; 0 where it is not earlier."""
    return F.greatest(ms - before, F.lit(0))


def fixed(ms: int) -> Column:
    """The same time for all rows, for repeatable runs."""
    return F.lit(ms).cast("long")


def monotonic(ts: str = "ts_ms", by: tuple[str, ...] = ("sensor_id", "sensor_type"), order: str = "seq") -> Column:
    """A clock that never goes back: the latest time so far of the same key, in the order of arrival."""
    return F.max(ts).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
