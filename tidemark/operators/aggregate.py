"""Windowed aggregation of readings."""

from __future__ import annotations

import statistics
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sensors import by_sensor
from tidemark.operators.folds import fold_sorted

METHODS = ("mean", "min", "max", "sum", "stddev", "median")


def method(name: str, value: str = "value") -> Column:
    """Standard deviation is that of a sample, 0 for a single reading."""
    found = {
        "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "sum": F.sum(value),
        "stddev": F.coalesce(F.stddev_samp(value), F.lit(0.0)), "median": F.median(value),
    }
    return found[name]


def _batch(name: str) -> list[Column]:
    n = F.count("*")
    return [
        n.alias("count"),
        F.when(n > 1, F.floor((F.max("ts_ms") - F.min("ts_ms")) / (n - 1))).otherwise(F.lit(0)).cast("long").alias("interval_ms"),
        method(name).alias("result_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    ]


def tumbling(readings: DataFrame, width_ms: int, name: str = "mean", by: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    """Windows aligned to multiples of the width; every reading counts and the last window is given out."""
    start = (F.floor(F.col("ts_ms") / width_ms) * width_ms).alias("base_ts_ms")
    return readings.groupBy(*by, start).agg(*_batch(name))


def sliding(readings: DataFrame, width_ms: int, slide_ms: int, name: str = "mean", by: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    """Windows of a width that begin at every multiple of the slide."""
    last = F.floor(F.col("ts_ms") / slide_ms) * slide_ms
    starts = F.sequence(last - (width_ms - 1) // slide_ms * slide_ms, last, F.lit(slide_ms))
    spread = readings.withColumn("base_ts_ms", F.explode(starts)).where(F.col("ts_ms") < F.col("base_ts_ms") + width_ms)
    return spread.groupBy(*by, "base_ts_ms").agg(*_batch(name))


def count_windows(readings: DataFrame, n: int, name: str = "mean", by: tuple[str, ...] = ("sensor_id", "sensor_type"), lossy: bool = False) -> DataFrame:
    """Windows of n readings in order.  ``lossy`` drops, as a closing reading that no window keeps, every (n + 1)-th, and the
    last window, which nothing closes."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("ts_ms", "seq")) - 1
    numbered = readings.withColumn("_at", at)
    if lossy:
        total = F.count("*").over(Window.partitionBy(*by))
        numbered = numbered.withColumns({"_all": total, "window_no": F.floor(F.col("_at") / (n + 1))})
        numbered = numbered.where((F.col("_at") % (n + 1) < n) & ((F.col("window_no") + 1) * (n + 1) <= F.col("_all")))
    else:
        numbered = numbered.withColumn("window_no", F.floor(F.col("_at") / n))
    return numbered.groupBy(*by, "window_no").agg(F.min("ts_ms").alias("base_ts_ms"), *_batch(name))


def sessions(readings: DataFrame, gap_ms: int, name: str = "mean") -> DataFrame:
    """Readings of a sensor with no longer gap between them."""
    w = by_sensor()
    new = F.when(F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms, 1).otherwise(0)
    numbered = readings.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("sensor_id", "sensor_type", "session_no").agg(F.min("ts_ms").alias("base_ts_ms"), *_batch(name))


ANCHORED = "sensor_id string, sensor_type string, base_ts_ms long, count long, interval_ms long, result_value double, min_value double, max_value double"


class AnchoredWindow:
    """Readings in order go in, closed windows (start, count, interval, result, min, max) come out."""

    def __init__(self, width_ms: int, name: str, most: int | None, lossy: bool):
        self.width, self.name, self.most, self.lossy = width_ms, name, most, lossy
        self.start: int | None = None
        self.values: list[float] = []
        self.times: list[int] = []

    def add(self, ts: int, value: float) -> tuple | None:
        out = None
        if self.start is None:
            self.start = ts
        full = self.most is not None and len(self.values) == self.most
        if full or ts - self.start >= self.width:
            out = self.close()
            self.start = ts
            if self.lossy and not full:
                return out
        self.values.append(value)
        self.times.append(ts)
        return out

    def close(self) -> tuple | None:
        v, t = self.values, self.times
        self.values, self.times = [], []
        if not v:
            return None
        n = len(v)
        if self.name in ("mean", "sum"):
            result = sum(v) / (n if self.name == "mean" else 1)
        elif self.name == "stddev":
            result = statistics.stdev(v) if n > 1 else 0.0
        else:
            result = {"min": min, "max": max, "median": statistics.median}[self.name](v)
        return self.start, n, (t[-1] - t[0]) // (n - 1) if n > 1 else 0, float(result), min(v), max(v)


def anchored(readings: DataFrame, width_ms: int, name: str = "mean", most: int | None = None, lossy: bool = False) -> DataFrame:
    """Windows of a width that begin at the first reading after the last window's end, for each sensor.

    ``most`` closes a window that holds so many readings (its successor begins with the next reading).  ``lossy`` drops
    readings that close a window by time, and the last window.  Readings without a value take no part.  Where a window
    begins depends on all before it, so a sensor's readings are sorted and folded in one pass that holds one window.
    """
    slim = readings.where("value is not null")
    return fold_sorted(slim, ("sensor_id", "sensor_type"), ("ts_ms", "value"), lambda key: _Anchored(AnchoredWindow(width_ms, name, most, lossy)), ANCHORED)


class _Anchored:
    def __init__(self, window: AnchoredWindow):
        self.window = window

    def add(self, ts: int, value: float) -> Iterator[tuple]:
        if row := self.window.add(ts, value):
            yield row

    def close(self) -> Iterator[tuple]:
        if not self.window.lossy and (row := self.window.close()):
            yield row


STATS = ("mean", "min", "max", "std_dev", "rate_of_change", "count", "median", "variance", "skewness", "kurtosis", "rms", "zero_crossings", "peak_count", "trend_slope")


def sensor_stats(readings: DataFrame, by: tuple[str, ...] = ("sensor_id", "sensor_type")) -> DataFrame:
    """Fourteen moments of each group: population moments, excess kurtosis, crossings of the mean, local maxima, slope per second."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    mean = F.avg("value").over(Window.partitionBy(*by))
    v, before, after = F.col("value"), F.lag("value").over(w), F.lead("value").over(w)
    marked = readings.withColumns({"_mean": mean, "_before": before, "_after": after})
    marked = marked.withColumns(
        {
            "_cross": F.when((F.col("_before") - F.col("_mean")) * (v - F.col("_mean")) < 0, 1).otherwise(0),
            "_peak": F.when((v > F.col("_before")) & (v > F.col("_after")), 1).otherwise(0),
            "_t": F.col("ts_ms") / 1000.0 - F.min("ts_ms").over(Window.partitionBy(*by)) / 1000.0,
        }
    )
    span = F.max("ts_ms") - F.min("ts_ms")
    first, last = F.min_by("value", F.struct("ts_ms", "seq")), F.max_by("value", F.struct("ts_ms", "seq"))
    return marked.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std_dev"),
        F.when(span > 0, (last - first) * 1000.0 / span).otherwise(F.lit(0.0)).alias("rate_of_change"), F.count("*").alias("count"),
        F.median("value").alias("median"), F.var_pop("value").alias("variance"),
        F.coalesce(F.skewness("value"), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis("value"), F.lit(0.0)).alias("kurtosis"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.sum("_cross").alias("zero_crossings"), F.sum("_peak").alias("peak_count"),
        F.coalesce(F.regr_slope("value", "_t"), F.lit(0.0)).alias("trend_slope"),
    )
