"""Pipeline stages: functions from DataFrame to DataFrame that compose with ``df.transform``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions import physics
from tidemark.functions.sensors import RANGE, RATE, by_sensor
from tidemark.operators.asof import latest_before
from tidemark.operators.validators import Limits, validate_all

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    """A chain of stages.  There is no limit on stages or on what one gives out; Catalyst sees one plan."""

    def __init__(self, stages: Sequence[Stage] = ()):
        self.stages = tuple(stages)

    def then(self, stage: Stage) -> Pipeline:
        return Pipeline([*self.stages, stage])

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, stage: d.transform(stage), self.stages, df)


def keep(condition: Column) -> Stage:
    return lambda df: df.where(condition)


def route(routes: Mapping[str, Stage], default: Stage | None = None, by: str = "sensor_type") -> Stage:
    """Each kind to its stage, the rest (null kinds included) to the default or through.

    The input is read once for each route; routes that only change columns or drop rows are better given as ``route_columns``.
    """

    def run(df: DataFrame) -> DataFrame:
        rest = df.where(F.col(by).isNull() | ~F.col(by).isin(list(routes)))
        parts = [df.where(F.col(by) == kind).transform(stage) for kind, stage in routes.items()]
        parts.append(rest.transform(default) if default else rest)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return run


def route_columns(routes: Mapping[str, Mapping[str, Column]], keep_if: Mapping[str, Column] | None = None, by: str = "sensor_type") -> Stage:
    """Columns changed, and rows kept, by kind, in one pass; other kinds, and null, go through as they are."""

    def run(df: DataFrame) -> DataFrame:
        changed: dict[str, Column] = {}
        for kind, columns in routes.items():
            for name, column in columns.items():
                changed[name] = F.when(F.col(by) == kind, column).otherwise(changed.get(name, F.col(name)))
        for kind, condition in (keep_if or {}).items():
            df = df.where((F.col(by) != kind) | F.col(by).isNull() | condition)
        return df.withColumns(changed)

    return run


def fan_out(*events: Column) -> Stage:
    """Several events, structs alike, for each row."""
    return lambda df: df.select(F.inline(F.array_compact(F.array(*events))))


def validation_events(*limits: Limits) -> Stage:
    """Each reading, and behind it, if its kind has limits, the result of its validation."""

    def run(df: DataFrame) -> DataFrame:
        def event(kind: str, place: int, status: Column, flags: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("event_kind"), F.col("seq").alias("seq"), F.lit(place).alias("place"), F.col("ts_ms").alias("ts_ms"), F.col("sensor_id").alias("sensor_id"),
                F.col("sensor_type").alias("sensor_type"), F.col("value").alias("value"), F.col("quality").alias("quality"), status.alias("status"), flags.alias("constraints_applied"),
            )

        none = F.lit(None)
        reading = event("sensor_reading", 0, none.cast("string"), none.cast("int"))
        result = F.when(F.col("status").isNotNull(), event("validation_result", 1, F.col("status"), F.lit(RANGE | RATE)))
        return validate_all(df, limits).transform(fan_out(reading, result))

    return run


def cross_validate(primary: str, secondary: str, tolerance_ms: int = 5000, keys: Sequence[str] = (), *, at_earlier_time: bool = False) -> Stage:
    """A result whenever a reading of either kind has a latest reading of the other within the tolerance.

    The pair temperature and humidity fails where the dew point lies above the temperature; any other pair is valid.
    With ``at_earlier_time`` readings of the same time are no pair.
    """

    def run(df: DataFrame) -> DataFrame:
        columns = ["sensor_id", "value"]
        other = {c: f"other_{c}" for c in columns}
        one, two = (df.where(F.col("sensor_type") == kind) for kind in (primary, secondary))
        slim = [x.select(*keys, "ts_ms", "seq", "sensor_id", "value") for x in (one, two)]
        first = latest_before(slim[0], slim[1].withColumnsRenamed(other), list(other.values()), tolerance_ms, keys, at_earlier_time=at_earlier_time)
        second = latest_before(slim[1], slim[0].withColumnsRenamed(other), list(other.values()), tolerance_ms, keys, at_earlier_time=at_earlier_time)
        names = ["seq", "ts_ms", "primary_id", "secondary_id", "expected_value", "actual_value"]
        a = first.select("seq", "ts_ms", "sensor_id", "other_sensor_id", "value", "other_value").toDF(*names)
        b = second.select("seq", "ts_ms", "other_sensor_id", "sensor_id", "other_value", "value").toDF(*names)
        pairs = a.where("secondary_id is not null").union(b.where("primary_id is not null"))
        fails = F.lit(False)
        if (primary, secondary) == ("temperature", "humidity"):
            fails = physics.dew_point_table(F.col("expected_value"), F.col("actual_value")) > F.col("expected_value")
        return pairs.withColumns({"status": F.when(fails, "CrossValidationFailed").otherwise("Valid"), "deviation_percent": F.lit(0.0)})

    return run


def zscore_anomalies(window: int = 20, least: int = 3, threshold: float = 3.0) -> Stage:
    """Readings far from the mean of the sensor's earlier ones, in population standard deviations."""

    def run(df: DataFrame) -> DataFrame:
        w = by_sensor().rowsBetween(-window, -1)
        scored = df.withColumns({"_n": F.count("value").over(w), "_mean": F.avg("value").over(w), "_sd": F.stddev_pop("value").over(w)})
        scored = scored.withColumn("zscore", F.when((F.col("_n") >= least) & (F.col("_sd") >= 0.001), F.abs(F.col("value") - F.col("_mean")) / F.col("_sd")))
        return scored.where(F.col("zscore") > threshold).drop("_n", "_mean", "_sd")

    return run


def enrich(window: int = 5) -> Stage:
    """Rate of change, moving average with the reading itself, and trend."""

    def run(df: DataFrame) -> DataFrame:
        w = by_sensor()
        dt = F.col("ts_ms") - F.lag("ts_ms").over(w)
        change = F.when(dt > 0, (F.col("value") - F.lag("value").over(w)) * 1000.0 / dt)
        df = df.withColumns({"rate_of_change": change, "moving_average": F.avg("value").over(w.rowsBetween(-(window - 1), 0))})
        diff = F.col("value") - F.lag("value").over(w)
        trend = F.when(diff.isNull(), "unknown").when(diff > 0.5, "rising").when(diff < -0.5, "falling").otherwise("stable")
        return df.withColumn("trend", trend)

    return run


def consecutive_alerts(violates: Column, least: int = 3) -> Stage:
    """Readings that are at least the ``least``-th violation of their sensor in a row, with that number."""

    def run(df: DataFrame) -> DataFrame:
        w = by_sensor()
        df = df.withColumn("_bad", F.coalesce(violates, F.lit(False)))
        df = df.withColumn("_island", F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        run_length = F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(Window.partitionBy("sensor_id", "sensor_type", "_island").orderBy("ts_ms", "seq"))
        return df.withColumn("consecutive", run_length).where(F.col("_bad") & (F.col("consecutive") >= least)).drop("_bad", "_island")

    return run


def recover(failed: Column, most: int = 3) -> Stage:
    """From the ``most``-th failure in a row on, the last good value (quality over 0.7) at quality 0.5, marked recovered."""

    def run(df: DataFrame) -> DataFrame:
        w = by_sensor().rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_bad", F.coalesce(failed, F.lit(False)))
        df = df.withColumns({"_island": F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(w), "_good": F.last(F.when(~F.col("_bad") & (F.col("quality") > 0.7), F.col("value")), ignorenulls=True).over(w)})
        length = F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(Window.partitionBy("sensor_id", "sensor_type", "_island").orderBy("ts_ms", "seq"))
        df = df.withColumn("recovered", F.col("_bad") & (length >= most) & F.col("_good").isNotNull())
        return df.withColumns(
            {"value": F.when(F.col("recovered"), F.col("_good")).otherwise(F.col("value")), "quality": F.when(F.col("recovered"), 0.5).otherwise(F.col("quality"))}
        ).drop("_bad", "_island", "_good")

    return run


def recovery_events(failed: Column, most: int = 3) -> Stage:
    """The readings as ``recover`` gives them, and from the ``most``-th failure in a row on a system event for each, with their number."""

    def run(df: DataFrame) -> DataFrame:
        w = by_sensor().rowsBetween(Window.unboundedPreceding, 0)
        bad = F.coalesce(failed, F.lit(False))
        counted = df.withColumn("_bad", bad).withColumn("_island", F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(w))
        length = F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(Window.partitionBy("sensor_id", "sensor_type", "_island").orderBy("ts_ms", "seq"))
        counted = counted.withColumns({"_run": length, "_failed": F.col("_bad")}).drop("_bad", "_island")
        out = counted.transform(recover(F.col("_failed"), most))

        def event(kind: str, value: Column, quality: Column, details: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("event_kind"), F.col("seq").alias("seq"), F.col("sensor_id").alias("sensor_id"), F.col("sensor_type").alias("sensor_type"), F.col("ts_ms").alias("ts_ms"),
                value.cast("double").alias("value"), quality.cast("double").alias("quality"), details.cast("long").alias("system_details"),
            )

        none = F.lit(None)
        reading = event("sensor_reading", F.col("value"), F.col("quality"), none)
        system = F.when(F.col("_failed") & (F.col("_run") >= most), event("system_event", none, none, F.col("_run")))
        return out.transform(fan_out(reading, system))

    return run


def silences(timeout_ms: int, trailing: bool = False) -> Stage:
    """Gaps between a sensor's readings that are longer than the timeout.

    With ``trailing`` also the gap from a sensor's last reading to the last reading of all, and ``closed``: whether the sensor
    was heard again.
    """

    def run(df: DataFrame) -> DataFrame:
        after = F.lead("ts_ms").over(by_sensor())
        if trailing:
            end = df.agg(F.max("ts_ms").alias("_end"))  # one row
            df = df.join(F.broadcast(end)).withColumns({"closed": after.isNotNull(), "_after": F.coalesce(after, F.col("_end"))})
            found = df.select("sensor_id", "sensor_type", F.col("ts_ms").alias("silent_from_ms"), (F.col("_after") - F.col("ts_ms")).alias("gap_ms"), "closed")
        else:
            found = df.select("sensor_id", "sensor_type", F.col("ts_ms").alias("silent_from_ms"), (after - F.col("ts_ms")).alias("gap_ms"))
        return found.where(F.col("gap_ms") > timeout_ms)

    return run


def counted(name: str, *measures: Column) -> tuple[Stage, Observation]:
    """A stage that passes rows on and counts them, and what it has seen once an action has run."""
    seen = Observation(name)
    return (lambda df: df.observe(seen, F.count(F.lit(1)).alias("processed"), *measures)), seen
