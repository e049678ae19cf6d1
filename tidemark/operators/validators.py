"""Validation of readings: finite, range, rate, cross-check, quality, in this order; the first failure counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import physics
from tidemark.functions.sensors import by_sensor, is_finite, rate_per_second
from tidemark.operators.asof import latest_before


@dataclass(frozen=True)
class Limits:
    """Bounds are inclusive; a rate or quality fails only beyond its limit."""

    sensor_type: str
    low: float
    high: float
    max_rate: float
    accuracy: float = 0.0
    min_quality: float = 0.5
    altitude: float = 0.0

    def max_change(self, interval_ms: float) -> float:
        return self.max_rate * interval_ms / 1000

    def contains(self, value: float) -> bool:
        return self.low <= value <= self.high


TEMPERATURE = Limits("temperature", -80, 125, 10, 0.1)
TEMPERATURE_INDOOR = replace(TEMPERATURE, low=-10, high=50)
TEMPERATURE_INDUSTRIAL = replace(TEMPERATURE, low=-40, high=200, max_rate=20)
HUMIDITY = Limits("humidity", -2, 102, 20, 3.0)
HUMIDITY_STRICT = replace(HUMIDITY, low=0, high=100, max_rate=15)
PRESSURE = Limits("pressure", 850, 1090, 0.5, 1.0)
PRESSURE_HIGH_ALTITUDE = replace(PRESSURE, low=200, max_rate=2)
DEFAULTS = {x.sensor_type: x for x in (TEMPERATURE, HUMIDITY, PRESSURE)}


def temperature_limits(low: float, high: float, max_rate: float) -> Limits:
    """Swapped bounds are set right, nothing lies under absolute zero, and a rate has no sign."""
    low, high = min(low, high), max(low, high)
    return replace(TEMPERATURE, low=max(low, -273.15), high=high, max_rate=abs(max_rate))


def pressure_at_altitude(h: float, limits: Limits = PRESSURE) -> Limits:
    """Bounds shifted by the altitude table."""
    table, at = physics.ALTITUDE_HPA, (min(max(h, -500.0), 5000.0) + 500) / 100
    i = min(int(at), len(table) - 2)
    shift = table[i] + (table[i + 1] - table[i]) * (at - i)
    return replace(limits, low=limits.low + shift, high=limits.high + shift, altitude=h)


def constraint_dim(spark: SparkSession) -> DataFrame:
    rows = [(x.sensor_type, float(x.low), float(x.high), float(x.max_rate), x.accuracy) for x in DEFAULTS.values()]
    return spark.createDataFrame(rows, "sensor_type string, min_value double, max_value double, max_rate double, accuracy double")


def altitude_consistent(p: Column, h: float) -> Column:
    """Within 50 hPa of what the altitude lets expect; always so at altitude 0."""
    return F.lit(True) if h == 0 else F.abs(p - physics.expected_pressure(F.lit(float(h)))) <= 50


def humidity_consistent(rh: Column, ambient: Column) -> Column:
    """No dew point above the air's temperature, and no steam room; without an ambient temperature nothing is checked."""
    wrong = (physics.dew_point_table(ambient, rh) > ambient + 0.5) | ((ambient > 35) & (rh > 85))
    return ambient.isNull() | ~wrong


def with_rate(readings: DataFrame, rate: str = "rate") -> DataFrame:
    """Adds the absolute change per second since the sensor's last reading; 0 for the first and for times that do not advance."""
    w = by_sensor()
    return readings.withColumn(rate, F.abs(rate_per_second(F.col("value"), F.lag("value").over(w), F.col("ts_ms") - F.lag("ts_ms").over(w))))


def status(limits: Limits, *, rate: Column | None = None, consistent: Column | None = None, value: str = "value", quality: str = "quality") -> Column:
    v = F.col(value)
    out = F.when(~is_finite(v), "InvalidValue").when(~v.between(limits.low, limits.high), "OutOfRange")
    if rate is not None:
        out = out.when(rate > limits.max_rate, "RateExceeded")
    if limits.altitude:
        out = out.when(~altitude_consistent(v, limits.altitude), "CrossValidationFailed")
    if consistent is not None:
        out = out.when(~consistent, "CrossValidationFailed")
    return out.when(F.col(quality) < limits.min_quality, "SensorQualityBad").otherwise("Valid")


def validate(readings: DataFrame, limits: Limits, *, history: bool = True) -> DataFrame:
    """The readings of the limits' kind with ``rate`` and ``status``.  Without ``history`` no rate is checked.

    The kind is a partition key of the window, so the filter reaches the scan.
    """
    own = readings.where(F.col("sensor_type") == limits.sensor_type)
    own = with_rate(own) if history else own.withColumn("rate", F.lit(0.0))
    return own.withColumn("status", status(limits, rate=F.col("rate")))


def validate_all(readings: DataFrame, limits: tuple[Limits, ...] = tuple(DEFAULTS.values())) -> DataFrame:
    """One pass over all kinds; readings of a kind without limits have no status."""
    rated = with_rate(readings)
    out = F.lit(None).cast("string")
    for x in limits:
        out = F.when(F.col("sensor_type") == x.sensor_type, status(x, rate=F.col("rate"))).otherwise(out)
    return rated.withColumn("status", out)


class Validator(Protocol):
    """A validator of one's own: the status of a reading from columns value, quality, rate and any others of the readings."""

    sensor_type: str

    def status(self) -> Column: ...


def validate_with(readings: DataFrame, validators: Sequence[Validator | Limits]) -> DataFrame:
    """One pass over all kinds, each by its own validator, built in or not; other kinds have no status."""
    rated, out = with_rate(readings), F.lit(None).cast("string")
    for x in validators:
        own = status(x, rate=F.col("rate")) if isinstance(x, Limits) else x.status()
        out = F.when(F.col("sensor_type") == x.sensor_type, own).otherwise(out)
    return rated.withColumn("status", out)


def validate_humidity_ambient(readings: DataFrame, limits: Limits = HUMIDITY, tolerance_ms: int = 600_000, *, at_earlier_time: bool = False) -> DataFrame:
    """Humidity checked against the latest temperature of any sensor within the tolerance; with ``at_earlier_time`` one of the
    same time does not count."""
    kinds = readings.where(F.col("sensor_type").isin("humidity", "temperature"))
    rated = with_rate(kinds.where("sensor_type = 'humidity'"))
    air = kinds.where("sensor_type = 'temperature'").select("ts_ms", "seq", F.col("value").alias("ambient"))
    paired = latest_before(rated, air, ["ambient"], tolerance_ms, at_earlier_time=at_earlier_time)
    return paired.withColumn("status", status(limits, rate=F.col("rate"), consistent=humidity_consistent(F.col("value"), F.col("ambient"))))


def message(limits: Limits, status: Column, value: Column, rate: Column) -> Column:
    low, high, most = (F.lit(str(float(x))) for x in (limits.low, limits.high, limits.max_rate))
    return (
        F.when(status == "OutOfRange", F.concat(F.lit("Value "), F.round(value, 3).cast("string"), F.lit(" outside range ["), low, F.lit(", "), high, F.lit("]")))
        .when(status == "RateExceeded", F.concat(F.lit("Rate "), F.round(rate, 3).cast("string"), F.lit("/s exceeds limit "), most, F.lit("/s")))
        .when(status == "CrossValidationFailed", F.lit("Cross-validation failed: sensors disagree"))
        .when(status == "SensorQualityBad", F.lit("Sensor quality check failed: quality too low"))
        .when(status == "InvalidValue", F.lit("Invalid value: not a valid number"))
    )


def confidence(status: Column, quality: Column) -> Column:
    """The quality if valid, half of it if not, none without a number."""
    return F.when(status == "InvalidValue", F.lit(0.0)).when(status == "Valid", quality).otherwise(quality * 0.5)


def summarize(validated: DataFrame) -> DataFrame:
    """Readings of each kind and status, their share of the kind, and the mean confidence."""
    counted = validated.where("status is not null").groupBy("sensor_type", "status").agg(
        F.count("*").alias("n"), F.round(F.avg(confidence(F.col("status"), F.col("quality"))), 6).alias("mean_confidence")
    )
    return counted
