"""Short forms for common uses: single values in plain Python, tables as DataFrames."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sensors import ALIASES, ID_BYTES, SENSOR_TYPES, is_finite, sensor_dim
from tidemark.operators.validators import DEFAULTS, Limits, summarize, validate_all


class SensorError(ValueError):
    """Base of the errors below."""


class ConfigurationError(SensorError):
    """No validator for a kind, or bad settings."""


class ConversionError(SensorError):
    """A value of the wrong form."""


class QualityError(SensorError):
    """A quality outside of 0 to 100."""


class RangeError(SensorError):
    """A value outside of its range."""


def kind_of(name: str) -> str:
    for kind, names in ALIASES.items():
        if name.strip().lower() in names:
            return kind
    raise ConversionError(f"unknown sensor type {name!r}")


def quality_of(q: float) -> float:
    if 0 <= q <= 1:
        return q
    if 1 < q <= 100:
        return q / 100
    raise QualityError(f"quality {q} is outside 0 to 100")


def limits_of(sensor_type: str) -> Limits:
    kind = kind_of(sensor_type)
    if kind not in DEFAULTS:
        raise ConfigurationError(f"no validator for {kind}")
    return DEFAULTS[kind]


def quick_validate(value: float, sensor_type: str, quality: float = 1.0, limits: Limits | None = None) -> dict:
    """Status, validity and confidence of one value without history."""
    limits, quality = limits or limits_of(sensor_type), quality_of(quality)
    if value is None or not math.isfinite(value):
        status = "InvalidValue"
    elif not limits.contains(value):
        status = "OutOfRange"
    else:
        status = "SensorQualityBad" if quality < limits.min_quality else "Valid"
    confidence = 0.0 if status == "InvalidValue" else quality if status == "Valid" else quality * 0.5
    return {"value": value, "is_valid": status == "Valid", "status": status, "confidence": confidence}


def create_reading(sensor_id: str, sensor_type: str, value: float, ts_ms: int, quality: float = 1.0) -> tuple:
    """(sensor_id, sensor_type, value, ts_ms, quality), checked."""
    if not 1 <= len(sensor_id.encode()) <= ID_BYTES:
        raise ConversionError(f"a sensor id has 1 to {ID_BYTES} bytes")
    return sensor_id, kind_of(sensor_type), float(value), int(ts_ms), quality_of(quality)


def batch_validate(spark: SparkSession, values: list[float], sensor_type: str, quality: float = 1.0) -> DataFrame:
    """seq, value, quality and status of many values without history."""
    from tidemark.operators.validators import status

    rows = [(i, None if v is None else float(v), quality_of(quality)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq long, value double, quality double").withColumn("status", status(limits_of(sensor_type)))


def validate_and_summarize(readings: DataFrame) -> DataFrame:
    return summarize(validate_all(readings))


def sensor_ranges() -> dict[str, tuple[float, float]]:
    return {name: (low, high) for _, name, _, low, high in SENSOR_TYPES}


def in_typical_range(value: float, sensor_type: str) -> bool:
    low, high = sensor_ranges().get(kind_of(sensor_type), (-math.inf, math.inf))
    return low <= value <= high


def convert(values: DataFrame, column: str) -> DataFrame:
    """Adds ``number`` and ``problem``: text as a finite number, or why it is none."""
    number: Column = F.col(column).cast("string").try_cast("double")
    why = F.when(F.col(column).isNull(), "missing").when(number.isNull(), "not a number").when(~is_finite(number), "not finite")
    return values.withColumns({"number": F.when(is_finite(number), number), "problem": why})


def max_change_for_interval(sensor_type: str, interval_ms: float) -> float:
    return limits_of(sensor_type).max_change(interval_ms)


def get_range(sensor_type: str) -> tuple[float, float]:
    limits = limits_of(sensor_type)
    return limits.low, limits.high


def get_config(sensor_type: str) -> dict:
    return asdict(limits_of(sensor_type))


def validate_reading(reading: tuple, sensor_type: str) -> dict:
    """quick_validate of a reading as create_reading gives it, which must be of that kind."""
    if kind_of(reading[1]) != kind_of(sensor_type):
        raise ConfigurationError(f"a reading of {reading[1]} cannot be judged as {sensor_type}")
    return quick_validate(reading[2], sensor_type, reading[4])


class EventQueue:
    """A bounded first-in, first-out queue for sinks and transports; ``push`` says whether there was room."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ConfigurationError("a queue has room for one event at least")
        self.capacity, self._held = capacity, deque()

    def push(self, event) -> bool:
        if self.is_full:
            return False
        self._held.append(event)
        return True

    def pop(self):
        return self._held.popleft() if self._held else None

    def peek(self):
        return self._held[0] if self._held else None

    def drain(self) -> list:
        out = list(self._held)
        self._held.clear()
        return out

    @property
    def is_full(self) -> bool:
        return len(self._held) >= self.capacity

    def __len__(self) -> int:
        return len(self._held)


def register_views(readings: DataFrame) -> list[str]:
    """Views for SQL text: ``readings``, ``validated`` (with rate and status) and ``sensor_types``; their names."""
    views = {"readings": readings, "validated": validate_all(readings), "sensor_types": sensor_dim(readings.sparkSession)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
