"""Sensor kinds, event fields and small column functions of the reading model.

A reading has sensor_id, sensor_type, value, ts_ms (integer milliseconds), seq (order of arrival) and quality (0 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

# Code, name, unit, typical range.
SENSOR_TYPES = (
    (0, "temperature", "°C", -80.0, 125.0),
    (1, "humidity", "%", 0.0, 100.0),
    (2, "pressure", "hPa", 540.0, 1080.0),
    (3, "voc", "ppb", 0.0, 50.0),
    (4, "particulate", "μg/m³", 0.0, 1000.0),
    (5, "acoustic", "dB", 30.0, 130.0),
    (6, "vibration", "m/s²", 0.0, 50.0),
    (7, "emf", "V/m", -1000.0, 1000.0),
)
# Names accepted for each kind.
ALIASES = {
    "temperature": ("temperature", "temp", "t"),
    "humidity": ("humidity", "hum", "h", "rh"),
    "pressure": ("pressure", "press", "p", "hpa", "bar"),
    "voc": ("voc", "volatile", "gas"),
    "particulate": ("particulate", "pm", "pm2.5", "pm10", "dust"),
    "acoustic": ("acoustic", "sound", "noise", "db"),
    "vibration": ("vibration", "vib", "accelerometer", "accel"),
    "emf": ("emf", "electromagnetic", "magnetic"),
    "custom": ("custom",),
}
STATUSES = ("Valid", "OutOfRange", "RateExceeded", "CrossValidationFailed", "SensorQualityBad", "InvalidValue")
RANGE, RATE, CROSS, QUALITY, PHYSICS, ALL_CHECKS = 1, 2, 4, 8, 16, 31
ID_BYTES = 15


def sensor_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENSOR_TYPES), "code int, sensor_type string, unit string, typical_min double, typical_max double")


def parse_sensor_type(name: Column) -> Column:
    """The canonical kind of an alias in any case; null if unknown."""
    table = F.create_map(*[F.lit(x) for kind, names in ALIASES.items() for alias in names for x in (alias, kind)])
    return F.try_element_at(table, F.lower(F.trim(name)))


def normalize_quality(q: Column) -> Column:
    """0..1 as it is, over 1 up to 100 as a percentage, else null."""
    return F.when((q >= 0) & (q <= 1), q).when((q > 1) & (q <= 100), q / 100)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def valid_id(sensor_id: Column) -> Column:
    return sensor_id.isNotNull() & (F.octet_length(sensor_id) > 0) & (F.octet_length(sensor_id) <= ID_BYTES)


def by_sensor() -> WindowSpec:
    return Window.partitionBy("sensor_id", "sensor_type").orderBy("ts_ms", "seq")


def rate_per_second(value: Column, before: Column, dt_ms: Column) -> Column:
    """Signed change per second; 0 without an earlier reading that is a number, or where time does not advance."""
    return F.when(is_finite(before) & (dt_ms > 0), (value - before) * 1000.0 / dt_ms).otherwise(F.lit(0.0))


def is_high_quality(q: Column) -> Column:
    return q > 0.8


def in_typical_range(sensor_type: Column, value: Column) -> Column:
    """Inclusive; kinds without a range always fit."""
    out = F.lit(True)
    for _, name, _, low, high in SENSOR_TYPES:
        out = F.when(sensor_type == name, value.between(low, high)).otherwise(out)
    return out


def is_critical(status: Column) -> Column:
    return status.isin("InvalidValue", "SensorQualityBad")


def event_is_valid(kind: Column, status: Column) -> Column:
    """Results by their status; other events have none and count as valid."""
    return F.when(kind.isin("validation_result", "cross_validation_result"), status == "Valid").otherwise(F.lit(True))


def event_priority(kind: Column) -> Column:
    """0 comes first."""
    order = ("system_event", "cross_validation_result", "validation_result", "sensor_reading", "batch_reading")
    return (F.array_position(F.array(*[F.lit(k) for k in order]), kind) - 1).cast("int")


def set_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseOR(F.lit(flag))


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) == flag


def format_duration(ms: Column) -> Column:
    """Two days, three hours and four minutes as ``2d 3h 4m``; under a minute in seconds."""
    s = F.floor(ms / 1000)
    parts = [(F.floor(s / 86400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))) for n, unit in parts])
    return F.when(text == "", F.concat(s.cast("string"), F.lit("s"))).otherwise(text)


def valid_time(ms: Column) -> Column:
    """From 2000-01-01 to 2100-01-01."""
    return ms.between(946_684_800_000, 4_102_444_800_000)


def id_hash(sensor_id: Column) -> Column:
    """The polynomial hash of an id's bytes by 31, modulo 2**64, as a decimal; 0 for an empty id."""
    size = F.octet_length(sensor_id)
    number = F.when(size > 0, F.sequence(F.lit(0), size - 1)).when(size == 0, F.array().cast("array<int>"))
    hexed = F.hex(F.encode(sensor_id, "UTF-8"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("decimal(20,0)")
    step = lambda h, i: ((h * 31 + byte(i)) % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.aggregate(number, F.lit(0).cast("decimal(20,0)"), step)
