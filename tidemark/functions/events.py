"""The event log: one row for each event of any of five kinds, with the columns of the others null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
EVENT = T.StructType(
    [
        T.StructField(name, kind)
        for kind, names in (
            (_S, "event_kind"), (_L, "seq ts_ms"), (_S, "sensor_id sensor_type"), (_D, "value quality"), (_S, "status"), (T.IntegerType(), "constraints_applied"),
            (_S, "related_sensor validation_type"), (_D, "expected_value actual_value deviation_percent"), (_L, "count interval_ms"), (_D, "mean_value min_value max_value"),
            (_S, "system_event_type"), (_L, "system_details"),
        )
        for name in names.split()
    ]
)
SYSTEM_EVENTS = ("PipelineStart", "PipelineStop", "QueueOverflow", "ValidatorError", "MemoryWarning", "PerformanceWarning")


def event(kind: str, **columns: Column) -> list[Column]:
    """The columns of the event log for one kind of event; what is not named is null."""
    unknown = set(columns) - set(EVENT.names)
    if unknown:
        raise ValueError(f"an event has no {sorted(unknown)}")
    given = columns | {"event_kind": F.lit(kind)}
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT]


def readings(df: DataFrame) -> DataFrame:
    """Readings as events; those without an id of 1 to 15 bytes cannot be built and are left out."""
    from tidemark.functions.sensors import valid_id

    names = ("seq", "ts_ms", "sensor_id", "sensor_type", "value", "quality")
    return df.where(valid_id(F.col("sensor_id"))).select(*event("sensor_reading", **{n: F.col(n) for n in names}))


def batches(df: DataFrame) -> DataFrame:
    """Windowed aggregates as events, at their base time."""
    return df.select(
        *event("batch_reading", ts_ms=F.col("base_ts_ms"), sensor_type=F.col("sensor_type"), count=F.col("count"), interval_ms=F.col("interval_ms"), mean_value=F.col("result_value"), min_value=F.col("min_value"), max_value=F.col("max_value"))
    )


def cross_results(df: DataFrame, validation_type: str = "DewPoint") -> DataFrame:
    names = ("seq", "ts_ms", "status", "expected_value", "actual_value", "deviation_percent")
    return df.select(
        *event("cross_validation_result", sensor_id=F.col("primary_id"), related_sensor=F.col("secondary_id"), validation_type=F.lit(validation_type), **{n: F.col(n) for n in names})
    )


def system(df: DataFrame, kind: str, details: Column) -> DataFrame:
    if kind not in SYSTEM_EVENTS:
        raise ValueError(f"unknown system event {kind!r}")
    return df.select(*event("system_event", ts_ms=F.col("ts_ms"), system_event_type=F.lit(kind), system_details=details))


def log(*parts: DataFrame) -> DataFrame:
    """All events in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
