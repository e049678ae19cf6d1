"""Short forms, the event log and counters."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import events
from tidemark.operators import stages


def test_single_values():
    assert api.quick_validate(20, "Temp")["status"] == "Valid"
    assert api.quick_validate(math.nan, "t") == {"value": pytest.approx(math.nan, nan_ok=True), "is_valid": False, "status": "InvalidValue", "confidence": 0.0}
    assert api.quick_validate(200, "t", 80) == {"value": 200, "is_valid": False, "status": "OutOfRange", "confidence": 0.4}
    assert api.quick_validate(50, "rh", 0.4)["status"] == "SensorQualityBad"
    with pytest.raises(api.ConfigurationError):
        api.quick_validate(1, "voc")
    with pytest.raises(api.ConversionError):
        api.kind_of("nothing")
    with pytest.raises(api.QualityError):
        api.create_reading("a", "temp", 1, 0, 101)
    with pytest.raises(api.SensorError):
        api.create_reading("x" * 16, "temp", 1, 0)
    assert api.create_reading("a", "hPa", 1000, 5, 50) == ("a", "pressure", 1000.0, 5, 0.5)
    assert api.in_typical_range(125, "temp") and not api.in_typical_range(126, "temp") and api.in_typical_range(1e9, "custom")


def test_batches_agree_with_single_values(spark):
    values = [20.0, None, float("nan"), 126.0, -80.0]
    got = [r.status for r in api.batch_validate(spark, values, "temperature", 0.9).orderBy("seq").collect()]
    assert got == [api.quick_validate(v, "temperature", 0.9)["status"] for v in values]


def test_event_log(spark):
    df = spark.createDataFrame([("a", "temperature", 1.0, 5, 0.5, 0), ("", "temperature", 1.0, 5, 0.5, 1), ("é" * 8, "temperature", 1.0, 5, 0.5, 2)], "sensor_id string, sensor_type string, value double, ts_ms long, quality double, seq long")
    log = events.log(events.readings(df), events.system(df, "QueueOverflow", F.col("seq")))
    assert log.schema.names == events.EVENT.names and [f.dataType for f in log.schema] == [f.dataType for f in events.EVENT]
    assert {(r.event_kind, r.seq, r.system_details) for r in log.collect()} == {("sensor_reading", 0, None), ("system_event", None, 0), ("system_event", None, 1), ("system_event", None, 2)}
    with pytest.raises(ValueError):
        events.event("sensor_reading", nonsense=F.lit(1))
    with pytest.raises(ValueError):
        events.system(df, "Nonsense", F.lit(1))


def test_counter(spark):
    stage, seen = stages.counted("stage", F.sum(F.lit(2)).alias("twice"))
    assert spark.range(7).transform(stage).where("id > 3").count() == 3
    assert seen.get == {"processed": 7, "twice": 14}
