"""The tables as sensor readings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import millis

KINDS = (("view", "temperature"), ("click", "humidity"), ("purchase", "pressure"), ("signup", "voc"), ("error", "vibration"))


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: a user is a sensor, an event type a kind of sensor, props.k a quality in hundredths."""
    return as_readings(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_readings(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in KINDS for x in pair])[F.col("event_type")]
    value = F.when(F.col("event_type") == "view", F.col("value") - 20).when(F.col("event_type") == "purchase", F.col("value") * 0.6 + 850).otherwise(F.col("value"))
    return events.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sensor_id"), kind.alias("sensor_type"), value.alias("value"), millis(F.col("ts")).alias("ts_ms"),
        F.col("event_id").alias("seq"), (F.regexp_extract("props", "([0-9]+)", 1).try_cast("double") / 100.0).alias("quality"),
    )


READINGS_SQL = """r AS (
  SELECT 's' || CAST(user_id AS VARCHAR) AS sensor_id,
         CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'humidity' WHEN 'purchase' THEN 'pressure'
                         WHEN 'signup' THEN 'voc' WHEN 'error' THEN 'vibration' END AS sensor_type,
         CASE event_type WHEN 'view' THEN value - 20 WHEN 'purchase' THEN value * 0.6 + 850 ELSE value END AS value,
         epoch_us(ts) // 1000 AS ts_ms, event_id AS seq,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0 AS quality
  FROM events)"""


def with_readings(body: str, *more: str) -> str:
    """SQL over the readings r, with further common tables."""
    return "WITH " + ",\n".join([READINGS_SQL, *more]) + "\n" + body
