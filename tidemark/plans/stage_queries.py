"""Queries over pipeline stages and flow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import flow, stages
from tidemark.plans.functions_queries import dew_sql
from tidemark.plans.readings import sensor_readings, with_readings
from tidemark.plans.validator_queries import LIMITS, RATED_SQL, STATUS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W = "WINDOW w AS (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(with_readings("""SELECT 'sensor_reading' AS event_kind, seq, 0 AS place, ts_ms, sensor_id, sensor_type, value, quality, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INTEGER) AS constraints_applied FROM checked
UNION ALL SELECT 'validation_result', seq, 1, ts_ms, sensor_id, sensor_type, value, quality, status, 3 FROM checked WHERE status IS NOT NULL""", RATED_SQL, STATUS_SQL))
def validation_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.validation_events(*LIMITS))


@query(with_readings("SELECT seq, sensor_id, value FROM r WHERE quality > 0.8 AND sensor_type = 'temperature'"))
def filter_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = stages.Pipeline([stages.keep(F.col("quality") > 0.8)]).then(stages.keep(F.col("sensor_type") == "temperature"))
    return chain(sensor_readings(spark, sf_dir)).select("seq", "sensor_id", "value")


@query(with_readings("SELECT seq, sensor_type, CASE sensor_type WHEN 'temperature' THEN value + 273.15 WHEN 'pressure' THEN value * 100 ELSE value END AS value FROM r WHERE sensor_type <> 'voc' OR quality >= 0.5"))
def router_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = {"temperature": {"value": F.col("value") + 273.15}, "pressure": {"value": F.col("value") * 100}}
    return sensor_readings(spark, sf_dir).transform(stages.route_columns(changes, {"voc": F.col("quality") >= 0.5})).select("seq", "sensor_type", "value")


@query(with_readings("SELECT sensor_type, count(*) AS n FROM r WHERE sensor_type <> 'voc' OR quality >= 0.5 GROUP BY 1"))
def router_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = {"voc": stages.keep(F.col("quality") >= 0.5)}
    return sensor_readings(spark, sf_dir).transform(stages.route(routes)).groupBy("sensor_type").agg(F.count("*").alias("n"))


@query(with_readings(f"""SELECT seq, ts_ms, primary_id, secondary_id, expected_value, actual_value,
  CASE WHEN {dew_sql('expected_value', 'actual_value')} > expected_value THEN 'CrossValidationFailed' ELSE 'Valid' END AS status, 0e0 AS deviation_percent
FROM (SELECT t.seq, t.ts_ms, t.sensor_id AS primary_id, h.sensor_id AS secondary_id, t.value AS expected_value, h.value AS actual_value FROM t ASOF JOIN h ON t.ts_ms > h.ts_ms WHERE t.ts_ms - h.ts_ms <= 600000
  UNION ALL SELECT h.seq, h.ts_ms, t.sensor_id, h.sensor_id, t.value, h.value FROM h ASOF JOIN t ON h.ts_ms > t.ts_ms WHERE h.ts_ms - t.ts_ms <= 600000)""",
    "t AS (SELECT * FROM r WHERE sensor_type = 'temperature')", "h AS (SELECT * FROM r WHERE sensor_type = 'humidity')"))
def cross_validation_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.cross_validate("temperature", "humidity", 600_000, at_earlier_time=True))


@query(with_readings("""SELECT seq, sensor_id, sensor_type, round(z, 6) AS zscore FROM (
  SELECT *, CASE WHEN n >= 3 AND sd >= 0.001 THEN abs(value - mean) / sd END AS z FROM (
    SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM r
    WINDOW w AS (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))) WHERE z > 3"""))
def zscore_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.zscore_anomalies()).select("seq", "sensor_id", "sensor_type", F.round("zscore", 6).alias("zscore"))


@query(with_readings(f"""SELECT seq, round(CASE WHEN dt > 0 THEN (value - before) * 1000.0 / dt END, 6) AS rate_of_change, round(ma, 6) AS moving_average,
  CASE WHEN before IS NULL THEN 'unknown' WHEN value - before > 0.5 THEN 'rising' WHEN value - before < -0.5 THEN 'falling' ELSE 'stable' END AS trend
FROM (SELECT *, lag(value) OVER w AS before, ts_ms - lag(ts_ms) OVER w AS dt, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma FROM r {W})"""))
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sensor_readings(spark, sf_dir).transform(stages.enrich(5))
    return df.select("seq", F.round("rate_of_change", 6).alias("rate_of_change"), F.round("moving_average", 6).alias("moving_average"), "trend")


@query(with_readings(f"""SELECT seq, sensor_id, sensor_type, CAST(consecutive AS BIGINT) AS consecutive FROM (
  SELECT *, sum(bad) OVER (PARTITION BY sensor_id, sensor_type, island ORDER BY ts_ms, seq) AS consecutive FROM (
    SELECT *, CASE WHEN quality < 0.6 THEN 1 ELSE 0 END AS bad, sum(CASE WHEN quality < 0.6 THEN 0 ELSE 1 END) OVER w AS island FROM r {W})) WHERE bad = 1 AND consecutive >= 3"""))
def consecutive_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.consecutive_alerts(F.col("quality") < 0.6, 3)).select("seq", "sensor_id", "sensor_type", "consecutive")


@query(with_readings(f"""SELECT seq, rec AS recovered, CASE WHEN rec THEN good ELSE value END AS value, CASE WHEN rec THEN 0.5 ELSE quality END AS quality FROM (
  SELECT *, bad = 1 AND good IS NOT NULL AND sum(bad) OVER (PARTITION BY sensor_id, sensor_type, island ORDER BY ts_ms, seq) >= 3 AS rec FROM (
    SELECT *, CASE WHEN quality < 0.6 THEN 1 ELSE 0 END AS bad, sum(CASE WHEN quality < 0.6 THEN 0 ELSE 1 END) OVER w AS island,
      last_value(CASE WHEN quality > 0.7 THEN value END IGNORE NULLS) OVER w AS good FROM r {W}))"""))
def error_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.recover(F.col("quality") < 0.6, 3)).select("seq", "recovered", "value", "quality")


@query(with_readings(f"SELECT sensor_id, sensor_type, ts_ms AS silent_from_ms, gap_ms FROM (SELECT *, lead(ts_ms) OVER w - ts_ms AS gap_ms FROM r {W}) WHERE gap_ms > 259200000"))
def sensor_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.silences(259_200_000))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = sensor_readings(spark, sf_dir).select("seq", "sensor_type", "ts_ms")
    return r.where("sensor_type = 'temperature'"), r.where("sensor_type = 'humidity'")


@query(with_readings("""SELECT seq, stream_no, row_number() OVER (ORDER BY ts_ms, stream_no, seq) - 1 AS position
FROM (SELECT *, CASE sensor_type WHEN 'temperature' THEN 0 ELSE 1 END AS stream_no FROM r WHERE sensor_type IN ('temperature', 'humidity'))"""))
def time_ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.merge_by_time(*_two(spark, sf_dir)).select("seq", "stream_no", "position")


@query(with_readings("""SELECT seq, stream_no, row_number() OVER (ORDER BY turn, stream_no) - 1 AS position
FROM (SELECT *, row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) - 1 AS turn, CASE sensor_type WHEN 'temperature' THEN 0 ELSE 1 END AS stream_no FROM r WHERE sensor_type IN ('temperature', 'humidity'))"""))
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.merge_round_robin(*_two(spark, sf_dir)).select("seq", "stream_no", "position")


@query(with_readings("SELECT sensor_type, batch_no, count(*) AS n, min(seq) AS first_seq FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) - 1) / 64) AS BIGINT) AS batch_no FROM r) GROUP BY 1, 2"))
def batch_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.batch_by_count(sensor_readings(spark, sf_dir), 64).groupBy("sensor_type", "batch_no").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(with_readings("SELECT CAST(floor(ts_ms / 3600000) AS BIGINT) AS batch_no, count(*) AS n FROM r GROUP BY 1"))
def batch_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.batch_by_time(sensor_readings(spark, sf_dir), 3_600_000).groupBy("batch_no").agg(F.count("*").alias("n"))


ORDERED_SQL = "o AS (SELECT seq, sensor_type, ts_ms, row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) AS k FROM r)"


@query(with_readings("SELECT sensor_type, number AS batch_no, count(*) AS n, min(seq) AS first_seq FROM f GROUP BY 1, 2", ORDERED_SQL,
    """f AS (SELECT sensor_type, k, seq, CAST(0 AS BIGINT) AS number, 1 AS held, ts_ms AS start FROM o WHERE k = 1
  UNION ALL SELECT o.sensor_type, o.k, o.seq, f.number + CASE WHEN f.held = 64 OR o.ts_ms - f.start >= 36000000 THEN 1 ELSE 0 END,
    CASE WHEN f.held = 64 OR o.ts_ms - f.start >= 36000000 THEN 1 ELSE f.held + 1 END, CASE WHEN f.held = 64 OR o.ts_ms - f.start >= 36000000 THEN o.ts_ms ELSE f.start END
  FROM f JOIN o ON o.sensor_type = f.sensor_type AND o.k = f.k + 1)""").replace("WITH r AS", "WITH RECURSIVE r AS"))
def batch_by_count_or_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).select("seq", "sensor_type", "ts_ms")
    return flow.batch_by_count_or_time(r, 64, 36_000_000, ("sensor_type",)).groupBy("sensor_type", "batch_no").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(with_readings("SELECT seq, sensor_type FROM (SELECT *, row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms DESC, seq DESC) AS k FROM r) WHERE k <= 127"))
def drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.drop_oldest(sensor_readings(spark, sf_dir), 128).select("seq", "sensor_type")


@query(with_readings("SELECT seq, sensor_type FROM (SELECT *, row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) AS k FROM r) WHERE k <= 127"))
def drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.drop_newest(sensor_readings(spark, sf_dir), 128).select("seq", "sensor_type")


@query(with_readings(f"SELECT seq, coalesce(last_value(CASE WHEN quality >= 0.8 THEN 1 WHEN quality <= 0.2 THEN 0 END IGNORE NULLS) OVER w, 0) = 1 AS paused FROM r {W}"))
def backpressure_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.backpressure(sensor_readings(spark, sf_dir), "quality", ("sensor_id", "sensor_type")).select("seq", "paused")


@query(with_readings("SELECT seq, sensor_type, admitted FROM f", ORDERED_SQL,
    """f AS (SELECT sensor_type, k, seq, ts_ms, true AS admitted, 4e0 AS tokens FROM o WHERE k = 1
  UNION ALL SELECT sensor_type, k, seq, ts_ms, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END FROM (
    SELECT o.sensor_type, o.k, o.seq, o.ts_ms, least(5e0, f.tokens + greatest(0, o.ts_ms - f.ts_ms) * 0.0005e0 / 1000e0) AS have FROM f JOIN o ON o.sensor_type = f.sensor_type AND o.k = f.k + 1))""").replace("WITH r AS", "WITH RECURSIVE r AS"))
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).select("seq", "sensor_type", "ts_ms")
    return flow.rate_limited(r, 0.0005, 5, ("sensor_type",)).select("seq", "sensor_type", "admitted")


@query(with_readings(f"""SELECT sensor_id, sensor_type, ts_ms AS silent_from_ms, gap_ms, closed FROM (
  SELECT *, lead(ts_ms) OVER w IS NOT NULL AS closed, coalesce(lead(ts_ms) OVER w, max(ts_ms) OVER ()) - ts_ms AS gap_ms FROM r {W}) WHERE gap_ms > 259200000"""))
def sensor_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).transform(stages.silences(259_200_000, trailing=True))


@query(with_readings(f"""SELECT event_kind, seq, sensor_id, sensor_type, v AS value, q AS quality, details AS system_details FROM (
  SELECT 'sensor_reading' AS event_kind, seq, sensor_id, sensor_type, CASE WHEN rec THEN good ELSE value END AS v, CASE WHEN rec THEN 0.5 ELSE quality END AS q, CAST(NULL AS BIGINT) AS details FROM islands
  UNION ALL SELECT 'system_event', seq, sensor_id, sensor_type, NULL, NULL, CAST(run AS BIGINT) FROM islands WHERE bad = 1 AND run >= 3)""",
  f"""islands AS (SELECT *, bad = 1 AND good IS NOT NULL AND run >= 3 AS rec FROM (SELECT *, sum(bad) OVER (PARTITION BY sensor_id, sensor_type, island ORDER BY ts_ms, seq) AS run FROM (
    SELECT *, CASE WHEN quality < 0.6 THEN 1 ELSE 0 END AS bad, sum(CASE WHEN quality < 0.6 THEN 0 ELSE 1 END) OVER w AS island,
      last_value(CASE WHEN quality > 0.7 THEN value END IGNORE NULLS) OVER w AS good FROM r {W})))"""))
def recovery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sensor_readings(spark, sf_dir).transform(stages.recovery_events(F.col("quality") < 0.6, 3))
    return df.select("event_kind", "seq", "sensor_id", "sensor_type", "value", "quality", "system_details")
