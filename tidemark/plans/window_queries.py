"""Queries over windowed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import events
from tidemark.operators import aggregate as A
from tidemark.operators import validators as V
from tidemark.plans.readings import sensor_readings, with_readings
from tidemark.plans.validator_queries import LIMITS, RATED_SQL, STATUS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000
METHOD_SQL = {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "stddev": "coalesce(stddev_samp(value), 0.0)", "median": "median(value)"}


def batch_sql(name: str) -> str:
    return f"""count(*) AS count, CAST(CASE WHEN count(*) > 1 THEN floor((max(ts_ms) - min(ts_ms)) / (count(*) - 1)) ELSE 0 END AS BIGINT) AS interval_ms,
  round({METHOD_SQL[name]}, 6) AS result_value, min(value) AS min_value, max(value) AS max_value"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("result_value", F.round("result_value", 6))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _tumbling(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(A.tumbling(sensor_readings(spark, sf_dir), 24 * HOUR, name))

    return run


for _name in A.METHODS:
    QUERIES[f"tumbling_{_name}"] = _tumbling(_name)
    ORACLE_SQL[f"tumbling_{_name}"] = with_readings(f"SELECT sensor_type, CAST(floor(ts_ms / {24 * HOUR}) AS BIGINT) * {24 * HOUR} AS base_ts_ms, {batch_sql(_name)} FROM r GROUP BY 1, 2")


@query(with_readings(f"""SELECT sensor_type, CAST(floor(ts_ms / {HOUR}) AS BIGINT) * {HOUR} AS base_ts_ms, count(*) AS n, sum(CASE WHEN status = 'Valid' THEN 1 ELSE 0 END) AS n_valid,
  round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value, round(coalesce(stddev_samp(value), 0.0), 6) AS stddev_value FROM checked GROUP BY 1, 2""", RATED_SQL, STATUS_SQL))
def hourly_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.validate_all(sensor_readings(spark, sf_dir), LIMITS)
    start = (F.floor(F.col("ts_ms") / HOUR) * HOUR).alias("base_ts_ms")
    return checked.groupBy("sensor_type", start).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("status") == "Valid", 1).otherwise(0)).alias("n_valid"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stddev_value"),
    )


@query(with_readings(f"""SELECT sensor_id, sensor_type, window_no, min(ts_ms) AS base_ts_ms, {batch_sql('mean')}
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq) - 1) / 5) AS BIGINT) AS window_no FROM r) GROUP BY 1, 2, 3"""))
def count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.count_windows(sensor_readings(spark, sf_dir), 5))


@query(with_readings(f"""SELECT sensor_type, window_no, min(ts_ms) AS base_ts_ms, {batch_sql('sum')}
FROM (SELECT *, CAST(floor(k / 21) AS BIGINT) AS window_no FROM (SELECT *, row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) - 1 AS k, count(*) OVER (PARTITION BY sensor_type) AS total FROM r))
WHERE k % 21 < 20 AND (window_no + 1) * 21 <= total GROUP BY 1, 2"""))
def count_window_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.count_windows(sensor_readings(spark, sf_dir), 20, "sum", ("sensor_type",), lossy=True))


# Windows are numbered by a recursion over each sensor's readings in order; a window is full at ``most`` readings.
def _anchored_sql(most: int | None, lossy: bool, name: str) -> str:
    full = f"f.held = {most}" if most else "false"
    ended = f"o.ts_ms - f.start >= {24 * HOUR}"
    dropped = f"NOT ({full}) AND {ended}" if lossy else "false"
    body = f"""SELECT sensor_id, sensor_type, start AS base_ts_ms, {batch_sql(name)} FROM (SELECT *, max(number) OVER (PARTITION BY sensor_id, sensor_type) AS last_number FROM f)
WHERE kept {'AND number < last_number' if lossy else ''} GROUP BY sensor_id, sensor_type, number, start"""
    recursion = f"""f AS (SELECT sensor_id, sensor_type, k, ts_ms, value, CAST(0 AS BIGINT) AS number, 1 AS held, ts_ms AS start, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.sensor_id, o.sensor_type, o.k, o.ts_ms, o.value, f.number + CASE WHEN {full} OR {ended} THEN 1 ELSE 0 END,
    CASE WHEN {dropped} THEN 0 WHEN {full} OR {ended} THEN 1 ELSE f.held + 1 END, CASE WHEN {full} OR {ended} THEN o.ts_ms ELSE f.start END, NOT ({dropped})
  FROM f JOIN o ON o.sensor_id = f.sensor_id AND o.sensor_type = f.sensor_type AND o.k = f.k + 1)"""
    ordered = "o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq) AS k FROM r WHERE value IS NOT NULL)"
    return with_readings(body, ordered, recursion).replace("WITH r AS", "WITH RECURSIVE r AS")


@query(_anchored_sql(None, False, "median"))
def anchored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.anchored(sensor_readings(spark, sf_dir), 24 * HOUR, "median"))


@query(_anchored_sql(100, True, "mean"))
def anchored_window_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.anchored(sensor_readings(spark, sf_dir), 24 * HOUR, "mean", most=100, lossy=True))


@query(_anchored_sql(2, False, "sum"))
def anchored_window_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.anchored(sensor_readings(spark, sf_dir), 24 * HOUR, "sum", most=2))


@query(with_readings(f"""SELECT sensor_type, base_ts_ms, {batch_sql('mean')} FROM (
  SELECT *, unnest(range(CAST(floor(ts_ms / {6 * HOUR}) AS BIGINT) * {6 * HOUR} - {18 * HOUR}, CAST(floor(ts_ms / {6 * HOUR}) AS BIGINT) * {6 * HOUR} + 1, {6 * HOUR})) AS base_ts_ms FROM r) GROUP BY 1, 2"""))
def extra_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sliding(sensor_readings(spark, sf_dir), 24 * HOUR, 6 * HOUR))


@query(with_readings(f"""SELECT sensor_id, sensor_type, CAST(session_no AS BIGINT) AS session_no, min(ts_ms) AS base_ts_ms, {batch_sql('max')} FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq) AS session_no FROM (
    SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq) > {48 * HOUR} THEN 1 ELSE 0 END AS fresh FROM r)) GROUP BY 1, 2, 3"""))
def extra_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sessions(sensor_readings(spark, sf_dir), 48 * HOUR, "max"))


@query(with_readings("""SELECT sensor_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM r GROUP BY 1"""))
def extra_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return sensor_readings(spark, sf_dir).groupBy("sensor_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query(with_readings("SELECT sensor_type, sensor_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM r GROUP BY ROLLUP (sensor_type, sensor_id)"))
def extra_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).rollup("sensor_type", "sensor_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(with_readings("""SELECT sensor_type, count(*) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std_dev, round(median(value), 6) AS median,
  round(var_pop(value), 4) AS variance, round(avg(pow(value - m, 3)) / pow(stddev_pop(value), 3), 6) AS skewness, round(avg(pow(value - m, 4)) / pow(stddev_pop(value), 4) - 3, 6) AS kurtosis,
  round(sqrt(avg(value * value)), 6) AS rms, CAST(sum(CASE WHEN (before - m) * (value - m) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_crossings,
  CAST(sum(CASE WHEN value > before AND value > after THEN 1 ELSE 0 END) AS BIGINT) AS peak_count,
  round((arg_max(value, ts_ms) - arg_min(value, ts_ms)) * 1000.0 / (max(ts_ms) - min(ts_ms)), 9) AS rate_of_change, round(regr_slope(value, t), 9) AS trend_slope
FROM (SELECT *, avg(value) OVER (PARTITION BY sensor_type) AS m, lag(value) OVER w AS before, lead(value) OVER w AS after, ts_ms / 1000.0 - min(ts_ms) OVER (PARTITION BY sensor_type) / 1000.0 AS t FROM r
  WINDOW w AS (PARTITION BY sensor_type ORDER BY ts_ms, seq)) GROUP BY 1"""))
def sensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = {"variance": 4, "rate_of_change": 9, "trend_slope": 9, "count": None, "zero_crossings": None, "peak_count": None, "min": None, "max": None}
    found = A.sensor_stats(sensor_readings(spark, sf_dir), ("sensor_type",))
    return found.select("sensor_type", *[F.col(c) if digits.get(c, 6) is None else F.round(c, digits.get(c, 6)).alias(c) for c in A.STATS])


@query(with_readings(f"""SELECT sensor_type, rows_in, rows_out, round(1 - rows_out * 1.0 / rows_in, 6) AS reduction FROM (
  SELECT sensor_type, count(*) AS rows_in, count(DISTINCT CAST(floor(ts_ms / {24 * HOUR}) AS BIGINT)) AS rows_out FROM r GROUP BY 1)"""))
def bandwidth_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir)
    out = A.tumbling(r, 24 * HOUR).groupBy("sensor_type").agg(F.sum("count").alias("rows_in"), F.count("*").alias("rows_out"))
    return out.withColumn("reduction", F.round(1 - F.col("rows_out") / F.col("rows_in"), 6))


@query(with_readings(f"""SELECT event_kind, sensor_type, count(*) AS n, sum(c) AS counted, round(sum(v), 4) AS total, min(t) AS first_ts_ms FROM (
  SELECT 'sensor_reading' AS event_kind, sensor_type, CAST(NULL AS BIGINT) AS c, value AS v, ts_ms AS t FROM r
  UNION ALL SELECT 'batch_reading', sensor_type, count(*), max(value), CAST(floor(ts_ms / {24 * HOUR}) AS BIGINT) * {24 * HOUR} FROM r GROUP BY sensor_type, 5
  UNION ALL SELECT 'system_event', NULL, 7, NULL, ts_ms FROM r WHERE quality < 0.1) GROUP BY 1, 2"""))
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir)
    everything = events.log(events.readings(r), events.batches(A.tumbling(r, 24 * HOUR)), events.system(r.where("quality < 0.1"), "ValidatorError", F.lit(7)))
    counted = F.coalesce("count", "system_details")
    value = F.coalesce("value", "max_value")
    return everything.groupBy("event_kind", "sensor_type").agg(F.count("*").alias("n"), F.sum(counted).alias("counted"), F.round(F.sum(value), 4).alias("total"), F.min("ts_ms").alias("first_ts_ms"))


@query("""SELECT l_orderkey, l_linenumber, number, CASE WHEN t = 'NaN' OR t = 'Infinity' THEN 'not finite' WHEN number IS NULL THEN 'not a number' END AS problem FROM (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'x1' ELSE CAST(l_linenumber AS VARCHAR) END AS t,
   CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS number FROM lineitem)""")
def number_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 1, "NaN").when(n % 4 == 2, "Infinity").when(n % 4 == 3, "x1").otherwise(n.cast("string"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.alias("text"))
    return api.convert(lines, "text").select("l_orderkey", "l_linenumber", "number", "problem")
