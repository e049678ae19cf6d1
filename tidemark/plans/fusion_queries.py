"""Queries over fusion and anomaly detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregate as A
from tidemark.operators import forest
from tidemark.operators import fusion as U
from tidemark.plans.functions_queries import dew_sql
from tidemark.plans.readings import sensor_readings, with_readings

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WINDOW = 24 * 3_600_000
KINDS = ("voc", "humidity", "vibration")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


LATEST_SQL = f"""latest AS (SELECT *, row_number() OVER (ORDER BY base_ts_ms) AS n FROM (
  SELECT CAST(floor(ts_ms / {WINDOW}) AS BIGINT) * {WINDOW} AS base_ts_ms, arg_max(value, seq) FILTER (sensor_type = 'voc') AS voc,
    arg_max(value, seq) FILTER (sensor_type = 'humidity') AS humidity, arg_max(value, seq) FILTER (sensor_type = 'vibration') AS vibration
  FROM r WHERE sensor_type IN ('voc', 'humidity', 'vibration') GROUP BY 1))"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row a day, so the running number is over few rows.
    return U.numbered(U.latest_by_type(sensor_readings(spark, sf_dir), KINDS, WINDOW), "base_ts_ms")


@query(with_readings("""SELECT base_ts_ms, round(e, 6) AS estimate, round(k / 3.0 * least(n / 10.0, 1.0) * CASE WHEN k = 1 THEN 0.5 ELSE 1 / (1 + s / w) END, 6) AS confidence FROM (
  SELECT *, coalesce(4 * pow(voc - e, 2), 0) + coalesce(2 * pow(humidity - e, 2), 0) + coalesce(pow(vibration - e, 2), 0) AS s FROM (
    SELECT *, (coalesce(4 * voc, 0) + coalesce(2 * humidity, 0) + coalesce(vibration, 0)) / w AS e FROM (
      SELECT *, CASE WHEN voc IS NULL THEN 0 ELSE 4.0 END + CASE WHEN humidity IS NULL THEN 0 ELSE 2.0 END + CASE WHEN vibration IS NULL THEN 0 ELSE 1.0 END AS w,
        CASE WHEN voc IS NULL THEN 0 ELSE 1 END + CASE WHEN humidity IS NULL THEN 0 ELSE 1 END + CASE WHEN vibration IS NULL THEN 0 ELSE 1 END AS k FROM latest)))""", LATEST_SQL))
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.weighted(F.array(*KINDS), F.array(F.lit(4.0), F.lit(2.0), F.lit(1.0)), F.col("n"))
    return _latest(spark, sf_dir).select("base_ts_ms", F.round(found["estimate"], 6).alias("estimate"), F.round(found["confidence"], 6).alias("confidence"))


VOTES_SQL = """votes AS (SELECT base_ts_ms, n, count(v) AS active, avg(v) AS m, stddev_pop(v) AS sd FROM (
  SELECT base_ts_ms, n, unnest([voc, humidity, vibration]) AS v FROM latest) GROUP BY 1, 2)"""


@query(with_readings("""SELECT base_ts_ms, CASE WHEN votes >= 2 THEN round(total / votes, 6) END AS estimate, votes, round(CASE WHEN votes >= 2 THEN votes * 1.0 / active * least(n / 10.0, 1.0) ELSE 0.0 END, 6) AS confidence,
  round(m, 6) AS simple_average FROM (
  SELECT l.base_ts_ms, l.n, active, any_value(m) AS m, count(*) FILTER (abs(l.v - m) <= 1.2 * sd + 1e-12) AS votes, sum(l.v) FILTER (abs(l.v - m) <= 1.2 * sd + 1e-12) AS total
  FROM (SELECT base_ts_ms, n, unnest([voc, humidity, vibration]) AS v FROM latest) l JOIN votes USING (base_ts_ms) GROUP BY 1, 2, 3)""", LATEST_SQL, VOTES_SQL))
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*KINDS)
    found = U.consensus(values, F.col("n"), sigmas=1.2)
    return _latest(spark, sf_dir).select(
        "base_ts_ms", F.round(found["estimate"], 6).alias("estimate"), found["votes"].alias("votes"), F.round(found["confidence"], 6).alias("confidence"),
        F.round(U.simple_average(values)["estimate"], 6).alias("simple_average"),
    )


@query(with_readings("""SELECT base_ts_ms, round(0.02 * voc + 0.98 * humidity, 6) AS estimate,
  round(CASE WHEN abs(voc - humidity) < 0.1 THEN 1.0 WHEN abs(voc - humidity) < 1 THEN 1 - (abs(voc - humidity) - 0.1) * 0.1 ELSE 0.5 END, 6) AS confidence,
  'Valid' AS status FROM latest WHERE voc IS NOT NULL AND humidity IS NOT NULL""", LATEST_SQL))
def complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.complementary(F.col("voc"), F.col("humidity"))
    df = _latest(spark, sf_dir).where("voc is not null and humidity is not null")
    return df.select("base_ts_ms", F.round(found["estimate"], 6).alias("estimate"), F.round(found["confidence"], 6).alias("confidence"), U.fusion_status(found["confidence"]).alias("status"))


@query(with_readings("""SELECT sensor_id, sensor_type, round(x, 6) AS estimate, round(p, 9) AS variance, k AS updates,
  round(CASE WHEN p < 0.1 THEN 1.0 WHEN p < 1 THEN 0.9 - 0.4 * (p - 0.1) ELSE 0.5 / p END * least(k / 10.0, 1.0), 6) AS confidence
FROM f WHERE k = total""",
    "o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq) AS k, count(*) OVER (PARTITION BY sensor_id, sensor_type) AS total FROM r)",
    """f AS (SELECT sensor_id, sensor_type, k, total, (1.01 / 1.02) * value AS x, pow(1 - 1.01 / 1.02, 2) * 1.01 + pow(1.01 / 1.02, 2) * 0.01 AS p FROM o WHERE k = 1
  UNION ALL SELECT o.sensor_id, o.sensor_type, o.k, o.total, f.x + (f.p + 0.01) / (f.p + 0.02) * (o.value - f.x),
    pow(1 - (f.p + 0.01) / (f.p + 0.02), 2) * (f.p + 0.01) + pow((f.p + 0.01) / (f.p + 0.02), 2) * 0.01
  FROM f JOIN o ON o.sensor_id = f.sensor_id AND o.sensor_type = f.sensor_type AND o.k = f.k + 1)""").replace("WITH r AS", "WITH RECURSIVE r AS").replace("(1.01 / 1.02)", "(1.01e0 / 1.02e0)").replace("1 - 1.01 / 1.02", "1 - 1.01e0 / 1.02e0").replace("pow(1.01 / 1.02", "pow(1.01e0 / 1.02e0"))
def kalman_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = U.kalman_scalar(sensor_readings(spark, sf_dir))
    return k.select("sensor_id", "sensor_type", F.round("estimate", 6).alias("estimate"), F.round("variance", 9).alias("variance"), "updates", F.round("confidence", 6).alias("confidence"))


GROUPS = [
    U.Group("weighted", ("s1", "s2", "s3"), weights={"s1": 4.0, "s2": 2.0}), U.Group("vote", ("s4", "s5", "s6", "s7"), "consensus"),
    U.Group("filter", ("s8", "s9"), "kalman", r=0.25), U.Group("plain", ("s1", "s9"), "average", interval_ms=86_400_000),
]


def _group_sql(g: U.Group) -> tuple[list[str], str]:
    """(common tables, rows) of one group: last values by window, which rows fuse by a recursion over the group's rows, then the estimate."""
    t, m = g.name, len(g.sensors)
    names = ", ".join(f"'{x}'" for x in g.sensors)
    last = ", ".join(f"last_value(CASE WHEN sensor_id = '{x}' THEN value END IGNORE NULLS) OVER w AS l{i}" for i, x in enumerate(g.sensors))
    values = "[" + ", ".join(f"l{i}" for i in range(m)) + "]"
    heard = f"list_filter({values}, lambda v: v IS NOT NULL)"
    state = "CASE WHEN fire THEN {} ELSE {} END"
    rows = f"""{t}_rows AS (SELECT *, len(z) AS n_z, list_sum(z) AS sum_z FROM (SELECT ts_ms, seq, row_number() OVER (ORDER BY ts_ms, seq) AS k, {heard} AS z, {", ".join(f"l{i}" for i in range(m))}
  FROM (SELECT *, {last} FROM r WHERE sensor_id IN ({names}) AND value IS NOT NULL WINDOW w AS (ORDER BY ts_ms, seq))))"""
    ready = f"len(z) >= {g.min_sensors}"
    gain = f"((p + {g.q!r}e0) / ({g.r!r}e0 + n_z * (p + {g.q!r}e0)))"
    spread = f"(pow(1 - n_z * {gain}, 2) * (p + {g.q!r}e0) + n_z * {gain} * {gain} * {g.r!r}e0)"
    fold = f"""{t}_fold AS (SELECT k, false AS fire, CAST(NULL AS BIGINT) AS fused_at, CAST(0 AS BIGINT) AS n, 0e0 AS x, 1e0 AS p FROM (SELECT 0 AS k)
  UNION ALL SELECT k, fire, {state.format("ts_ms", "fused_at")}, n + {state.format("1", "0")}, {state.format(f"x + {gain} * (sum_z - n_z * x)", "x")}, {state.format(spread, "p")} FROM (
    SELECT o.k, o.ts_ms, o.n_z, o.sum_z, f.n, f.x, f.p, f.fused_at, (f.fused_at IS NULL OR o.ts_ms - f.fused_at >= {g.interval_ms}) AND {ready} AS fire FROM {t}_fold f JOIN {t}_rows o ON o.k = f.k + 1))"""
    w = [g.weights.get(x, 1.0) for x in g.sensors]
    total = " + ".join(f"CASE WHEN l{i} IS NULL THEN 0e0 ELSE {w[i]!r}e0 END" for i in range(m))
    mean = f"((" + " + ".join(f"coalesce({w[i]!r}e0 * l{i}, 0e0)" for i in range(m)) + f") / ({total}))"
    around = f"((" + " + ".join(f"coalesce({w[i]!r}e0 * pow(l{i} - {mean}, 2), 0e0)" for i in range(m)) + f") / ({total}))"
    growth = "least(n / 10e0, 1e0)"
    votes = "list_filter(z, lambda v: abs(v - list_avg(z)) <= 3 * list_stddev_pop(z) + 1e-12)"
    found = {
        "average": ("sum_z / n_z", "0.8e0"),
        "consensus": (f"CASE WHEN len({votes}) >= 2 THEN list_avg({votes}) ELSE 0e0 END", f"CASE WHEN len({votes}) >= 2 THEN len({votes}) / CAST(n_z AS DOUBLE) * {growth} ELSE 0e0 END"),
        "kalman": ("x", f"CASE WHEN p < 0.1 THEN 1e0 WHEN p < 1 THEN 0.9e0 - 0.4e0 * (p - 0.1e0) ELSE 0.5e0 / p END * {growth}"),
        "weighted": (mean, f"n_z / {m}e0 * {growth} * CASE WHEN n_z = 1 THEN 0.5e0 ELSE 1 / (1 + {around}) END"),
    }[g.method]
    body = f"SELECT '{t}' AS group_name, ts_ms, seq, round({found[0]}, 6) AS estimate, round({found[1]}, 6) AS confidence FROM {t}_fold f JOIN {t}_rows o USING (k) WHERE f.fire"
    return [rows, fold], body


def _groups_sql(groups: list[U.Group]) -> str:
    parts = [_group_sql(g) for g in groups]
    return with_readings("\nUNION ALL ".join(body for _, body in parts), *[t for tables, _ in parts for t in tables]).replace("WITH r AS", "WITH RECURSIVE r AS")


@query(_groups_sql(GROUPS))
def fusion_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = U.fuse(sensor_readings(spark, sf_dir), GROUPS)
    return fused.select("group_name", "ts_ms", "seq", F.round("estimate", 6).alias("estimate"), F.round("confidence", 6).alias("confidence"))


def _confidence_sql(trace: str) -> str:
    return f"round(CASE WHEN {trace} < 0.1 THEN 1e0 WHEN {trace} < 1 THEN 0.9e0 - 0.4e0 * ({trace} - 0.1e0) ELSE 0.5e0 / ({trace}) END * least(n / 10e0, 1e0), 6) AS confidence"


def _filtered(df: DataFrame, *more: str) -> DataFrame:
    states = [F.round(F.get("state", F.lit(i)), 6).alias(f"x{i}") for i in range(3)]
    spread = [F.round(F.get("variances", F.lit(i)), 6).alias(f"p{i}") for i in range(3)]
    return df.select("seq", *states, *spread, F.round("confidence", 6).alias("confidence"), "converged", *more)


BY_SENSOR_SQL = "o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts_ms, seq) AS k FROM r)"


# Two states, position and speed, of which the first is measured; the noise is that of a constant acceleration over a step of 0.5.
@query(with_readings(f"""SELECT seq, round(x0, 6) AS x0, round(x1, 6) AS x1, CAST(NULL AS DOUBLE) AS x2, round(a, 6) AS p0, round(c, 6) AS p1, CAST(NULL AS DOUBLE) AS p2, {_confidence_sql('a + c')},
  n >= 5 AND greatest(a, c) < 0.01 AS converged FROM f WHERE k > 0""", BY_SENSOR_SQL,
    """f AS (SELECT sensor_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, 0e0 AS x0, 0e0 AS x1, 1e0 AS a, 0e0 AS b, 1e0 AS c FROM o WHERE k = 1
  UNION ALL SELECT sensor_id, k, seq, n + 1, y0 + a / (a + 0.04e0) * (z - y0), x1 + b / (a + 0.04e0) * (z - y0), pow(1 - a / (a + 0.04e0), 2) * a + pow(a / (a + 0.04e0), 2) * 0.04e0,
    (1 - a / (a + 0.04e0)) * (b - b / (a + 0.04e0) * a) + a / (a + 0.04e0) * b / (a + 0.04e0) * 0.04e0, c - 2 * b / (a + 0.04e0) * b + pow(b / (a + 0.04e0), 2) * (a + 0.04e0) FROM (
    SELECT o.sensor_id, o.k, o.seq, o.quality AS z, f.n, f.x0 + 0.5e0 * f.x1 AS y0, f.x1, f.a + 2 * 0.5e0 * f.b + 0.25e0 * f.c + 0.01e0 * 0.015625e0 AS a, f.b + 0.5e0 * f.c + 0.01e0 * 0.0625e0 AS b, f.c + 0.01e0 * 0.25e0 AS c
    FROM f JOIN o ON o.sensor_id = f.sensor_id AND o.k = f.k + 1))""").replace("WITH r AS", "WITH RECURSIVE r AS"))
def kalman_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(U.filtered(sensor_readings(spark, sf_dir), lambda: U.KalmanFilter.constant_velocity(0.5, 0.01, 0.04), ("quality",), ("sensor_id",)))


def _one_state_sql(i: int, name: str) -> tuple[str, str]:
    p = f"(f.p{i} + 0.01e0)"
    gain = f"({p} / ({p} + 0.1e0))"
    return f"CASE WHEN o.{name} IS NULL THEN f.x{i} ELSE f.x{i} + {gain} * (o.{name} - f.x{i}) END", f"CASE WHEN o.{name} IS NULL THEN {p} ELSE pow(1 - {gain}, 2) * {p} + pow({gain}, 2) * 0.1e0 END"


@query(with_readings(f"""SELECT base_ts_ms AS seq, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, {_confidence_sql('p0 + p1 + p2')},
  n >= 5 AND greatest(p0, p1, p2) < 0.01 AS converged FROM f WHERE n > 0""", LATEST_SQL,
    f"""f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS base_ts_ms, 0e0 AS x0, 0e0 AS x1, 0e0 AS x2, 1e0 AS p0, 1e0 AS p1, 1e0 AS p2
  UNION ALL SELECT o.n, o.base_ts_ms, {', '.join(x for x, _ in map(_one_state_sql, range(3), KINDS))}, {', '.join(p for _, p in map(_one_state_sql, range(3), KINDS))} FROM f JOIN latest o ON o.n = f.n + 1)""").replace("WITH r AS", "WITH RECURSIVE r AS"))
def kalman_three_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = U.latest_by_type(sensor_readings(spark, sf_dir), KINDS, WINDOW).select(F.lit("all").alias("place"), F.col("base_ts_ms").alias("ts_ms"), F.col("base_ts_ms").alias("seq"), *KINDS)
    return _filtered(U.filtered(latest, lambda: U.KalmanFilter.of_size(3, 3, q=0.01, r=0.1), KINDS, ("place",)))


# Temperature, ambient and rate of exchange; the covariance is symmetric, so six of its nine numbers are carried.
@query(with_readings(f"""SELECT seq, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, round(p00, 6) AS p0, round(p11, 6) AS p1, round(p22, 6) AS p2, {_confidence_sql('p00 + p11 + p22')},
  n >= 5 AND greatest(p00, p11, p22) < 0.01 AS converged FROM f WHERE n > 0""",
    "o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts_ms, seq) AS k FROM r WHERE sensor_type = 'temperature')",
    """f AS (SELECT sensor_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 25e0 AS x0, 20e0 AS x1, 0.1e0 AS x2, 1e0 AS p00, 0e0 AS p01, 0e0 AS p02, 4e0 AS p11, 0e0 AS p12, 0.01e0 AS p22 FROM o WHERE k = 1
  UNION ALL SELECT sensor_id, n + 1, seq, y0 + k0 * (z - y0), x1 + k1 * (z - y0), x2 + k2 * (z - y0), pow(1 - k0, 2) * p00 + k0 * k0 * 0.25e0, (1 - k0) * (p01 - k1 * p00) + k0 * k1 * 0.25e0,
    (1 - k0) * (p02 - k2 * p00) + k0 * k2 * 0.25e0, p11 - 2 * k1 * p01 + k1 * k1 * (p00 + 0.25e0), p12 - k1 * p02 - k2 * p01 + k1 * k2 * (p00 + 0.25e0), p22 - 2 * k2 * p02 + k2 * k2 * (p00 + 0.25e0) FROM (
    SELECT *, p00 / (p00 + 0.25e0) AS k0, p01 / (p00 + 0.25e0) AS k1, p02 / (p00 + 0.25e0) AS k2 FROM (
      SELECT sensor_id, n, seq, z, x0 - x2 * (x0 - x1) * 0.1e0 AS y0, x1, x2, a * a * p00 + b * b * p11 + c * c * p22 + 2 * a * b * p01 + 2 * a * c * p02 + 2 * b * c * p12 + 0.01e0 AS p00,
        a * p01 + b * p11 + c * p12 AS p01, a * p02 + b * p12 + c * p22 AS p02, p11 + 0.001e0 AS p11, p12, p22 + 0.0001e0 AS p22 FROM (
        SELECT f.*, o.seq AS at, o.value AS z, 1 - f.x2 * 0.1e0 AS a, f.x2 * 0.1e0 AS b, -(f.x0 - f.x1) * 0.1e0 AS c FROM f JOIN o ON o.sensor_id = f.sensor_id AND o.k = f.n + 1) s(sensor_id, n, old_seq, x0, x1, x2, p00, p01, p02, p11, p12, p22, seq, z, a, b, c)))
  )""").replace("WITH r AS", "WITH RECURSIVE r AS"))
def ekf_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'")
    return _filtered(U.filtered(r, lambda: U.temperature_model(0.5), ("value",), ("sensor_id",), fixed_dt=0.1))


@query(with_readings("""SELECT seq, round(mean, 6) AS mean, min, max, round(sd, 6) AS std_dev, round(CASE WHEN span > 0 THEN (value - first) * 1000.0 / span ELSE 0.0 END, 9) AS rate_of_change, count FROM (
  SELECT seq, value, avg(value) OVER w AS mean, min(value) OVER w AS min, max(value) OVER w AS max, stddev_pop(value) OVER w AS sd, first_value(value) OVER w AS first, ts_ms - first_value(ts_ms) OVER w AS span, count(value) OVER w AS count
  FROM r WINDOW w AS (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""))
def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forest.running_features(sensor_readings(spark, sf_dir))
    return f.select("seq", F.round("mean", 6).alias("mean"), "min", "max", F.round("std_dev", 6).alias("std_dev"), F.round("rate_of_change", 9).alias("rate_of_change"), "count")


def _pivot_sql(kind: str, p: str) -> str:
    return ", ".join(f"max({c}) FILTER (sensor_type = '{kind}') AS {p}_{c}" for c in ("mean", "variance", "std_dev", "slope"))


@query(with_readings(f"""SELECT base_ts_ms, round(margin, 6) AS dew_point_margin, round(CASE WHEN t_mean = 0 THEN 0.0 ELSE margin / abs(t_mean) END, 6) AS dew_point_depression,
  round(CASE WHEN h_variance > 0 THEN t_variance / h_variance WHEN h_variance IS NOT NULL THEN 1.0 END, 6) AS variance_ratio,
  CASE WHEN abs(t_slope) > 0.01 AND abs(h_slope) > 0.01 THEN CASE WHEN (t_slope > 0) = (h_slope > 0) THEN 1e0 ELSE -1e0 END WHEN t_slope IS NOT NULL AND h_slope IS NOT NULL THEN 0e0 END AS trend_alignment,
  round(p_mean / 1013.25, 6) AS normalized_pressure, round(abs(p_mean - 1013.25) / 1013.25, 6) AS pressure_deviation, round(1 / (p_std_dev + 1), 6) AS pressure_stability,
  round(t_mean / (p_mean / 10), 6) AS temperature_pressure_ratio, round(1 / (t_std_dev + h_std_dev + p_std_dev + 1), 6) AS combined_stability
FROM (SELECT *, t_mean - {dew_sql('t_mean', 'h_mean')} AS margin FROM (SELECT base_ts_ms, {_pivot_sql('temperature', 't')}, {_pivot_sql('humidity', 'h')}, {_pivot_sql('pressure', 'p')} FROM (
  SELECT sensor_type, CAST(floor(ts_ms / {WINDOW}) AS BIGINT) * {WINDOW} AS base_ts_ms, avg(value) AS mean, var_pop(value) AS variance, stddev_pop(value) AS std_dev, coalesce(regr_slope(value, t), 0.0) AS slope
  FROM (SELECT *, ts_ms / 1000.0 - min(ts_ms) OVER (PARTITION BY sensor_type, floor(ts_ms / {WINDOW})) / 1000.0 AS t FROM r WHERE sensor_type IN ('temperature', 'humidity', 'pressure')) GROUP BY 1, 2) GROUP BY 1))"""))
def ml_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).where(F.col("sensor_type").isin("temperature", "humidity", "pressure"))
    stats = A.sensor_stats(r.withColumn("base_ts_ms", F.floor(F.col("ts_ms") / WINDOW) * WINDOW), ("sensor_type", "base_ts_ms"))
    names = ("mean", "variance", "std_dev", "trend_slope")
    of = lambda kind, c: F.max(F.when(F.col("sensor_type") == kind, F.col(c))).alias(f"{kind}_{c}")
    wide = stats.groupBy("base_ts_ms").agg(*[of(k, c) for k in ("temperature", "humidity", "pressure") for c in names])
    t, rh, p = ({c: F.col(f"{k}_{c}") for c in names} for k in ("temperature", "humidity", "pressure"))
    found = forest.correlation_features(t, rh, p)
    return wide.select("base_ts_ms", *[c.alias(n) if n == "trend_alignment" else F.round(c, 6).alias(n) for n, c in found.items()])


def _frozen_forest(features: int, low: float, high: float) -> forest.IsolationForest:
    """A forest over numbers drawn evenly between two bounds by the generator, the same everywhere."""
    rng = forest.Lcg(7)
    x = [[low + (high - low) * rng.uniform() for _ in range(features)] for _ in range(256)]
    return forest.IsolationForest(trees=4, depth=5).fit(np.array(x))


def _forest_sql(model: forest.IsolationForest, names: tuple[str, ...]) -> str:
    def path(nodes: list[tuple], at: int, depth: int) -> str:
        feature, split, left, right = nodes[at]
        if feature < 0:
            return f"{depth + forest.path_length(int(split))!r}e0"
        return f"CASE WHEN {names[feature]} < {float(split)!r} THEN {path(nodes, left, depth + 1)} ELSE {path(nodes, right, depth + 1)} END"

    total = " + ".join(path(nodes, 0, 0) for nodes in model.nodes)
    return f"pow(2e0, -({total}) / {len(model.nodes)}e0 / {forest.path_length(model.used)!r}e0)"


READING_FOREST, VECTOR_FOREST = _frozen_forest(len(forest.BASIC), -20, 120), _frozen_forest(4, -0.4, 0.4)


@query(with_readings(f"""SELECT seq, sensor_type, round(s, 6) AS anomaly_score, s > 0.6 AS is_anomaly, CASE WHEN s > 0.6 THEN CAST(floor(s * 1000) AS BIGINT) END AS system_details FROM (
  SELECT seq, sensor_type, {_forest_sql(READING_FOREST, tuple('f_' + x for x in forest.BASIC))} AS s FROM (
    SELECT seq, sensor_type, avg(value) OVER w AS f_mean, min(value) OVER w AS f_min, max(value) OVER w AS f_max, stddev_pop(value) OVER w AS f_std_dev,
      CASE WHEN ts_ms - first_value(ts_ms) OVER w > 0 THEN (value - first_value(value) OVER w) * 1000.0 / (ts_ms - first_value(ts_ms) OVER w) ELSE 0.0 END AS f_rate_of_change
    FROM r WHERE sensor_type IN ('temperature', 'humidity', 'pressure') AND quality >= 0.5 WINDOW w AS (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)))"""))
def isolation_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest.anomaly_stage(sensor_readings(spark, sf_dir), forest=READING_FOREST)
    return found.select("seq", "sensor_type", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "system_details")


@query(f"""SELECT vec_id, round(s, 6) AS score, round(-log2(s) * {forest.path_length(VECTOR_FOREST.used)!r}e0, 5) AS path_length, 4 AS trees, 0.04e0 AS confidence FROM (
  SELECT vec_id, {_forest_sql(VECTOR_FOREST, ('f0', 'f1', 'f2', 'f3'))} AS s FROM (
    SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}' for i in range(4))} FROM embeddings))""")
def isolation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"f{i}" for i in range(4)]
    df = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    scored = forest.score_forest(df, VECTOR_FOREST, names).select("vec_id", forest.score_details(F.col("anomaly_score"), VECTOR_FOREST).alias("_s"))
    return scored.select("vec_id", F.round("_s.score", 6).alias("score"), F.round("_s.path_length", 5).alias("path_length"), "_s.trees", "_s.confidence")


@query(with_readings("""SELECT seq, median, round(variance, 6) AS variance, round(rms, 6) AS rms, crossings AS zero_crossings, peaks AS peak_count, round(slope, 6) AS trend_slope, round(skew, 5) AS skewness, count FROM (
  SELECT a.seq, median(b.value) AS median, var_pop(b.value) AS variance, sqrt(avg(b.value * b.value)) AS rms, count(*) AS count,
    CAST(count(*) FILTER (b.i > a.low AND (b.before - m.mean) * (b.value - m.mean) < 0) AS INTEGER) AS crossings, CAST(count(*) FILTER (b.i > a.low AND b.i < a.i AND b.value > b.before AND b.value > b.after) AS INTEGER) AS peaks,
    coalesce(CASE WHEN count(*) > 1 THEN regr_slope(b.value, (b.ts_ms - m.first_ts) / 1000.0) END, 0e0) AS slope,
    coalesce(CASE WHEN var_pop(b.value) > 0 THEN avg(pow(b.value - m.mean, 3)) / pow(stddev_pop(b.value), 3) END, 0e0) AS skew
  FROM n a JOIN m ON m.seq = a.seq JOIN n b ON b.sensor_id = a.sensor_id AND b.sensor_type = a.sensor_type AND b.i BETWEEN a.low AND a.i GROUP BY a.seq)""",
  """n AS (SELECT *, greatest(i - 7, 1) AS low FROM (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS before, lead(value) OVER w AS after FROM r WINDOW w AS (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq)))""",
  """m AS (SELECT seq, avg(value) OVER w AS mean, first_value(ts_ms) OVER w AS first_ts FROM r WINDOW w AS (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""))
def ml_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forest.running_features(sensor_readings(spark, sf_dir), 8, forest.FULL)
    return f.select(
        "seq", "median", F.round("variance", 6).alias("variance"), F.round("rms", 6).alias("rms"), "zero_crossings", "peak_count", F.round("trend_slope", 6).alias("trend_slope"),
        F.round("skewness", 5).alias("skewness"), "count",
    )


@query()
def isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.anomaly_stage(sensor_readings(spark, sf_dir), train_rows=256, threshold=0.6)


@query()
def isolation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"v{i}" for i in range(8)]
    df = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    model = forest.fit_forest(df, names, ["vec_id"], rows=256)
    return forest.score_forest(df, model, names).select("vec_id", "anomaly_score", "is_anomaly")


@query(with_readings("""SELECT seq, round(coalesce(slope, 0.0), 6) AS trend, round(recent, 6) AS recent_average, round(coalesce(slope, 0.0), 9) > 0.01 AS increasing FROM (
  SELECT seq, CASE WHEN count(*) OVER w > 1 THEN regr_slope(quality, i) OVER w END AS slope, avg(quality) OVER w AS recent FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY sensor_id ORDER BY ts_ms, seq) AS DOUBLE) AS i FROM r)
  WINDOW w AS (PARTITION BY sensor_id ORDER BY ts_ms, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""))
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = forest.score_history(sensor_readings(spark, sf_dir), "quality", ("sensor_id",))
    return h.select("seq", F.round("trend", 6).alias("trend"), F.round("recent_average", 6).alias("recent_average"), (F.round("trend", 9) > 0.01).alias("increasing"))


@query(with_readings("SELECT sensor_id, round(x, 6) AS ema FROM f WHERE k = total",
    "o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts_ms, seq) AS k, count(*) OVER (PARTITION BY sensor_id) AS total FROM r)",
    """f AS (SELECT sensor_id, k, total, 0.5e0 + 0.1e0 * (quality - 0.5e0) AS x FROM o WHERE k = 1
  UNION ALL SELECT o.sensor_id, o.k, o.total, f.x + 0.1e0 * (o.quality - f.x) FROM f JOIN o ON o.sensor_id = f.sensor_id AND o.k = f.k + 1)""").replace("WITH r AS", "WITH RECURSIVE r AS"))
def score_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = forest.exponential_average(sensor_readings(spark, sf_dir), "quality", ("sensor_id",))
    return e.select("sensor_id", F.round("ema", 6).alias("ema"))

