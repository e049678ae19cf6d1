"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import confidence as C
from tidemark.functions import physics, sensors
from tidemark.functions import time as T
from tidemark.functions.sensors import SENSOR_TYPES
from tidemark.plans.readings import READINGS_SQL, sensor_readings, with_readings

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


QUERIES["sensor_readings"] = sensor_readings
ORACLE_SQL["sensor_readings"] = f"WITH {READINGS_SQL} SELECT * FROM r"


@query("SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}', '{u}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for c, n, u, a, b in SENSOR_TYPES) + ") AS t(code, sensor_type, unit, typical_min, typical_max)")
def sensor_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.sensor_dim(spark)


@query(with_readings("""
SELECT seq, octet_length(encode(sensor_id)) BETWEEN 1 AND 15 AS valid_id, quality > 0.8 AS high_quality,
       CASE sensor_type WHEN 'temperature' THEN value BETWEEN -80 AND 125 WHEN 'humidity' THEN value BETWEEN 0 AND 100
            WHEN 'pressure' THEN value BETWEEN 540 AND 1080 ELSE value BETWEEN 0 AND 50 END AS typical,
       CASE WHEN quality * 200 <= 1 THEN quality * 200 WHEN quality * 200 <= 100 THEN quality * 200 / 100 END AS normalized,
       (CAST(seq AS INTEGER) % 8 | 2) AS flags, (CAST(seq AS INTEGER) % 8 & 4) = 4 AS has_cross
FROM r"""))  # fmt: skip
def reading_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir)
    flags = (F.col("seq") % 8).cast("int")
    return r.select(
        "seq", sensors.valid_id(F.col("sensor_id")).alias("valid_id"), sensors.is_high_quality(F.col("quality")).alias("high_quality"),
        sensors.in_typical_range(F.col("sensor_type"), F.col("value")).alias("typical"), sensors.normalize_quality(F.col("quality") * 200).alias("normalized"),
        sensors.set_flag(flags, sensors.RATE).alias("flags"), sensors.has_flag(flags, sensors.CROSS).alias("has_cross"),
    )


@query("""SELECT event_id, CASE upper(event_type) WHEN 'VIEW' THEN 'temperature' WHEN 'CLICK' THEN 'humidity' WHEN 'PURCHASE' THEN 'particulate'
 WHEN 'SIGNUP' THEN 'vibration' END AS sensor_type FROM events""")
def sensor_type_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    alias = F.create_map(*[F.lit(x) for x in ("view", " Temp", "click", "RH", "purchase", "PM2.5", "signup", "accel", "error", "nonsense")])[F.col("event_type")]
    return e.select("event_id", sensors.parse_sensor_type(alias).alias("sensor_type"))


@query(with_readings("""
SELECT kind AS event_kind, status, n, CASE kind WHEN 'system_event' THEN 0 WHEN 'cross_validation_result' THEN 1 WHEN 'validation_result' THEN 2
  WHEN 'sensor_reading' THEN 3 ELSE 4 END AS priority, CASE WHEN kind IN ('validation_result', 'cross_validation_result') THEN status = 'Valid' ELSE true END AS is_valid
FROM (SELECT CASE sensor_type WHEN 'temperature' THEN 'validation_result' WHEN 'humidity' THEN 'cross_validation_result' WHEN 'pressure' THEN 'system_event'
  WHEN 'voc' THEN 'sensor_reading' ELSE 'batch_reading' END AS kind, CASE WHEN quality < 0.5 THEN 'SensorQualityBad' ELSE 'Valid' END AS status, count(*) AS n FROM r GROUP BY 1, 2)"""))
def event_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"temperature": "validation_result", "humidity": "cross_validation_result", "pressure": "system_event", "voc": "sensor_reading", "vibration": "batch_reading"}
    r = sensor_readings(spark, sf_dir).select(
        F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("sensor_type")].alias("event_kind"), F.when(F.col("quality") < 0.5, "SensorQualityBad").otherwise("Valid").alias("status")
    )
    r = r.groupBy("event_kind", "status").agg(F.count("*").alias("n"))
    return r.withColumns({"priority": sensors.event_priority(F.col("event_kind")), "is_valid": sensors.event_is_valid(F.col("event_kind"), F.col("status"))})


DEW = "-38 -25 -18 -13 -9 -7 -5 -3 -2 -1 0".split()
_dew = "[" + ", ".join(DEW) + "]"
DEW_SQL = f"""(greatest(-40.0, least(50.0, T)) + CAST(list_extract({_dew}, CAST(least(floor(P), 9) AS INTEGER) + 1) AS DOUBLE)
  + (list_extract({_dew}, CAST(least(floor(P), 9) AS INTEGER) + 2) - list_extract({_dew}, CAST(least(floor(P), 9) AS INTEGER) + 1)) * (P - least(floor(P), 9)))"""


def dew_sql(t: str, rh: str) -> str:
    p = f"(greatest(0.0, least(100.0, {rh})) / 10)"
    return DEW_SQL.replace("T)", f"{t})").replace("P", p)


@query(with_readings(f"""SELECT seq, round({dew_sql('value', 'quality * 100')}, 6) AS dew_point FROM r WHERE sensor_type = 'temperature'"""))
def dew_point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'")
    return r.select("seq", r6(physics.dew_point_table(F.col("value"), F.col("quality") * 100), "dew_point"))


@query(with_readings("""SELECT seq, CASE WHEN quality <= 0 THEN -100.0 ELSE round(237.7 * g / (17.27 - g), 6) END AS dew_point
FROM (SELECT seq, quality, CASE WHEN quality > 0 THEN ln(quality * 100 / 100) + 17.27 * value / (237.7 + value) END AS g FROM r WHERE sensor_type = 'temperature')"""))
def dew_point_magnus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'")
    return r.select("seq", r6(physics.dew_point_magnus(F.col("value"), F.col("quality") * 100), "dew_point"))


_alt = "[" + ", ".join(str(x) for x in physics.ALTITUDE_HPA) + "]"


@query(f"""SELECT p_partkey, round(a + (b - a) * (p - i), 6) AS adjustment_hpa, round(1013.25 - 12.0 * h / 100, 6) AS expected_hpa,
 round(1013.25 * pow(1 - 0.0065 * h / 288.15, {9.80665 * 0.0289644 / (8.31447 * 0.0065)!r}) - 1013.25, 6) AS standard_hpa
FROM (SELECT *, CAST(list_extract({_alt}, CAST(i AS INTEGER) + 1) AS DOUBLE) AS a, CAST(list_extract({_alt}, CAST(i AS INTEGER) + 2) AS DOUBLE) AS b
 FROM (SELECT *, least(floor(p), 54) AS i FROM (SELECT p_partkey, h, (greatest(-500.0, least(5000.0, h)) + 500) / 100 AS p
  FROM (SELECT p_partkey, p_retailprice * 4 - 1000 AS h FROM part))))""")
def altitude_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("p_retailprice") * 4 - 1000
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", r6(physics.altitude_adjustment(h), "adjustment_hpa"), r6(physics.expected_pressure(h), "expected_hpa"), r6(physics.standard_atmosphere(h), "standard_hpa")
    )


@query(with_readings(f"""SELECT seq, round(288.15 / 0.0065 * (1 - pow(value / 1013.25, {8.31447 * 0.0065 / (9.80665 * 0.0289644)!r})), 4) AS altitude_m,
 round(greatest(300.0, least(1100.0, value + 0.01 * (1013.25 - value) * seq * 1000 / 3600000.0)), 3) AS predicted,
 round((value + 0.02 * (quality * 40 - 20.0)) / pow(1 - 0.0065 * (quality * 1000) / 288.15, 5.255), 3) AS compensated
FROM r WHERE sensor_type = 'pressure'"""))
def pressure_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, v, q = sensor_readings(spark, sf_dir).where("sensor_type = 'pressure'"), F.col("value"), F.col("quality")
    return r.select(
        "seq", F.round(physics.pressure_to_altitude(v), 4).alias("altitude_m"), F.round(physics.pressure_prediction(v, F.col("seq") * 1000), 3).alias("predicted"),
        F.round(physics.compensated_pressure(v, q * 40, q * 1000, 0.02), 3).alias("compensated"),
    )


@query(with_readings("""SELECT seq, round(20.0 + (value - 20.0) * exp(-0.01 * (seq % 1000) * 100 / 1000.0), 6) AS temperature_after,
 round(50.0 + (quality * 100 - 50.0) * CASE WHEN (seq % 200) * 100 / 8000.0 >= 2 THEN 0.1 ELSE exp(-((seq % 200) * 100 / 8000.0)) END, 6) AS humidity_after,
 round(sin(value), 6) AS sine, round(CASE WHEN abs(cos(value)) >= 0.01 THEN tan(value) END, 4) AS tangent FROM r WHERE sensor_type = 'temperature'"""))
def decay_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, v = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'"), F.col("value")
    return r.select(
        "seq", r6(physics.thermal_decay(v, F.col("seq") % 1000 * 100), "temperature_after"), r6(physics.humidity_prediction(F.col("quality") * 100, F.col("seq") % 200 * 100), "humidity_after"),
        r6(F.sin(v), "sine"), F.round(physics.safe_tan(v), 4).alias("tangent"),
    )


@query("""WITH n AS (SELECT p_partkey, CAST(p_partkey % 300 + 1 AS BIGINT) AS n FROM part),
h AS (SELECT p_partkey, n, CASE WHEN n <= 1 THEN 0.0 WHEN n - 1 <= 20 THEN list_sum(list_transform(range(1, n), lambda x: 1.0 / x))
 ELSE ln(CAST(n - 1 AS DOUBLE)) + 0.5772156649015329 + 1 / (2.0 * (n - 1)) END AS h FROM n),
c AS (SELECT p_partkey, n, CASE WHEN n <= 1 THEN 0.0 ELSE 2 * h - 2.0 * (n - 1) / n END AS c FROM h)
SELECT p_partkey, round(c, 6) AS path_length, round(CASE WHEN n <= 1 THEN 0.5 ELSE pow(2.0, -5.0 / c) END, 6) AS score FROM c""")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 300 + 1).cast("long")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", r6(physics.average_path_length(n), "path_length"), r6(physics.anomaly_score(F.lit(5.0), n), "score"))


@query("""SELECT event_id, CASE WHEN d = '' THEN CAST(s AS VARCHAR) || 's' ELSE d END AS text, ok FROM (
 SELECT event_id, s, concat_ws(' ', CASE WHEN s // 86400 > 0 THEN CAST(s // 86400 AS VARCHAR) || 'd' END, CASE WHEN s // 3600 % 24 > 0 THEN CAST(s // 3600 % 24 AS VARCHAR) || 'h' END,
  CASE WHEN s // 60 % 60 > 0 THEN CAST(s // 60 % 60 AS VARCHAR) || 'm' END) AS d, ok
 FROM (SELECT event_id, CAST(event_id * 37 AS BIGINT) AS s, epoch_ms(ts) BETWEEN 946684800000 AND 4102444800000 AS ok FROM events))""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.time import millis

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", sensors.format_duration(F.col("event_id") * 37000).alias("text"), sensors.valid_time(millis(F.col("ts"))).alias("ok"))


FIX = "CAST(floor(greatest(0.0, least(1.0, {})) * 65535) AS INTEGER)"


@query(with_readings(f"""SELECT seq, {FIX.format('quality')} AS fixed, {FIX.format('quality')} >= 58982 AS high, {FIX.format('quality')} < 655 AS critical,
 CAST(floor({FIX.format('quality')} / pow(2.0, least(seq % 20, 16))) * CASE WHEN seq % 20 >= 16 THEN 0 ELSE 1 END AS INTEGER) AS decayed,
 CASE WHEN pow(value / 20, 2) / 2.0 > 9 THEN 655 ELSE {FIX.format('(1 - 0.5 * pow(value / 20, 2) / 2.0 + 0.125 * pow(pow(value / 20, 2) / 2.0, 2))')} END AS innovation,
 CASE WHEN abs(value) > 5.99 THEN 655 ELSE {FIX.format('pow(1 - abs(value) / 5.99, 2)')} END AS mahalanobis,
 CAST(floor(floor((CAST({FIX.format('quality')} AS BIGINT) + 65535 + 32768) / 3) * 61 / 64) AS INTEGER) AS combined
FROM r WHERE sensor_type = 'temperature'"""))
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'")
    c = C.from_float(F.col("quality"))
    return r.select(
        "seq", c.alias("fixed"), C.is_high(c).alias("high"), C.is_critical(c).alias("critical"), C.decay(c, F.col("seq") % 20, 1).alias("decayed"),
        C.from_innovation(F.col("value") / 20, F.lit(2.0)).alias("innovation"), C.from_mahalanobis(F.abs("value"), 2).alias("mahalanobis"), C.combine(F.array(c, F.lit(65535), F.lit(32768))).alias("combined"),
    )


@query(with_readings(f"""SELECT sensor_type, n, CASE WHEN n < 2 THEN 32768 WHEN x > 3 THEN 655 ELSE {FIX.format('CASE WHEN x < 0.5 THEN 1 - 0.4 * x WHEN x < 1 THEN 0.8 - 0.4 * (x - 0.5) WHEN x < 2 THEN 0.6 - 0.3 * (x - 1) ELSE greatest(0.3 - 0.1 * (x - 2), 0.0) END')} END AS agreement,
 {FIX.format('q * least(n / 20.0, 1.0)')} AS system
FROM (SELECT sensor_type, count(*) AS n, round(var_pop(value) / 2000, 9) AS x, round(avg(quality), 9) AS q FROM r GROUP BY 1)"""))
def confidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sensor_readings(spark, sf_dir).groupBy("sensor_type").agg(F.count("*").alias("n"), F.round(F.var_pop("value") / 2000, 9).alias("_x"), F.round(F.avg("quality"), 9).alias("_q"))
    return g.select("sensor_type", "n", C.from_agreement(F.col("_x"), F.col("n"), F.lit(1.0)).alias("agreement"), C.of_system(F.col("_q"), F.col("n")).alias("system"))


@query(with_readings(f"""SELECT seq, {FIX.format('((CASE WHEN value BETWEEN 0 AND 50 THEN 1.0e0 WHEN value BETWEEN -20 AND 70 THEN 0.7e0 ELSE 0.3e0 END) + (CASE WHEN quality * 100 BETWEEN 20 AND 80 THEN 1.0e0 WHEN quality * 100 BETWEEN 10 AND 90 THEN 0.8e0 ELSE 0.5e0 END) + (CASE WHEN 850 + seq % 300 BETWEEN 950 AND 1050 THEN 1.0e0 WHEN 850 + seq % 300 BETWEEN 870 AND 1085 THEN 0.7e0 ELSE 0.4e0 END) + (CASE WHEN seq % 6000 < 3000 THEN 1.0e0 WHEN seq % 6000 < 5000 THEN 0.7e0 ELSE 0.4e0 END)) / 4')} AS environment,
 {FIX.format('CASE WHEN d < 0.5 THEN 1.0 WHEN d < 1 THEN 0.9 - 0.4 * (d - 0.5) WHEN d < 2 THEN 0.7 - 0.4 * (d - 1) ELSE 0.3 END')} AS cross_check,
 round(least(CASE WHEN d < 1 THEN 1 - 0.2 * d WHEN d < 3 THEN 0.8 - 0.3 * (d - 1) ELSE 0.01 END, CASE WHEN value BETWEEN -35 AND 80 THEN 1.0 WHEN value BETWEEN -40 AND 85 THEN 0.7 ELSE 0.3 END, 0.8, 0.5), 6) AS temperature,
 round(least(greatest(1 - 0.1 * d, 0.2), CASE WHEN seq % 6000 < 3000 THEN 1.0 WHEN seq % 6000 < 5000 THEN 0.7 ELSE 0.4 END), 6) AS pressure,
 round(least(greatest(1 - 0.1 * d, 0.3), CASE WHEN value BETWEEN 0 AND 50 THEN 1.0 WHEN value BETWEEN -20 AND 70 THEN 0.7 ELSE 0.4 END, 0.9), 6) AS humidity
FROM (SELECT *, abs(value - 20.0) / 15.0 AS d FROM r WHERE sensor_type = 'temperature')"""))
def confidence_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, v, s = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'"), F.col("value"), F.col("seq")
    d = F.abs(v - 20.0) / 15.0
    return r.select(
        "seq", C.of_environment(v, F.col("quality") * 100, 850 + s % 300, s % 6000).alias("environment"), C.of_cross_validation(v, F.lit(20.0), F.lit(15.0)).alias("cross_check"),
        r6(C.of_temperature(d, v), "temperature"), r6(C.of_pressure(d, s % 6000), "pressure"), r6(C.of_humidity(d, v), "humidity"),
    )


def _grid_sql(preset: str, t: str, rh: str) -> str:
    """Bilinear interpolation in a grid that the SQL holds as a list, row after row."""
    step_t, step_rh, _ = physics.PRESETS[preset]
    grid = physics.dew_point_grid(step_t, step_rh)
    wide = len(grid[0])
    at = f"{preset}_i * {wide} + {preset}_j"
    u, v = f"({t} + 40e0) / {step_t}e0 - {preset}_i", f"{rh} / {step_rh}e0 - {preset}_j"
    values = "[" + ", ".join(f"{x}e0" for row in grid for x in row) + "]"
    corner = lambda x, y: f"{values}[CAST({at} + {x * wide + y + 1} AS BIGINT)]"
    return f"round({corner(0, 0)} * (1 - ({u})) * (1 - ({v})) + {corner(0, 1)} * (1 - ({u})) * ({v}) + {corner(1, 0)} * ({u}) * (1 - ({v})) + {corner(1, 1)} * ({u}) * ({v}), 6)"


def _cell_sql(preset: str) -> str:
    step_t, step_rh, _ = physics.PRESETS[preset]
    grid = physics.dew_point_grid(step_t, step_rh)
    return f"least(floor((t + 40e0) / {step_t}e0), {len(grid) - 2}) AS {preset}_i, least(floor(rh / {step_rh}e0), {len(grid[0]) - 2}) AS {preset}_j"


@query(with_readings(f"SELECT seq, {', '.join(f'{_grid_sql(p, chr(116), chr(114) + chr(104))} AS dew_{p}' for p in physics.PRESETS)} FROM (SELECT *, {', '.join(map(_cell_sql, physics.PRESETS))} FROM "
    "(SELECT seq, greatest(-40e0, least(50e0, value)) AS t, quality * 100e0 AS rh FROM r WHERE sensor_type = 'temperature'))"))
def dew_point_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature'")
    return r.select("seq", *[r6(physics.dew_point_preset(F.col("value"), F.col("quality") * 100, p), f"dew_{p}") for p in physics.PRESETS])


@query(with_readings("""SELECT seq, abs(s - sin(x)) < 0.0013 AS sine_near, abs(c - cos(x)) < 0.0013 AS cosine_near, round(s, 6) AS sine, abs(c) < 0.01 AS tangent_missing FROM (SELECT seq, x,
  (1 - (p - floor(p))) * sin(2 * pi() * floor(p) / 64) + (p - floor(p)) * sin(2 * pi() * (floor(p) + 1) / 64) AS s, (1 - (q - floor(q))) * sin(2 * pi() * floor(q) / 64) + (q - floor(q)) * sin(2 * pi() * (floor(q) + 1) / 64) AS c FROM (
  SELECT seq, x, (x / (2 * pi()) - floor(x / (2 * pi()))) * 64 AS p, ((x + pi() / 2) / (2 * pi()) - floor((x + pi() / 2) / (2 * pi()))) * 64 AS q FROM (SELECT seq, value / 7.0 AS x FROM r)))"""))
def sine_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 7.0
    s, c = physics.sine_table(x), physics.cosine_table(x)
    near = lambda a, b: F.abs(a - b) < 0.0013
    return sensor_readings(spark, sf_dir).select("seq", near(s, F.sin(x)).alias("sine_near"), near(c, F.cos(x)).alias("cosine_near"), r6(s, "sine"), physics.tangent_table(x).isNull().alias("tangent_missing"))


@query(with_readings("""SELECT seq, ts_ms AS from_iso, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, ts_ms + 90061001 AS later, seq % 5 = 0 AS broken, CAST(mono AS BIGINT) AS clock,
  greatest(ts_ms - 1704100000000, 0) AS since FROM (SELECT *, max(ts_ms - seq % 9 * 100000) OVER (PARTITION BY sensor_id, sensor_type ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mono FROM r)"""))
def time_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir)
    iso = T.to_iso(F.col("ts_ms"))
    broken = T.from_iso(F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), iso)).otherwise(iso)).isNull()
    back = r.withColumn("_t", F.col("ts_ms") - F.col("seq") % 9 * 100_000)
    return back.select(
        "seq", T.from_iso(F.when(F.col("seq") % 2 == 0, F.regexp_replace(iso, "Z$", "+00:00")).otherwise(F.regexp_replace(iso, "Z$", ""))).alias("from_iso"), iso.alias("iso"),
        T.later(F.col("ts_ms"), days=1, hours=1, minutes=1, seconds=1, millis=1).alias("later"), broken.alias("broken"), T.monotonic("_t").alias("clock"),
        T.since(F.col("ts_ms"), T.fixed(1_704_100_000_000)).alias("since"),
    )


@query(with_readings("""SELECT sensor_id, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), [CAST(ord(c) AS HUGEINT) FOR c IN string_split(sensor_id, '')]), lambda h, b: (h * 31 + b) % 18446744073709551616) AS VARCHAR) AS id_hash
FROM (SELECT DISTINCT sensor_id || '-long-enough-to-wrap' AS sensor_id FROM r)"""))
def sensor_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sensor_readings(spark, sf_dir).select(F.concat("sensor_id", F.lit("-long-enough-to-wrap")).alias("sensor_id")).distinct()
    return ids.select("sensor_id", sensors.id_hash(F.col("sensor_id")).cast("string").alias("id_hash"))


@query(with_readings("SELECT sensor_type, unit, count(*) AS n, round(avg(value), 6) AS mean_value FROM r JOIN (VALUES " + ", ".join(f"('{n}', '{u}')" for _, n, u, _, _ in SENSOR_TYPES) + ") AS t(sensor_type, unit) USING (sensor_type) GROUP BY 1, 2"))
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    api.register_views(sensor_readings(spark, sf_dir))
    return spark.sql("SELECT sensor_type, unit, count(*) AS n, round(avg(value), 6) AS mean_value FROM validated JOIN sensor_types USING (sensor_type) GROUP BY sensor_type, unit")


@query(with_readings(f"""SELECT seq, least(a + b, 65535) AS added, {FIX.format('(a / 65535e0) * (b / 65535e0)')} AS multiplied,
  round(e + 0.1e0 * (y - e), 6) AS reliability FROM (SELECT seq, {FIX.format('x')} AS a, {FIX.format('y')} AS b, y, 0.5e0 + 0.1e0 * (x - 0.5e0) AS e FROM (SELECT seq, quality AS x, (seq % 100) / 100e0 AS y FROM r))"""))
def confidence_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("quality"), F.col("seq") % 100 / 100.0
    a, b = C.from_float(x), C.from_float(y)
    return sensor_readings(spark, sf_dir).select("seq", C.add(a, b).alias("added"), C.multiply(a, b).alias("multiplied"), r6(C.reliability(F.array(x, y), 0.1), "reliability"))
