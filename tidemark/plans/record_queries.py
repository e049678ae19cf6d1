"""Queries over records and schemas, sources in memory, generators, sorting, and the streaming forms run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions.sensors import by_sensor
from tidemark.operators import flow, forest, stages
from tidemark.operators import schema as S
from tidemark.operators import validators as V
from tidemark.operators.folds import scratch_dir
from tidemark.plans.readings import as_readings, sensor_readings, with_readings
from tidemark.plans.validator_queries import LIMITS, RATED_SQL, STATUS_SQL
from tidemark.sources import connectors, files
from tidemark.streaming import stateful

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 24 * 3_600_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _values(rows: list[tuple], columns: str) -> str:
    quoted = [", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v) for v in r) for r in rows]
    return "SELECT * FROM (VALUES " + ", ".join(f"({r})" for r in quoted) + f") AS t({columns})"


@query(with_readings("SELECT seq, status, CASE WHEN status <> 'Valid' THEN 1 ELSE 0 END AS n_errors, status = 'Valid' AS is_valid FROM checked WHERE status IS NOT NULL", RATED_SQL, STATUS_SQL))
def status_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.validate_all(sensor_readings(spark, sf_dir), LIMITS).where("status is not null")
    return checked.withColumn("_r", S.report_from_status(F.col("status"))).select("seq", "status", F.size("_r.errors").alias("n_errors"), "_r.is_valid")


# What goes into a field's metadata comes out again; pressure keeps the limits of its validator, other kinds take the typical range.
EMBEDDED = [(k, low, high, rate) for k, _, _, low, high, rate, *_ in S.CONSTRAINTS]


@query(_values([(k, a, b, c, *((V.PRESSURE.low, V.PRESSURE.high, V.PRESSURE.max_rate) if k == "pressure_hpa" else (a, b, c))) for k, a, b, c in EMBEDDED], "constraint_key, min_value, max_value, max_rate, low, high, rate"))
def schema_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for key, low, high, rate in EMBEDDED:
        marked = S.embed(S.SENSOR_READING, "value", {"min": low, "max": high, "rate": rate})
        stored = spark.createDataFrame([], marked).schema  # the constraints travel with the column
        found, limits = S.extract(stored, "value"), S.limits_from(key)
        rows.append((key, found["min"], found["max"], found["rate"], float(limits.low), float(limits.high), float(limits.max_rate)))
    return spark.createDataFrame(rows, "constraint_key string, min_value double, max_value double, max_rate double, low double, high double, rate double")


@query(_values([("sensor_reading", 1, 9, 4), ("device_status", 1, 9, 4), ("sensor_batch", 1, 8, 1), ("alert", 1, 7, 1)], "name, version, n_fields, n_optional"))
def schema_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.Registry.with_defaults()
    rows = [(n, v, len(r.get(n, v).fields), sum(f.nullable for f in r.get(n, v))) for n in r.entries for v in r.versions(n)]
    return spark.createDataFrame(rows, "name string, version int, n_fields int, n_optional int")


@query(_values([("added optional", "true"), ("added required", "false"), ("dropped", "true"), ("retyped", "false"), ("same", "true")], "change, fits"))
def schema_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = lambda *fields: S.from_avro_json({"type": "record", "fields": [{"name": n, "type": t} for n, t in fields]})
    base = (("a", "string"), ("b", "long"))
    changes = {
        "same": base, "added optional": (*base, ("c", ["null", "double"])), "added required": (*base, ("c", "double")), "dropped": base[:1], "retyped": (("a", "string"), ("b", "double")),
    }
    rows = []
    for change, fields in changes.items():
        r = S.Registry()
        r.register("x", record(*base))
        r.register("x_v2", record(*fields))
        rows.append((change, str(r.compatible("x", 1, 2)).lower()))
    return spark.createDataFrame(rows, "change string, fits string")


@query("""WITH RECURSIVE g AS (SELECT 0 AS n, CAST(42 AS BIGINT) AS state UNION ALL SELECT n + 1, (state * 1664525 + 1013904223) % 4294967296 FROM g WHERE n < 50)
SELECT n, state, state % 10 AS below_ten, state / 4294967296e0 AS uniform FROM g WHERE n > 0""")
def lcg_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rng, rows = forest.Lcg(42), []
    for n in range(1, 51):
        state = rng.next()
        rows.append((n, state, state % 10, state / (1 << 32)))
    return spark.createDataFrame(rows, "n int, state long, below_ten long, uniform double")


@query(with_readings("""SELECT seq, stream_no, row_number() OVER (ORDER BY ts_ms, stream_no, seq) - 1 AS position
FROM (SELECT *, CASE sensor_type WHEN 'temperature' THEN 0 WHEN 'humidity' THEN 1 ELSE 2 END AS stream_no FROM r WHERE sensor_type IN ('temperature', 'humidity', 'pressure'))"""))
def triple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensor_readings(spark, sf_dir).select("seq", "sensor_type", "ts_ms")
    streams = [r.where(F.col("sensor_type") == kind) for kind in ("temperature", "humidity", "pressure")]
    return flow.merge_by_time(*streams).select("seq", "stream_no", "position")


@query(with_readings("SELECT seq, sensor_id, value FROM r ORDER BY value DESC, seq LIMIT 50"))
def highest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).orderBy(F.desc("value"), "seq").limit(50).select("seq", "sensor_id", "value")


# Raise by one, keep every other, attach the reading before: a chain of stages of one's own.
@query(with_readings("SELECT seq, value + 1 AS value, lag(value + 1) OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts_ms, seq) AS before FROM r WHERE seq % 2 = 0"))
def custom_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raise_by_one = lambda df: df.withColumn("value", F.col("value") + 1)
    remember = lambda df: df.withColumn("before", F.lag("value").over(by_sensor()))
    return stages.Pipeline([raise_by_one]).then(stages.keep(F.col("seq") % 2 == 0)).then(remember)(sensor_readings(spark, sf_dir)).select("seq", "value", "before")


class _EvenVoc:
    sensor_type = "voc"

    def status(self):
        return F.when(F.floor("value") % 2 == 0, "Valid").otherwise("OutOfRange")


@query(with_readings("SELECT sensor_type, CASE WHEN sensor_type = 'voc' THEN CASE WHEN floor(value) % 2 = 0 THEN 'Valid' ELSE 'OutOfRange' END END AS status, count(*) AS n FROM r GROUP BY 1, 2"))
def custom_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_with(sensor_readings(spark, sf_dir), [_EvenVoc()]).groupBy("sensor_type", "status").agg(F.count("*").alias("n"))


@query(with_readings("SELECT seq // 128 AS part, count(*) AS n, min(seq) AS first_seq, round(sum(value), 4) AS total FROM (SELECT * FROM r ORDER BY seq LIMIT 500) GROUP BY 1"))
def replayed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = sensor_readings(spark, sf_dir).orderBy("seq").limit(500).select("sensor_id", "sensor_type", "value", "ts_ms", "quality").collect()
    replay, parts = files.Replay(spark, [tuple(r) for r in first]), []
    while not replay.exhausted:
        parts.append(replay.next(128).withColumn("part", F.floor(F.col("seq") / 128)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.round(F.sum("value"), 4).alias("total"))


@query(with_readings("SELECT sensor_type || '/' || sensor_id AS topic, count(*) AS n FROM r WHERE sensor_type = 'temperature' OR sensor_id = 's7' GROUP BY 1"))
def subscribed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = connectors.Subscriptions()
    subs.subscribe("temperature/#")
    subs.subscribe("+/s7")
    messages = sensor_readings(spark, sf_dir).select(F.concat_ws("/", "sensor_type", "sensor_id").alias("topic"))
    return subs.delivered(messages).groupBy("topic").agg(F.count("*").alias("n"))


def _refuses_some(address: str, body: bytes, *options) -> int:
    return 404 if b'"s7"' in body else 200


# One body for each reading; the transport refuses those of one sensor at once, without another try.
@query(with_readings("SELECT count(*) FILTER (sensor_id <> 's7') AS sent, count(*) FILTER (sensor_id = 's7') AS failed FROM r"))
def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = sensor_readings(spark, sf_dir).select(F.to_json(F.struct("seq", "sensor_id")).alias("body"))
    sink = connectors.HttpSink(_refuses_some, "http://there", auth={"type": "bearer", "token": "t"})
    return connectors.send(bodies, sink).agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


@query(with_readings("""SELECT seq, status, status = 'Valid' AS is_valid, CASE WHEN status = 'Valid' THEN quality ELSE quality * 0.5 END AS confidence FROM (
  SELECT seq, quality, CASE WHEN value NOT BETWEEN -80 AND 125 THEN 'OutOfRange' WHEN quality < 0.5 THEN 'SensorQualityBad' ELSE 'Valid' END AS status FROM r WHERE sensor_type = 'temperature' AND seq < 400)"""))
def single_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = sensor_readings(spark, sf_dir).where("sensor_type = 'temperature' and seq < 400").select("seq", "sensor_id", "sensor_type", "value", "ts_ms", "quality").collect()
    rows = []
    for r in some:
        found = api.validate_reading(api.create_reading(r.sensor_id, r.sensor_type, r.value, r.ts_ms, r.quality), "temp")
        rows.append((r.seq, found["status"], found["is_valid"], found["confidence"]))
    return spark.createDataFrame(rows, "seq long, status string, is_valid boolean, confidence double")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_readings(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))


@query(with_readings(f"""SELECT sensor_type, CAST(floor(ts_ms / {DAY}) AS BIGINT) * {DAY} AS base_ts_ms, count(*) AS count, round(avg(value), 6) AS result_value, min(value) AS min_value, max(value) AS max_value
FROM r GROUP BY 1, 2"""))
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events' files, read to its end; the result has a row a window."""
    name = f"windows_{uuid.uuid4().hex}"
    found = stateful.run_once(stateful.tumbling_stream(_stream(spark, sf_dir), DAY), name, f"{scratch_dir(spark)}/{name}", "complete")
    return found.withColumn("result_value", F.round("result_value", 6))


@query(with_readings("SELECT seq, sensor_id, sensor_type, round(rate, 6) AS rate, status FROM checked", RATED_SQL, STATUS_SQL))
def streamed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of each reading from a state that outlives micro-batches, written to files."""
    place = f"{scratch_dir(spark)}/validated_{uuid.uuid4().hex}"
    found = stateful.run_to_files(stateful.validate_stream(_stream(spark, sf_dir), LIMITS), place, f"{place}_checkpoint")
    return found.select("seq", "sensor_id", "sensor_type", F.round("rate", 6).alias("rate"), "status")
