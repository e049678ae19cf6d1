"""Queries over parsers and payloads: readings are written in a source's format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.readings import sensor_readings, with_readings
from tidemark.sources import connectors, files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Every seventh line lacks its confidence, every eleventh its value, every thirteenth has an unknown kind.
PARSED_SQL = """parsed AS (SELECT seq, ts_ms, sensor_id, CASE WHEN seq % 13 = 0 OR sensor_type IN ('voc', 'vibration') THEN NULL ELSE sensor_type END AS sensor_type,
  CASE WHEN seq % 11 = 0 THEN NULL ELSE floor(value * 8) / 8 END AS value, CASE WHEN seq % 7 = 0 THEN 1e0 ELSE quality END AS quality FROM r)"""
REJECT_SQL = "CASE WHEN sensor_type IS NULL THEN 'unknown sensor type' WHEN value IS NULL THEN 'bad value' END"


def _fields() -> list:
    kind = F.when(F.col("seq") % 13 == 0, "nonsense").when(F.col("sensor_type") == "temperature", "TEMP").when(F.col("sensor_type") == "humidity", '"Humid"').otherwise(F.col("sensor_type"))
    value = F.when(F.col("seq") % 11 == 0, "n/a").otherwise((F.floor(F.col("value") * 8) / 8).cast("string"))
    return [kind, value, F.when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(F.col("quality").cast("string"))]


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value, quality = _fields()
    line = F.concat_ws(",", F.col("ts_ms").cast("string"), F.concat(F.lit('"'), "sensor_id", F.lit('"')), kind, value, quality)
    lines = sensor_readings(spark, sf_dir).select("seq", line.alias("value"))
    comments = lines.limit(0).union(spark.createDataFrame([(-1, "# comment"), (-2, "   ")], "seq long, value string"))
    return files.parse_csv(lines.union(comments))


def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir).select("seq", *files.FIELDS, "reject")


def csv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_stats(_csv(spark, sf_dir))


def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value, quality = _fields()
    kind = F.regexp_replace(kind, '"', "")
    number = F.when(F.col("seq") % 2 == 0, F.col("ts_ms"))
    one = F.struct(number.alias("timestamp"), F.when(number.isNotNull(), F.col("sensor_id")).alias("sensor_id"), F.when(number.isNotNull(), kind).alias("type"), value.try_cast("double").alias("value"), quality.try_cast("double").alias("confidence"))
    two = F.struct(F.col("ts_ms").alias("ts"), F.col("sensor_id").alias("id"), kind.alias("sensor_type"), value.try_cast("double").alias("reading"), quality.try_cast("double").alias("quality"))
    line = F.when(number.isNotNull(), F.to_json(one)).otherwise(F.to_json(two))
    return files.parse_jsonl(sensor_readings(spark, sf_dir).select("seq", line.alias("value"))).select("seq", *files.FIELDS, "reject")


for _f in (csv_parse, jsonl_parse):
    QUERIES[_f.__name__] = _f
    ORACLE_SQL[_f.__name__] = with_readings(f"SELECT seq, ts_ms, sensor_id, sensor_type, value, quality, {REJECT_SQL} AS reject FROM parsed", PARSED_SQL)
QUERIES["csv_stats"] = csv_stats
ORACLE_SQL["csv_stats"] = with_readings(
    "SELECT count(*) FILTER (sensor_type IS NOT NULL AND value IS NOT NULL) AS events_read, count(*) FILTER (sensor_type IS NULL OR value IS NULL) AS parse_errors, count(*) AS lines_processed FROM parsed", PARSED_SQL
)


def binary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading as a 33-byte record, built in the JVM: little-endian time, kind and padded id, and a value of whole eighths."""
    r = sensor_readings(spark, sf_dir).where(F.col("sensor_type").isin("temperature", "humidity", "pressure"))

    def little(hex_digits, n: int):
        padded = F.lpad(hex_digits, 2 * n, "0")
        return F.concat(*[F.substring(padded, 2 * n - 1 - 2 * i, 2) for i in range(n)])

    kind = F.when(F.col("sensor_type") == "temperature", "00").when(F.col("sensor_type") == "humidity", "01").otherwise("02")
    # 128.0 in single precision is 0x43000000; the query's values are 128 plus 0 to 127, so the mantissa holds them plainly.
    whole = F.lit(0x43000000) + (F.col("seq") % 128) * 65536
    raw = F.unhex(F.concat(little(F.hex("ts_ms"), 8), kind, F.rpad(F.hex(F.encode("sensor_id", "UTF-8")), 32, "0"), little(F.hex(whole.cast("long")), 4), F.lit("0000803F")))
    return files.parse_binary(r.select(raw.alias("content")))


QUERIES["binary_parse"] = binary_parse
ORACLE_SQL["binary_parse"] = with_readings("SELECT ts_ms, sensor_id, sensor_type, CAST(128 + seq % 128 AS DOUBLE) AS value, 1e0 AS quality, CAST(NULL AS VARCHAR) AS reject FROM r WHERE sensor_type IN ('temperature', 'humidity', 'pressure')")


def batch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = connectors.payloads(sensor_readings(spark, sf_dir))
    back = F.from_json("body", "count int, readings array<struct<seq: long, sensor_id: string, ts_ms: long, value: double, quality: double>>")
    return p.select("sensor_type", "chunk_no", back.alias("b")).select("sensor_type", "chunk_no", "b.count", F.get("b.readings", F.lit(0))["seq"].alias("first_seq"), F.array_max(F.col("b.readings.ts_ms")).alias("last_ts_ms"))


QUERIES["batch_payloads"] = batch_payloads
ORACLE_SQL["batch_payloads"] = with_readings("""SELECT sensor_type, chunk_no, count(*) AS count, min(seq) AS first_seq, max(ts_ms) AS last_ts_ms
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) - 1) / 100) AS BIGINT) AS chunk_no FROM r) GROUP BY 1, 2""")


def topic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sensor_readings(spark, sf_dir).select(F.col("sensor_type").alias("topic"), F.col("sensor_id").alias("payload"), "ts_ms", "seq")
    b = connectors.topic_batches(m, 50)
    back = F.from_json("body", "array<struct<topic: string, payload: string, timestamp: long>>")
    return b.select("topic", "batch_no", F.size(back).alias("n"), F.get(back, F.lit(0))["payload"].alias("first_payload"))


QUERIES["topic_batches"] = topic_batches
ORACLE_SQL["topic_batches"] = with_readings("""SELECT sensor_type AS topic, batch_no, count(*) AS n, arg_min(sensor_id, seq) AS first_payload
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY sensor_type ORDER BY ts_ms, seq) - 1) / 50) AS BIGINT) AS batch_no FROM r) GROUP BY 1, 2""")


def block_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.encode(F.repeat("props", 9), "UTF-8").alias("payload"))
    return connectors.blocks(m, "payload", 2).select("event_id", "block_no", "more", "option", F.decode("block", "UTF-8").alias("block"))


QUERIES["block_transfer"] = block_transfer
ORACLE_SQL["block_transfer"] = """SELECT event_id, block_no, block_no < n - 1 AS more, block_no * 16 + CASE WHEN block_no < n - 1 THEN 8 ELSE 0 END + 2 AS option, substr(p, CAST(block_no * 64 + 1 AS BIGINT), 64) AS block
FROM (SELECT event_id, p, n, unnest(range(0, n)) AS block_no FROM (SELECT event_id, repeat(props, 9) AS p, CAST(ceil(length(repeat(props, 9)) / 64.0) AS BIGINT) AS n FROM events))"""
