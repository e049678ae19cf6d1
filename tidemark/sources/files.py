"""Sensor readings from CSV lines, JSON lines and 33-byte binary records, and readings that malformed input is kept apart from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line may have so many bytes.
MOST_LINE_BYTES = 256
# Names of kinds in files.
FILE_TYPES = {"temperature": "temperature", "temp": "temperature", "humidity": "humidity", "humid": "humidity", "pressure": "pressure", "press": "pressure"}
RECORD = np.dtype([("ts_ms", "<u8"), ("kind", "u1"), ("sensor_id", "S16"), ("value", "<f4"), ("quality", "<f4")])
FIELDS = ("ts_ms", "sensor_id", "sensor_type", "value", "quality")


def _kind(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair]), F.lower(F.trim(name)))


def _clamped(q: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(q, F.lit(1.0))))


def _usable(lines: DataFrame, line: str) -> DataFrame:
    """Lines without closing carriage return; blank lines and comments are left out."""
    text = F.rtrim(F.when(F.col(line).endswith("\r"), F.rtrim(F.col(line), F.lit("\r"))).otherwise(F.col(line)))
    return lines.withColumn(line, text).where((F.trim(F.col(line)) != "") & ~F.ltrim(F.col(line)).startswith("#"))


def _checked(df: DataFrame, line: str) -> DataFrame:
    """Adds ``reject``, why a line is no reading, or null."""
    why = (
        F.when(F.octet_length(line) > MOST_LINE_BYTES, "line too long")
        .when(F.col("ts_ms").isNull(), "bad timestamp")
        .when(F.coalesce(F.col("sensor_id"), F.lit("")) == "", "no sensor id")
        .when(F.col("sensor_type").isNull(), "unknown sensor type")
        .when(F.col("value").isNull(), "bad value")
    )
    return df.withColumn("reject", why)


def parse_csv(lines: DataFrame, line: str = "value", ts_unit_ms: int = 1) -> DataFrame:
    """ts_ms, sensor_id, sensor_type, value, quality and ``reject`` of ``timestamp,id,type,value[,confidence]`` lines.

    Quotes around names are taken off, further fields ignored, a trailing comment too.  Confidence is clamped to 0..1 and
    1 where it is missing or no number.  Nothing is dropped but blank lines and comments: select on ``reject``.
    """
    df = _usable(lines.withColumnRenamed(line, "_line"), "_line")
    # Patterns run only where there is something for them to find; a line is cut once.
    line = F.when(F.contains("_line", F.lit("#")), F.regexp_replace("_line", r"\s#.*$", "")).otherwise(F.col("_line"))
    df = df.withColumn("_parts", F.split(line, ",", 6))

    def field(i: int) -> Column:
        x = F.trim(F.get("_parts", F.lit(i)))
        return F.trim(F.btrim(x, F.lit('"')))

    part = [field(i) for i in range(5)]
    df = df.withColumns(
        {
            "ts_ms": F.expr("1L") * part[0].try_cast("long") * ts_unit_ms, "sensor_id": part[1], "sensor_type": _kind(part[2]),
            "value": part[3].try_cast("double"), "quality": _clamped(part[4].try_cast("double")),
        }
    )
    return _checked(df, "_line").drop("_line", "_parts")


JSON = "timestamp string, ts string, sensor_id string, id string, type string, sensor_type string, value string, reading string, confidence string, quality string"


def parse_jsonl(lines: DataFrame, line: str = "value", ts_unit_ms: int = 1) -> DataFrame:
    """The same from JSON objects, under either of two names for each field."""
    df = _usable(lines.withColumnRenamed(line, "_line"), "_line").withColumn("_j", F.from_json("_line", JSON))
    either = lambda a, b: F.coalesce(F.col(f"_j.{a}"), F.col(f"_j.{b}"))
    df = df.withColumns(
        {
            "ts_ms": F.floor(either("timestamp", "ts").try_cast("decimal(20,3)") * ts_unit_ms).cast("long"), "sensor_id": either("sensor_id", "id"),
            "sensor_type": _kind(either("type", "sensor_type")), "value": either("value", "reading").try_cast("double"), "quality": _clamped(either("confidence", "quality").try_cast("double")),
        }
    )
    return _checked(df, "_line").drop("_line", "_j")


def parse_binary(files: DataFrame, content: str = "content") -> DataFrame:
    """The same from 33-byte little-endian records; a rest at the end is rejected as one row."""
    schema = "ts_ms long, sensor_id string, sensor_type string, value double, quality double, reject string"
    kinds = np.array(["temperature", "humidity", "pressure"], object)

    def records(raw: bytes) -> pa.RecordBatch:
        x = np.frombuffer(raw, RECORD)
        known = x["kind"] < len(kinds)
        name = np.where(known, kinds[np.minimum(x["kind"], 2)], None)
        ids = [s.decode("utf-8", "replace") for s in x["sensor_id"].tolist()]
        columns = [pa.array(x["ts_ms"].astype("i8")), pa.array(ids, pa.string()), pa.array(name.tolist(), pa.string()), pa.array(x["value"].astype("f8")), pa.array(x["quality"].astype("f8"))]
        return pa.record_batch([*columns, pa.array(np.where(known, None, "unknown sensor type").tolist(), pa.string())], [*FIELDS, "reject"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, size, broken = [], 0, 0
            for raw in batch.column(0).to_pylist():
                raw = raw or b""
                broken += len(raw) % RECORD.itemsize > 0
                for at in range(0, len(raw) - len(raw) % RECORD.itemsize, RECORD.itemsize * 65_536):
                    part = raw[at : at + RECORD.itemsize * 65_536]
                    whole.append(part[: len(part) - len(part) % RECORD.itemsize])
                    size += len(whole[-1])
                    if size >= RECORD.itemsize * 65_536:
                        yield records(b"".join(whole))
                        whole, size = [], 0
            if whole:
                yield records(b"".join(whole))
            if broken:
                none = [pa.nulls(broken, t) for t in (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())]
                yield pa.record_batch([*none, pa.array(["truncated record"] * broken)], [*FIELDS, "reject"])

    return files.select(content).mapInArrow(read, schema)


def write_binary(readings: list[tuple[int, int, str, float, float]]) -> bytes:
    """Records of (ts_ms, kind code, sensor id of at most 15 bytes, value, quality)."""
    out = np.zeros(len(readings), RECORD)
    for i, (ts, kind, name, value, quality) in enumerate(readings):
        if len(name.encode()) > 15:
            raise ValueError("a sensor id has at most 15 bytes")
        out[i] = (ts, kind, name.encode(), value, quality)
    return out.tobytes()


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject is null").select(*FIELDS)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject is not null")


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Events read, errors and lines, in one row."""
    return parsed.agg(F.count_if(F.col("reject").isNull()).alias("events_read"), F.count_if(F.col("reject").isNotNull()).alias("parse_errors"), F.count("*").alias("lines_processed"))


def read_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Lines of text files as ``value``, without the first ``skip`` of each file.

    Only the first splits of the files, where these lines are, are laid side by side by file; the rest is read where it is.
    """
    lines = spark.read.text(path)
    if not skip:
        return lines
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
    begin = placed.where("_from = 0").withColumn("_at", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return begin.withColumn("_n", number).where(F.col("_n") > skip).select("value").union(placed.where("_from > 0").select("value"))


def read_csv(spark: SparkSession, path: str, skip_lines: int = 0, **options) -> DataFrame:
    return parse_csv(read_lines(spark, path, skip_lines), **options)


def read_jsonl(spark: SparkSession, path: str, skip_lines: int = 0, **options) -> DataFrame:
    return parse_jsonl(read_lines(spark, path, skip_lines), **options)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return parse_binary(spark.read.format("binaryFile").load(path))


def stream_csv(spark: SparkSession, path: str, max_files: int | None = None, **options) -> DataFrame:
    """The same as a stream of files."""
    reader = spark.readStream.format("text")
    return parse_csv((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path), **options)


def process_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hands each micro-batch and its number to ``handle``; with ``once`` all that is there now, and then returns."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


READINGS = "sensor_id string, sensor_type string, value double, ts_ms long, quality double, seq long"


def replay(spark: SparkSession, readings: list[tuple]) -> DataFrame:
    """Readings from memory: (sensor_id, sensor_type, value, ts_ms, quality), in order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(readings)], READINGS)


class Replay:
    """Readings from memory, some at a time."""

    def __init__(self, spark: SparkSession, readings: list[tuple]):
        self.spark, self.readings, self.position = spark, readings, 0

    @property
    def exhausted(self) -> bool:
        return self.position >= len(self.readings)

    @property
    def remaining(self) -> int:
        return len(self.readings) - self.position

    def next(self, n: int = 128) -> DataFrame:
        """The next n readings, or what is left; EOFError when there is nothing."""
        if self.exhausted:
            raise EOFError("all readings were given out")
        some = [(*r, self.position + i) for i, r in enumerate(self.readings[self.position : self.position + n])]
        self.position += len(some)
        return self.spark.createDataFrame(some, READINGS)

    def reset(self) -> None:
        self.position = 0
