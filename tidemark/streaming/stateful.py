"""Streaming forms: the column stages run on streams as they are; here is what needs state of its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.fusion import Fuser, Group
from tidemark.operators.validators import DEFAULTS, Limits, status


def tumbling_stream(readings: DataFrame, width_ms: int, late: str = "10 minutes") -> DataFrame:
    """Windowed aggregates under a watermark; readings later than ``late`` are left out once their window is closed."""
    timed = readings.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    grouped = timed.groupBy("sensor_type", F.window("event_time", f"{width_ms} milliseconds"))
    found = grouped.agg(F.count("*").alias("count"), F.avg("value").alias("result_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return found.select("sensor_type", F.unix_millis("window.start").alias("base_ts_ms"), "count", "result_value", "min_value", "max_value")


def session_stream(readings: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    timed = readings.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    found = timed.groupBy("sensor_id", F.session_window("event_time", gap)).agg(F.count("*").alias("count"), F.avg("value").alias("result_value"))
    return found.select("sensor_id", F.unix_millis("session_window.start").alias("base_ts_ms"), "count", "result_value")


def deduplicated(readings: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return readings.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


VALIDATED = "sensor_id string, sensor_type string, ts_ms long, seq long, value double, quality double, rate double"


def _per_key(df: DataFrame, keys: list[str], schema: str, step: Callable[[tuple, pd.DataFrame, dict], tuple[pd.DataFrame, dict]]) -> DataFrame:
    """Rows of each key in order of (ts_ms, seq) within a micro-batch, with a state that is kept as JSON."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "seq"])
        out, after = step(key, rows, before)
        state.update((json.dumps(after),))
        yield out

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def with_rate_stream(readings: DataFrame) -> DataFrame:
    """The rate since the sensor's last reading, across micro-batches."""

    def step(key: tuple, rows: pd.DataFrame, before: dict) -> tuple[pd.DataFrame, dict]:
        value, ts = rows.value.shift(), rows.ts_ms.shift()
        if before:
            value.iloc[0], ts.iloc[0] = before["value"], before["ts"]
        dt = rows.ts_ms - ts
        rate = ((rows.value - value).abs() * 1000 / dt).where((dt > 0) & np.isfinite(value), 0.0).fillna(0.0)
        last = {"value": float(rows.value.iloc[-1]), "ts": int(rows.ts_ms.iloc[-1])}
        return rows.assign(rate=rate)[[c.split()[0] for c in VALIDATED.split(", ")]], last

    return _per_key(readings, ["sensor_id", "sensor_type"], VALIDATED, step)


def validate_stream(readings: DataFrame, limits: Sequence[Limits] = tuple(DEFAULTS.values())) -> DataFrame:
    out: Column = F.lit(None).cast("string")
    for x in limits:
        out = F.when(F.col("sensor_type") == x.sensor_type, status(x, rate=F.col("rate"))).otherwise(out)
    return with_rate_stream(readings).withColumn("status", out)


def fuse_stream(readings: DataFrame, groups: list[Group]) -> DataFrame:
    """The same fusions as in a batch, across micro-batches."""
    by_name = {g.name: g for g in groups}
    members = readings.sparkSession.createDataFrame([(g.name, s) for g in groups for s in g.sensors], "group_name string, sensor_id string")
    dealt = readings.select("sensor_id", "ts_ms", "seq", "value").join(F.broadcast(members), "sensor_id")

    def step(key: tuple, rows: pd.DataFrame, before: dict) -> tuple[pd.DataFrame, dict]:
        fuser = Fuser(by_name[key[0]], before)
        out = [(key[0], t, s, *found) for n, t, s, v in zip(rows.sensor_id, rows.ts_ms.tolist(), rows.seq.tolist(), rows.value.tolist(), strict=True) if (found := fuser.add(n, t, v))]
        return pd.DataFrame(out, columns=["group_name", "ts_ms", "seq", "estimate", "confidence"]), fuser.state()

    return _per_key(dealt, ["group_name"], "group_name string, ts_ms long, seq long, estimate double, confidence double", step)


def ema_stream(readings: DataFrame, alpha: float = 0.1) -> DataFrame:
    def step(key: tuple, rows: pd.DataFrame, before: dict) -> tuple[pd.DataFrame, dict]:
        x, out = before.get("x"), []
        for v in rows.value.tolist():
            x = v if x is None else x + alpha * (v - x)
            out.append(x)
        return pd.DataFrame({"sensor_id": key[0], "seq": rows.seq.to_numpy(), "ema": out}), {"x": x}

    return _per_key(readings, ["sensor_id"], "sensor_id string, seq long, ema double", step)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that the stream's source has now, as a table in memory, for small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """All that the stream's source has now, appended to Parquet files, and read back."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(folder)
