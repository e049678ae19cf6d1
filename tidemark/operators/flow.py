"""Merging, batching, limiting and dropping, as batch operators over the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import ddl, fold_sorted, written


def merge_by_time(*streams: DataFrame) -> DataFrame:
    """All rows with ``position`` in the order of time; streams come in the order given where times are equal."""
    both = reduce(lambda a, b: a.unionByName(b), [s.withColumn("stream_no", F.lit(i)) for i, s in enumerate(streams)])
    return _numbered(both, ["ts_ms", "stream_no", "seq"])


def merge_round_robin(*streams: DataFrame) -> DataFrame:
    """One row of each stream in turn, each in its own order; streams that are done are passed over."""
    both = reduce(lambda a, b: a.unionByName(b), [_numbered(s.withColumn("stream_no", F.lit(i)), ["ts_ms", "seq"], "turn") for i, s in enumerate(streams)])
    return _numbered(both, ["turn", "stream_no"])


def _numbered(df: DataFrame, order: list[str], name: str = "position", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row in a total order of each key, from 0.

    Ranges of (key, order) are sorted apart and the rows of earlier ranges added, so that a key with very many rows, or none to
    tell rows apart, is spread over tasks.  The ranges are drawn from a sample, so they are written once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = written(ranged.withColumn("_place", F.monotonically_increasing_id()))
    # The id has the partition's number above bit 33 and the row's place in it below.
    ranged = ranged.withColumns({"_part": F.shiftright("_place", 33), "_in": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row for each range and key in it: at most as many as there are ranges and keys.
    ahead = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_rows"), F.min("_in").alias("_first"))
    before = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first")
    ahead = ahead.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, ranged["_part"] == ahead["_part"])
    joined = ranged.join(ahead, same).drop(ahead["_part"], *[f"_{k}" for k in keys])
    return joined.withColumn(name, F.col("_ahead") + F.col("_in")).drop("_place", "_part", "_in", "_ahead")


def batch_by_count(readings: DataFrame, n: int, keys: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    """Adds ``batch_no``: n rows each, the last with what is left."""
    return _numbered(readings, ["ts_ms", "seq"], "_at", keys).withColumn("batch_no", F.floor(F.col("_at") / n)).drop("_at")


def batch_by_time(readings: DataFrame, width_ms: int) -> DataFrame:
    return readings.withColumn("batch_no", F.floor(F.col("ts_ms") / width_ms))


class _Batches:
    """Numbers the rows of one key by batches that close at n rows or by time."""

    def __init__(self, n: int, timeout_ms: int, at: int):
        self.n, self.timeout, self.at = n, timeout_ms, at
        self.number, self.held, self.start = -1, 0, None

    def add(self, *row) -> Iterator[tuple]:
        ts = row[self.at]
        if self.start is None or self.held == self.n or ts - self.start >= self.timeout:
            self.number, self.held, self.start = self.number + 1, 0, ts
        self.held += 1
        yield *row, self.number

    def close(self) -> tuple:
        return ()


def batch_by_count_or_time(readings: DataFrame, n: int, timeout_ms: int, keys: tuple[str, ...] = ("sensor_id", "sensor_type")) -> DataFrame:
    """Adds ``batch_no``: batches of each key that close at n rows or when the timeout has passed since their first row."""
    return _folded(readings, keys, lambda at: _Batches(n, timeout_ms, at), "batch_no long")


def _folded(readings: DataFrame, keys: tuple[str, ...], start, added: str) -> DataFrame:
    """All columns and one more, from a fold over each key; ``start`` gets the place of ts_ms among the columns that are no keys."""
    own = [c for c in readings.columns if c not in keys]
    at = own.index("ts_ms")
    out = fold_sorted(readings, keys, own, lambda key: start(at), f"{ddl(readings, [*keys, *own])}, {added}")
    return out.select(*readings.columns, added.split()[0])


def drop_oldest(readings: DataFrame, capacity: int, keys: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    """What a ring of so many slots holds in the end; one slot is never used.  Spark limits the rows of a key ahead of the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts_ms"), F.desc("seq")))
    return readings.withColumn("_place", place).where(F.col("_place") <= capacity - 1).drop("_place")


def drop_newest(readings: DataFrame, capacity: int, keys: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ms", "seq"))
    return readings.withColumn("_place", place).where(F.col("_place") <= capacity - 1).drop("_place")


def backpressure(levels: DataFrame, level: str, keys: tuple[str, ...], high: float = 0.8, low: float = 0.2) -> DataFrame:
    """Adds ``paused``: set from ``high`` on, released from ``low`` down, and kept in between."""
    w = Window.partitionBy(*keys).orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    latch = F.last(F.when(F.col(level) >= high, 1).when(F.col(level) <= low, 0), ignorenulls=True).over(w)
    return levels.withColumn("paused", F.coalesce(latch, F.lit(0)) == 1)


class TokenBucket:
    """Admits a reading for each token; tokens come back with event time.  The bucket starts full."""

    def __init__(self, per_second: float, most: float, at: int = 0):
        self.per_second, self.most, self.at = per_second, most, at
        self.tokens, self.last = most, None

    def admits(self, ts: int) -> bool:
        if self.last is not None:
            self.tokens = min(self.most, self.tokens + max(0, ts - self.last) * self.per_second / 1000)
        self.last = ts
        admitted = self.tokens >= 1
        self.tokens -= admitted
        return admitted

    def add(self, *row) -> Iterator[tuple]:
        yield *row, self.admits(row[self.at])

    def close(self) -> tuple:
        return ()


def rate_limited(readings: DataFrame, per_second: float, burst: float | None = None, keys: tuple[str, ...] = ("sensor_id", "sensor_type")) -> DataFrame:
    """Adds ``admitted`` from a token bucket of each key, in event time."""
    most = per_second if burst is None else burst
    return _folded(readings, keys, lambda at: TokenBucket(per_second, most, at), "admitted boolean")


def admissions(times: list[int], per_second: float, most: float) -> Iterator[bool]:
    yield from map(TokenBucket(per_second, most).admits, times)
