"""Isolation forest and features of sensor windows."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import physics
from tidemark.functions.sensors import by_sensor
from tidemark.operators.folds import geometric_sum

#: Rows that a fit collects at most, the first in a total order.
MOST_ROWS = 100_000
BASIC = ("mean", "min", "max", "std_dev", "rate_of_change")
EXTENDED = (*BASIC, "median", "variance", "rms", "zero_crossings", "peak_count")
FULL = (*EXTENDED, "skewness", "kurtosis", "trend_slope", "count")


class Lcg:
    """A linear congruential generator of 32 bits."""

    def __init__(self, seed: int):
        self.state = seed % (1 << 32)

    def next(self) -> int:
        self.state = (self.state * 1664525 + 1013904223) % (1 << 32)
        return self.state

    def below(self, n: int) -> int:
        return self.next() % n

    def uniform(self) -> float:
        return self.next() / (1 << 32)


def path_length(n: int) -> float:
    """Mean depth of a failed search among n points."""
    if n <= 1:
        return 0.0
    m = n - 1
    h = sum(1 / i for i in range(1, m + 1)) if m <= 20 else math.log(m) + 0.5772156649015329 + 1 / (2 * m)
    return 2 * h - 2 * m / n


@dataclass
class IsolationForest:
    """Trees of random splits over samples of at most ``sample`` rows; a node is (feature, split, left, right) or a leaf (-1, size)."""

    trees: int = 10
    sample: int = 256
    depth: int = 8
    seed: int = 42
    threshold: float = 0.6
    nodes: list[list[tuple]] = field(default_factory=list)
    used: int = 0

    def fit(self, x: np.ndarray) -> IsolationForest:
        self.nodes, self.used = [], min(self.sample, len(x))
        for i in range(self.trees):
            self._grow(x, self.seed + i)
        return self

    def partial_fit(self, x: np.ndarray, fraction: float) -> IsolationForest:
        """Replaces that share of the trees, the oldest first."""
        n = max(1, round(self.trees * fraction))
        self.nodes = self.nodes[n:]
        self.used = min(self.sample, len(x))
        for i in range(n):
            self._grow(x, self.seed + self.trees + i)
        return self

    def _grow(self, x: np.ndarray, seed: int) -> None:
        rng, order = Lcg(seed), np.arange(len(x))
        for i in range(self.used):  # partial shuffle
            j = i + rng.below(len(order) - i)
            order[i], order[j] = order[j], order[i]
        nodes: list[tuple] = []

        def build(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append((-1, len(rows), 0, 0))
            if depth >= self.depth or len(rows) <= 1:
                return me
            for _ in range(10):
                feature = rng.below(rows.shape[1])
                low, high = rows[:, feature].min(), rows[:, feature].max()
                if low < high:
                    split = low + rng.uniform() * (high - low)
                    left = rows[:, feature] < split
                    if left.any() and not left.all():
                        a, b = build(rows[left], depth + 1), build(rows[~left], depth + 1)
                        nodes[me] = (feature, split, a, b)
                        return me
            return me

        build(np.asarray(x, float)[order[: self.used]], 0)
        self.nodes.append(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, normalised by the rows a tree has seen; 0.5 before anything can be told."""
        x = np.asarray(x, float)
        if not self.nodes or self.used <= 1:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for nodes in self.nodes:
            feature, split = np.array([n[0] for n in nodes]), np.array([float(n[1]) for n in nodes])
            left, right = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
            leaf = np.array([path_length(int(n[1])) if n[0] < 0 else 0.0 for n in nodes])
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] < split[at], left[at], right[at])
                at, depth = np.where(inner, go, at), depth + inner
            total += depth + leaf[at]
        return 2 ** (-total / len(self.nodes) / path_length(self.used))

    def is_anomaly(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) > self.threshold

    def stats(self) -> dict[str, float]:
        sizes = [len(n) for n in self.nodes]
        return {"trees": len(sizes), "nodes": sum(sizes), "samples": self.used, "confidence": min(len(sizes) / 100, 1.0)}

    def dumps(self) -> bytes:
        return pickle.dumps(self)


def fit_forest(df: DataFrame, features: list[str], order: list[str], *, rows: int = 256, **options) -> IsolationForest:
    """A forest from the first ``rows`` complete rows in a total order, so that a fit does not depend on partitions."""
    if rows > MOST_ROWS:
        raise ValueError(f"a fit collects at most {MOST_ROWS} rows")
    found = df.dropna(subset=features).orderBy(*order).select(*features).limit(rows).toPandas()
    return IsolationForest(**options).fit(found.to_numpy(float))


def score_forest(df: DataFrame, forest: IsolationForest, features: list[str], score: str = "anomaly_score") -> DataFrame:
    """Adds the score and ``is_anomaly``; rows without all features have none.  The forest is small and goes with the function."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = part.to_numpy(float)
            yield pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, forest.score(np.nan_to_num(x))))

    value = scored(F.struct(*[F.col(f).cast("double") for f in features]))
    out = df.withColumn(score, F.nanvl(value, F.lit(None).cast("double")))
    return out.withColumn("is_anomaly", F.col(score) > forest.threshold)


def score_details(score: Column, forest: IsolationForest) -> Column:
    """A score as a struct with the mean path length behind it, the trees, and how far their number is to be trusted."""
    path = -F.log2(score) * path_length(forest.used)
    trees = len(forest.nodes)
    return F.struct(score.alias("score"), path.alias("path_length"), F.lit(trees).alias("trees"), F.lit(min(trees / 100, 1.0)).alias("confidence"))


def running_features(readings: DataFrame, window: int = 100, names: tuple[str, ...] = (*BASIC, "count")) -> DataFrame:
    """Features (of FULL) of each reading's last ``window`` readings of its sensor, itself included.

    Moments are windowed aggregates.  What needs the window's readings one by one (median, crossings of the mean, peaks, slope
    against time in seconds) is taken from an array of at most ``window`` values.
    """
    w = by_sensor().rowsBetween(-(window - 1), 0)
    value = F.col("value")
    first_v, first_t = F.first("value").over(w), F.first("ts_ms").over(w)
    span = F.col("ts_ms") - first_t
    v, t = F.col("_v"), F.col("_t")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    at = F.sequence(F.lit(0), F.size(v) - 1)
    crossed = F.filter(at, lambda i: (i > 0) & ((F.get(v, i - 1) - F.col("mean")) * (F.get(v, i) - F.col("mean")) < 0))
    peaks = F.filter(at, lambda i: (i > 0) & (F.get(v, i) > F.get(v, i - 1)) & (F.get(v, i) > F.get(v, i + 1)))
    seconds = F.transform(t, lambda x: (x - F.get(t, F.lit(0))) / 1000.0)
    mean_t = F.aggregate(seconds, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    up = F.aggregate(F.zip_with(seconds, v, lambda x, y: (x - mean_t) * (y - mean)), F.lit(0.0), lambda s, x: s + x)
    down = F.aggregate(seconds, F.lit(0.0), lambda s, x: s + (x - mean_t) * (x - mean_t))
    all_of = {
        "mean": F.avg("value").over(w), "min": F.min("value").over(w), "max": F.max("value").over(w), "std_dev": F.stddev_pop("value").over(w),
        "rate_of_change": F.when(span > 0, (value - first_v) * 1000.0 / span).otherwise(F.lit(0.0)), "count": F.count("value").over(w),
        "variance": F.var_pop("value").over(w), "rms": F.sqrt(F.avg(value * value).over(w)),
        "skewness": F.coalesce(F.nanvl(F.skewness("value").over(w), F.lit(0.0)), F.lit(0.0)), "kurtosis": F.coalesce(F.nanvl(F.kurtosis("value").over(w), F.lit(0.0)), F.lit(0.0)),
    }
    one_by_one = {
        "median": F.expr("(get(array_sort(_v), cast(floor((size(_v) - 1) / 2) as int)) + get(array_sort(_v), cast(floor(size(_v) / 2) as int))) / 2"),
        "zero_crossings": F.size(crossed), "peak_count": F.size(peaks), "trend_slope": F.when(down > 0, up / F.when(down > 0, down)).otherwise(F.lit(0.0)),
    }
    out = readings.withColumns({n: c for n, c in all_of.items() if n in names or n == "mean"})
    if any(n in one_by_one for n in names):
        some = F.collect_list(F.when(value.isNotNull(), F.struct("ts_ms", "value"))).over(w)
        out = out.withColumn("_w", some).withColumns({"_v": F.col("_w.value"), "_t": F.col("_w.ts_ms")})
        out = out.withColumns({n: c for n, c in one_by_one.items() if n in names}).drop("_w", "_v", "_t")
    return out if "mean" in names else out.drop("mean")


def correlation_features(t: dict[str, Column], rh: dict[str, Column], p: dict[str, Column]) -> dict[str, Column]:
    """Nine features from the mean, variance, std_dev and trend_slope of three kinds, null where a kind is missing."""
    margin = t["mean"] - physics.dew_point_table(t["mean"], rh["mean"])
    both = (F.abs(t["trend_slope"]) > 0.01) & (F.abs(rh["trend_slope"]) > 0.01)
    aligned = F.when((t["trend_slope"] > 0) == (rh["trend_slope"] > 0), 1.0).otherwise(-1.0)
    return {
        "dew_point_margin": margin,
        "dew_point_depression": F.when(t["mean"] == 0, 0.0).otherwise(margin / F.when(t["mean"] != 0, F.abs(t["mean"]))),
        "variance_ratio": F.when(rh["variance"] > 0, t["variance"] / F.when(rh["variance"] > 0, rh["variance"])).when(rh["variance"].isNotNull(), 1.0),
        "trend_alignment": F.when(both, aligned).when(both.isNotNull(), 0.0),
        "normalized_pressure": p["mean"] / physics.SEA_LEVEL,
        "pressure_deviation": F.abs(p["mean"] - physics.SEA_LEVEL) / physics.SEA_LEVEL,
        "pressure_stability": 1 / (p["std_dev"] + 1),
        "temperature_pressure_ratio": t["mean"] / (p["mean"] / 10),
        "combined_stability": 1 / (t["std_dev"] + rh["std_dev"] + p["std_dev"] + 1),
    }


def score_history(scored: DataFrame, score: str, by: tuple[str, ...], alpha: float = 0.1, recent: int = 10) -> DataFrame:
    """Trend of the last scores: slope against their index, whether it rises, and their mean."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    numbered = scored.withColumn("_i", F.row_number().over(w).cast("double"))
    last = w.rowsBetween(-(recent - 1), 0)
    slope = F.coalesce(F.regr_slope(score, "_i").over(last), F.lit(0.0))
    return numbered.withColumns({"trend": slope, "recent_average": F.avg(score).over(last), "increasing": slope > 0.01}).drop("_i")


def exponential_average(df: DataFrame, value: str, by: tuple[str, ...], alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """The average of each group after its last row, as a sum in which a value weighs less the more rows follow it.

    Rows without a value take no part.  A group is sorted with spilling and streamed; nothing holds it whole.
    """
    w = Window.partitionBy(*by)
    kept = math.log1p(-alpha)
    rows = df.where(F.col(value).isNotNull()).withColumns({"_n": F.row_number().over(w.orderBy("ts_ms", "seq")), "_all": F.count("*").over(w)})
    found = geometric_sum(F.col(value), lambda n: F.lit(alpha), lambda n: n * F.lit(kept), F.col("_n"), F.col("_all"))
    return rows.groupBy(*by).agg((found + F.lit(start) * F.exp(F.count("*") * F.lit(kept))).alias("ema"))


def anomaly_stage(readings: DataFrame, *, train_rows: int = 50, threshold: float = 0.7, min_quality: float = 0.5, forest: IsolationForest | None = None) -> DataFrame:
    """Scores of readings of good quality, and the code of the event each one raises, by a given forest or one of the first ``train_rows``."""
    kinds = readings.where(F.col("sensor_type").isin("temperature", "humidity", "pressure") & (F.col("quality") >= min_quality))
    features = running_features(kinds)
    forest = forest or fit_forest(features, list(BASIC), ["ts_ms", "seq"], rows=train_rows, threshold=threshold)
    out = score_forest(features, forest, list(BASIC))
    code = F.when(F.col("is_anomaly"), F.floor(F.col("anomaly_score") * 1000))
    return out.select("sensor_id", "sensor_type", "ts_ms", "seq", "value", "anomaly_score", "is_anomaly", code.alias("system_details"))
