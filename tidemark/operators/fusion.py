"""Fusion of several sensors into one estimate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.confidence import LEAST, MOST
from tidemark.operators.folds import ddl, fold_sorted, geometric_sum


def ramp(n: Column) -> Column:
    """Confidence grows over the first ten updates."""
    return F.least(n / 10.0, F.lit(1.0))


def weighted(values: Column, weights: Column, n: Column) -> dict[str, Column]:
    """Estimate and confidence of an array of values (null: absent) with an array of weights."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), weights.alias("w")), lambda p: p["v"].isNotNull())
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"])
    estimate = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * p["v"]) / F.when(total > 0, total)
    spread = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * F.pow(p["v"] - estimate, F.lit(2.0))) / F.when(total > 0, total)
    agreement = F.when(F.size(pairs) == 1, 0.5).otherwise(1 / (1 + spread))
    return {"estimate": estimate, "confidence": F.size(pairs) / F.size(values) * ramp(n) * agreement}


def consensus(values: Column, n: Column, sigmas: float = 3.0, least: int = 2) -> dict[str, Column]:
    """Mean of the values within so many population standard deviations of the mean; null without enough of them."""
    own = F.filter(values, lambda v: v.isNotNull())
    size = F.size(own)
    mean = F.aggregate(own, F.lit(0.0), lambda s, v: s + v) / F.when(size > 0, size)
    sd = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(2.0))) / F.when(size > 0, size))
    kept = F.filter(own, lambda v: F.abs(v - mean) <= sigmas * sd + 1e-12)
    votes = F.size(kept)
    enough = votes >= least
    return {
        "estimate": F.when(enough, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.when(votes > 0, votes)), "votes": votes,
        "confidence": F.when(enough, votes / F.when(size > 0, size) * ramp(n)).otherwise(F.lit(0.0)),
    }


def complementary(fast: Column, slow: Column, alpha: float = 0.02) -> dict[str, Column]:
    d = F.abs(fast - slow)
    return {"estimate": alpha * fast + (1 - alpha) * slow, "confidence": F.when(d < 0.1, 1.0).when(d < 1, 1 - (d - 0.1) * 0.1).otherwise(0.5)}


def simple_average(values: Column) -> dict[str, Column]:
    own = F.filter(values, lambda v: v.isNotNull())
    return {"estimate": F.aggregate(own, F.lit(0.0), lambda s, v: s + v) / F.when(F.size(own) > 0, F.size(own)), "confidence": F.lit(0.8)}


def fusion_status(confidence: Column) -> Column:
    return F.when(confidence < LEAST / MOST, "SensorQualityBad").otherwise("Valid")


def scalar_gains(q: float, r: float, p0: float, most: int = 100_000) -> tuple[list[float], list[float]]:
    """(gain, variance) after each update of a scalar filter, up to where they stay as they are; they depend on no measurement."""
    gains, variances, p = [], [], p0
    while len(gains) < most:
        p += q
        k = p / (p + r)
        p = (1 - k) * (1 - k) * p + k * k * r
        if gains and gains[-1] == k and variances[-1] == p:
            break
        gains.append(k)
        variances.append(p)
    return gains, variances


def kalman_scalar(readings: DataFrame, q: float = 0.01, r: float = 0.01, p0: float = 1.0, by: tuple[str, ...] = ("sensor_id", "sensor_type")) -> DataFrame:
    """The filtered value of each group after its last reading.

    Gains depend on the number of an update alone, so the fold is a sum in which each reading weighs its gain and what later ones
    leave of it; a group is sorted with spilling and streamed, and nothing holds it whole.  Readings without a value take no
    part.
    """
    gains, variances = scalar_gains(q, r, p0)
    logs = [0.0]
    for k in gains:
        logs.append(logs[-1] + math.log1p(-k))

    def of(table: list[float]):
        return lambda n: F.get(F.lit(table), F.least(n, F.lit(len(gains))).cast("int") - 1)

    def log_kept(n: Column) -> Column:
        return F.get(F.lit(logs), F.least(n, F.lit(len(gains))).cast("int")) + F.greatest(n - len(gains), F.lit(0)) * F.lit(logs[-1] - logs[-2])

    w = Window.partitionBy(*by)
    rows = readings.where("value is not null").withColumns({"_n": F.row_number().over(w.orderBy("ts_ms", "seq")), "_all": F.count("*").over(w)})
    found = rows.groupBy(*by).agg(geometric_sum(F.col("value"), of(gains), log_kept, F.col("_n"), F.col("_all")).alias("estimate"), F.count("*").alias("updates"))
    found = found.withColumn("variance", of(variances)(F.col("updates")))
    return found.select(*by, "estimate", "variance", "updates", kalman_confidence(F.col("variance"), F.col("updates")).alias("confidence"))


def kalman_confidence(trace: Column, n: Column) -> Column:
    return F.when(trace < 0.1, 1.0).when(trace < 1, 0.9 - 0.4 * (trace - 0.1)).otherwise(0.5 / trace) * ramp(n)


def trace_confidence(t: float, n: int) -> float:
    return (1.0 if t < 0.1 else 0.9 - 0.4 * (t - 0.1) if t < 1 else 0.5 / t) * min(n / 10, 1.0)


@dataclass
class KalmanFilter:
    """A linear filter.  Missing measurements (NaN) are left out of an update; ``transition`` may depend on the time step."""

    f: np.ndarray
    h: np.ndarray
    q: np.ndarray
    r: np.ndarray
    x: np.ndarray
    p: np.ndarray
    transition: Callable[[float], np.ndarray] | None = None
    n: int = 0

    @classmethod
    def of_size(cls, n: int, m: int, q: float = 0.01, r: float = 0.1, p: float = 1.0) -> KalmanFilter:
        return cls(np.eye(n), np.eye(m, n), np.eye(n) * q, np.eye(m) * r, np.zeros(n), np.eye(n) * p)

    @classmethod
    def constant_velocity(cls, dt: float, q: float, r: float) -> KalmanFilter:
        noise = q * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
        return cls(np.array([[1, dt], [0, 1.0]]), np.array([[1.0, 0]]), noise, np.array([[r]]), np.zeros(2), np.eye(2))

    def predict(self, dt: float = 0.0) -> None:
        f = self.transition(dt) if self.transition else self.f
        self.x = f @ self.x
        self.p = f @ self.p @ f.T + self.q
        self.p = (self.p + self.p.T) / 2

    def update(self, z: np.ndarray) -> float:
        """The first state after the update; the Joseph form keeps the covariance symmetric and positive."""
        seen = ~np.isnan(z)
        h, r = self.h[seen], self.r[np.ix_(seen, seen)]
        if seen.any():
            s = h @ self.p @ h.T + r
            k = np.linalg.solve(s, h @ self.p).T
            self.x = self.x + k @ (z[seen] - h @ self.x)
            a = np.eye(len(self.x)) - k @ h
            self.p = a @ self.p @ a.T + k @ r @ k.T
            self.n += 1
        return float(self.x[0])

    def confidence(self) -> float:
        return trace_confidence(float(np.trace(self.p)), self.n)

    def converged(self, threshold: float = 0.01, least: int = 5) -> bool:
        return self.n >= least and bool(np.max(np.diag(self.p)) < threshold)

    def well_conditioned(self, most: float = 1e6, least: float = 1e-6) -> bool:
        d = np.diag(self.p)
        return bool(d.min() >= least and d.max() / d.min() <= most)


@dataclass
class ExtendedKalmanFilter:
    """Linearises f at the state, by ``slopes`` or else by central differences; ``linear`` takes F = I instead."""

    f: Callable[[np.ndarray, float], np.ndarray]
    h: np.ndarray
    q: np.ndarray
    r: np.ndarray
    x: np.ndarray
    p: np.ndarray
    linear: bool = False
    n: int = 0
    slopes: Callable[[np.ndarray, float], np.ndarray] | None = None

    def jacobian(self, dt: float, eps: float = 1e-4) -> np.ndarray:
        if self.slopes:
            return self.slopes(self.x, dt)
        steps = np.eye(len(self.x)) * eps
        return np.stack([(self.f(self.x + e, dt) - self.f(self.x - e, dt)) / (2 * eps) for e in steps], axis=1)

    def step(self, z: np.ndarray, dt: float = 0.1) -> np.ndarray:
        a = np.eye(len(self.x)) if self.linear else self.jacobian(dt)
        x = self.x if self.linear else self.f(self.x, dt)
        inner = KalmanFilter(a, self.h, self.q, self.r, x, a @ self.p @ a.T + self.q)
        inner.update(z)
        self.x, self.p, self.n = inner.x, inner.p, self.n + inner.n
        return self.x

    def confidence(self) -> float:
        return trace_confidence(float(np.trace(self.p)), self.n)

    def converged(self, threshold: float = 0.01, least: int = 5) -> bool:
        return self.n >= least and bool(np.max(np.diag(self.p)) < threshold)


def temperature_model(noise: float = 0.1) -> ExtendedKalmanFilter:
    """State: temperature, ambient, rate of exchange."""
    return ExtendedKalmanFilter(
        lambda x, dt: np.array([x[0] - x[2] * (x[0] - x[1]) * dt, x[1], x[2]]), np.array([[1.0, 0, 0]]), np.diag([0.01, 0.001, 0.0001]),
        np.eye(1) * noise**2, np.array([25.0, 20, 0.1]), np.diag([1.0, 4, 0.01]),
        slopes=lambda x, dt: np.array([[1 - x[2] * dt, x[2] * dt, -(x[0] - x[1]) * dt], [0.0, 1, 0], [0.0, 0, 1]]),
    )


def pressure_altitude_model(p0: float = 1013.25, noise: float = 0.1) -> ExtendedKalmanFilter:
    def f(x: np.ndarray, dt: float) -> np.ndarray:
        h = x[1] + x[2] * dt
        return np.array([1013.25 * np.exp(-h / 8400), h, 0.95 * x[2]])

    return ExtendedKalmanFilter(f, np.array([[1.0, 0, 0]]), np.diag([0.1, 0.01, 0.1]), np.eye(1) * noise**2, np.array([p0, 0.0, 0]), np.diag([1.0, 100, 0.1]))


def humidity_model(noise: float = 2.0) -> ExtendedKalmanFilter:
    """State: true value, reading, hysteresis."""

    def f(x: np.ndarray, dt: float) -> np.ndarray:
        return np.array([x[0], np.clip(x[1] + (x[0] - x[1] - x[2]) / 5 * dt, 0, 100), x[2] * (1 - dt / 10)])

    p = np.array([[4.0, 2, 0], [2, 4, 0], [0, 0, 1]])
    return ExtendedKalmanFilter(f, np.array([[0.0, 1, 0]]), np.diag([0.1, 0.01, 0.05]), np.eye(1) * noise**2, np.array([50.0, 50, 0]), p)


def environmental_model(noises: tuple[float, float, float] = (0.1, 2.0, 0.1)) -> ExtendedKalmanFilter:
    """State: temperature, humidity, pressure, dew point, altitude."""

    def f(x: np.ndarray, dt: float) -> np.ndarray:
        return np.array([x[0], min(x[1], 100.0), x[2], x[0] - (100 - x[1]) / 5, -8400 * np.log(x[2] / 1013.25)])

    p = np.diag([1.0, 4, 1, 2, 100])
    for i, j in ((0, 3), (1, 3), (2, 4)):
        p[i, j] = p[j, i] = 0.5
    return ExtendedKalmanFilter(f, np.eye(3, 5), np.diag([0.01, 0.1, 0.1, 0.01, 1]), np.diag(np.square(noises)), np.array([20.0, 50, 1013.25, 10, 0]), p)


@dataclass(frozen=True)
class Group:
    """Sensors that are fused: weights by sensor (1 if not named); the method is one of those below or ``kalman``."""

    name: str
    sensors: tuple[str, ...]
    method: str = "weighted"
    weights: dict[str, float] = field(default_factory=dict)
    interval_ms: int = 100
    min_sensors: int = 2
    q: float = 0.01
    r: float = 0.01

    def __hash__(self) -> int:
        return hash(self.name)


class Fuser:
    """The state of one group: last value of each sensor (never forgotten) and time of the last fusion."""

    def __init__(self, group: Group, state: dict | None = None):
        self.group = group
        self.last: dict[str, float] = dict((state or {}).get("last", {}))
        self.fused_at: int | None = (state or {}).get("fused_at")
        self.n: int = (state or {}).get("n", 0)
        self.x: float = (state or {}).get("x", 0.0)
        self.p: float = (state or {}).get("p", 1.0)

    def state(self) -> dict:
        return {"last": self.last, "fused_at": self.fused_at, "n": self.n, "x": self.x, "p": self.p}

    def add(self, sensor: str, ts: int, value: float) -> tuple[float, float] | None:
        """(estimate, confidence) if this reading brings a fusion about."""
        g = self.group
        if value is None or np.isnan(value):
            return None
        self.last[sensor] = value
        present = [s for s in g.sensors if s in self.last]
        if (self.fused_at is not None and ts - self.fused_at < g.interval_ms) or len(present) < g.min_sensors:
            return None
        self.fused_at, self.n = ts, self.n + 1
        z = np.array([self.last[s] for s in present])
        growth = min(self.n / 10, 1.0)
        if g.method == "average":
            return float(z.mean()), 0.8
        if g.method == "consensus":
            kept = z[np.abs(z - z.mean()) <= 3 * z.std() + 1e-12]
            return (float(kept.mean()), len(kept) / len(z) * growth) if len(kept) >= 2 else (self.x, 0.0)
        if g.method == "kalman":
            f = KalmanFilter(np.eye(1), np.ones((len(z), 1)), np.eye(1) * g.q, np.eye(len(z)) * g.r, np.array([self.x]), np.array([[self.p]]), n=self.n - 1)
            f.predict()
            f.update(z)
            self.x, self.p = float(f.x[0]), float(f.p[0, 0])
            return self.x, f.confidence()
        w = np.array([g.weights.get(s, 1.0) for s in present])
        mean = float((w * z).sum() / w.sum())
        spread = float((w * (z - mean) ** 2).sum() / w.sum())
        return mean, len(z) / len(g.sensors) * growth * (0.5 if len(z) == 1 else 1 / (1 + spread))


FUSED = "group_name string, ts_ms long, seq long, estimate double, confidence double"


class _Fused:
    def __init__(self, group: Group):
        self.fuser = Fuser(group)

    def add(self, sensor: str, ts: int, seq: int, value: float | None) -> Iterator[tuple]:
        if found := self.fuser.add(sensor, ts, value):
            yield ts, seq, *found

    def close(self) -> tuple:
        return ()


def fuse(readings: DataFrame, groups: list[Group]) -> DataFrame:
    """A row whenever a group is fused: when a member reads, its interval has passed and enough members have been heard.

    Groups are independent; each is folded in order in a sorted stream that holds the members' last values; a sensor may
    belong to several.
    """
    by_name = {g.name: g for g in groups}
    members = readings.sparkSession.createDataFrame([(g.name, s) for g in groups for s in g.sensors], "group_name string, sensor_id string")
    dealt = readings.select("sensor_id", "ts_ms", "seq", "value").join(F.broadcast(members), "sensor_id")
    return fold_sorted(dealt, ("group_name",), ("sensor_id", "ts_ms", "seq", "value"), lambda key: _Fused(by_name[key[0]]), FUSED)


FILTERED = "ts_ms long, seq long, state array<double>, variances array<double>, updates long, confidence double, converged boolean"


class _Filtered:
    """A filter fed with the measurements of one key; the time step is that between rows, in seconds."""

    def __init__(self, model: KalmanFilter | ExtendedKalmanFilter, first_dt: float, fixed_dt: float | None):
        self.model, self.dt, self.fixed, self.last = model, first_dt, fixed_dt, None

    def add(self, ts: int, seq: int, *z: float | None) -> Iterator[tuple]:
        dt = self.fixed if self.fixed is not None else self.dt if self.last is None else max(0, ts - self.last) / 1000
        self.last, m = ts, self.model
        seen = np.array([np.nan if v is None else v for v in z], float)
        if isinstance(m, ExtendedKalmanFilter):
            m.step(seen, dt)
        else:
            m.predict(dt)
            m.update(seen)
        yield ts, seq, m.x.tolist(), np.diag(m.p).tolist(), m.n, m.confidence(), m.converged()

    def close(self) -> tuple:
        return ()


def filtered(
    measurements: DataFrame, model: Callable[[], KalmanFilter | ExtendedKalmanFilter], columns: tuple[str, ...], by: tuple[str, ...] = ("sensor_id", "sensor_type"),
    first_dt: float = 0.1, fixed_dt: float | None = None,
) -> DataFrame:
    """A Kalman or extended Kalman filter over the measurement columns of each key, in the order of (ts_ms, seq).

    ``model`` makes a fresh filter of any number of states and measurements.  A null measurement is left out of its update; a
    row without any is a prediction alone.  A row for each row: the key, ts_ms, seq, the state, the diagonal of its covariance,
    updates so far, confidence, and whether the filter has converged.  A key is folded in a sorted stream that holds one filter.
    """
    key = ddl(measurements, by)
    return fold_sorted(measurements, by, ("ts_ms", "seq", *columns), lambda _: _Filtered(model(), first_dt, fixed_dt), f"{key}, {FILTERED}")


def temperature_fusion() -> KalmanFilter:
    """One state and one sensor, noise 0.1."""
    return KalmanFilter.of_size(1, 1, q=0.01, r=0.1**2)


def weighted_fusion(name: str, sensors: tuple[str, ...], weights: dict[str, float] | None = None) -> Group:
    return Group(name, sensors, weights=weights or {})


def latest_by_type(readings: DataFrame, kinds: tuple[str, ...], width_ms: int) -> DataFrame:
    """For each window of time the last value of every kind, as columns."""
    start = (F.floor(F.col("ts_ms") / width_ms) * width_ms).alias("base_ts_ms")
    picked = [F.max_by(F.when(F.col("sensor_type") == k, F.col("value")), F.when(F.col("sensor_type") == k, F.struct("ts_ms", "seq"))).alias(k) for k in kinds]
    return readings.where(F.col("sensor_type").isin(*kinds)).groupBy(start).agg(*picked)


def numbered(df: DataFrame, order: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``n``, the number of updates so far."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
