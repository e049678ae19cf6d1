"""Confidence scores: sixteen-bit fixed point (0 to 65535), as integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, LEAST, MODERATE, HIGH = 65535, 655, 32768, 58982


def from_float(x: Column) -> Column:
    """Clamped to 0..1 and truncated."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * MOST).cast("int")


def as_float(c: Column) -> Column:
    return c / F.lit(float(MOST))


def add(a: Column, b: Column) -> Column:
    return F.least(a + b, F.lit(MOST))


def multiply(a: Column, b: Column) -> Column:
    return from_float(as_float(a) * as_float(b))


def is_high(c: Column) -> Column:
    return c >= HIGH


def is_critical(c: Column) -> Column:
    return c < LEAST


def combine(scores: Column) -> Column:
    """Mean of an array, truncated, times 61/64, truncated; 0 for none."""
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda s, x: s + x)
    mean = F.floor(total / F.greatest(F.size(scores), F.lit(1)))
    return F.floor(mean * 61 / 64).cast("int")


def decay(c: Column, dt_ms: Column, half_life_ms: int) -> Column:
    """Halved for every half-life; nothing is left after sixteen."""
    halvings = F.floor(dt_ms / half_life_ms).cast("int")
    return F.when(halvings >= 16, F.lit(0)).otherwise(F.floor(c / F.pow(F.lit(2.0), F.least(halvings, F.lit(16))))).cast("int")


def reliability(values: Column, alpha: float, start: float = 0.5) -> Column:
    """Exponential average of an array in order."""
    return F.aggregate(values, F.lit(start), lambda s, x: s + alpha * (x - s))


def from_innovation(innovation: Column, variance: Column, threshold: float = 3.0) -> Column:
    x2 = F.pow(innovation, F.lit(2.0)) / F.when(variance > 0, variance)
    return F.when(variance <= 0, F.lit(0)).when(x2 > threshold**2, F.lit(LEAST)).otherwise(from_float(1 - 0.5 * x2 + 0.125 * x2 * x2))


# 95 % points of chi squared for 1 to 5 degrees of freedom.
CHI_SQUARED = (3.84, 5.99, 7.81, 9.49, 11.07)


def from_mahalanobis(squared: Column, n: int) -> Column:
    limit = CHI_SQUARED[n - 1] if n <= len(CHI_SQUARED) else n + 2.45 * (2 * n) ** 0.5
    return F.when(squared > limit, F.lit(LEAST)).otherwise(from_float(F.pow(1 - squared / limit, F.lit(2.0))))


def from_agreement(variance: Column, n: Column, expected: Column) -> Column:
    """From the population variance of n measurements against the expected one."""
    r = variance / expected
    score = F.when(r < 0.5, 1 - 0.4 * r).when(r < 1, 0.8 - 0.4 * (r - 0.5)).when(r < 2, 0.6 - 0.3 * (r - 1)).otherwise(F.greatest(0.3 - 0.1 * (r - 2), F.lit(0.0)))
    return F.when(n < 2, F.lit(MODERATE)).when(r > 3, F.lit(LEAST)).otherwise(from_float(score))


def of_system(mean_reliability: Column, n: Column) -> Column:
    return from_float(mean_reliability * F.least(n / 20.0, F.lit(1.0)))


def _band(v: Column, best: tuple[float, float], good: tuple[float, float], scores: tuple[float, float]) -> Column:
    return F.when(v.between(*best), 1.0).when(v.between(*good), scores[0]).otherwise(scores[1])


def of_environment(t: Column, rh: Column, p: Column, h: Column) -> Column:
    """Mean of four band scores."""
    bands = (
        _band(t, (0, 50), (-20, 70), (0.7, 0.3)) + _band(rh, (20, 80), (10, 90), (0.8, 0.5)) + _band(p, (950, 1050), (870, 1085), (0.7, 0.4))
        + F.when(h < 3000, 1.0).when(h < 5000, 0.7).otherwise(0.4)
    )
    return from_float(bands / 4)


def of_cross_validation(z: Column, mean: Column, most: Column) -> Column:
    n = F.abs(z - mean) / most
    return from_float(F.when(n < 0.5, 1.0).when(n < 1, 0.9 - 0.4 * (n - 0.5)).when(n < 2, 0.7 - 0.4 * (n - 1)).otherwise(0.3))


def of_temperature(e: Column, z: Column, low: float = -40, high: float = 85, margin: float = 5) -> Column:
    """Smallest of the factors, e being the prediction's error in standard deviations."""
    statistical = F.when(e < 1, 1 - 0.2 * e).when(e < 3, 0.8 - 0.3 * (e - 1)).otherwise(0.01)
    in_range = F.when(z.between(low + margin, high - margin), 1.0).when(z.between(low, high), 0.7).otherwise(0.3)
    return F.least(statistical, in_range, F.lit(0.8), F.lit(0.5))


def of_pressure(e: Column, h: Column) -> Column:
    return F.least(F.greatest(1 - 0.1 * e, F.lit(0.2)), F.when(h.isNull(), 0.8).when(h < 3000, 1.0).when(h < 5000, 0.7).otherwise(0.4))


def of_humidity(e: Column, t: Column) -> Column:
    band = F.when(t.isNull(), 0.8).when(t.between(0, 50), 1.0).when(t.between(-20, 70), 0.7).otherwise(0.4)
    return F.least(F.greatest(1 - 0.1 * e, F.lit(0.3)), band, F.lit(0.9))
