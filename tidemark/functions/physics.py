"""Physics of temperature, humidity and pressure as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEA_LEVEL, MAGNUS_A, MAGNUS_B = 1013.25, 17.27, 237.7
# How far the dew point lies under the temperature at 0, 10, ... 100 % relative humidity, in °C.
DEW_OFFSETS = (-38, -25, -18, -13, -9, -7, -5, -3, -2, -1, 0)
# Change of pressure in hPa at altitudes of -500, -400, ... 5000 m.
ALTITUDE_HPA = (
    60, 48, 36, 24, 12, 0, -12, -24, -36, -48, -60, -72, -84, -96, -108, -120, -131, -143, -154, -166, -177, -189, -200, -211, -222, -233,
    -244, -255, -266, -277, -287, -298, -308, -319, -329, -339, -349, -359, -369, -379, -389, -398, -408, -417, -427, -436,
    -445, -454, -463, -472, -481, -490, -498, -507, -515, -524,
)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def interpolate(table: tuple[float, ...], position: Column, base: Column | None = None) -> Column:
    """Linear interpolation in an array literal; positions beyond the ends take the end's value.

    A ``base`` is added to the lower entry before the step to the next one, which decides how the sum is rounded.
    """
    values = F.array(*[F.lit(float(x)) for x in table])
    at = clamp(position, 0, len(table) - 1)
    low = F.least(F.floor(at), F.lit(len(table) - 2)).cast("int")
    a, b = F.get(values, low), F.get(values, low + 1)
    return (a if base is None else base + a) + (b - a) * (at - low)


def dew_point_table(t: Column, rh: Column) -> Column:
    """From the coarse table: temperature and humidity are clamped to -40..50 °C and 0..100 %."""
    return interpolate(DEW_OFFSETS, clamp(rh, 0, 100) / 10, clamp(t, -40, 50))


def dew_point_magnus(t: Column, rh: Column) -> Column:
    """Magnus formula; -100 for no humidity."""
    g = F.log(F.when(rh > 0, rh) / 100) + MAGNUS_A * t / (MAGNUS_B + t)
    return F.when(rh <= 0, F.lit(-100.0)).otherwise(MAGNUS_B * g / (MAGNUS_A - g))


# Steps of the presets in °C, % and m.
PRESETS = {"standard": (5, 10, 100), "fine": (2, 5, 50), "small": (10, 20, 200)}


def dew_point_grid(step_t: int = 5, step_rh: int = 10) -> list[list[float]]:
    """Whole degrees of the Magnus formula at -40, ... 50 °C (rows) and 0, ... 100 % (columns)."""
    def magnus(t: float, rh: float) -> float:
        g = math.log(rh / 100) + MAGNUS_A * t / (MAGNUS_B + t)
        return MAGNUS_B * g / (MAGNUS_A - g)

    return [[float(round(magnus(t, rh))) if rh else -100.0 for rh in range(0, 101, step_rh)] for t in range(-40, 51, step_t)]


def dew_point_preset(t: Column, rh: Column, preset: str = "standard") -> Column:
    """Bilinear interpolation in a preset's grid; temperature and humidity are clamped to it."""
    step_t, step_rh, _ = PRESETS[preset]
    grid = dew_point_grid(step_t, step_rh)
    wide = len(grid[0])
    values = F.lit([x for row in grid for x in row])
    at_t, at_rh = (clamp(t, -40, 50) + 40) / step_t, clamp(rh, 0, 100) / step_rh
    i, j = F.least(F.floor(at_t), F.lit(len(grid) - 2)).cast("int"), F.least(F.floor(at_rh), F.lit(wide - 2)).cast("int")
    a, b, c, d = (F.get(values, (i + x) * wide + j + y) for x in (0, 1) for y in (0, 1))
    u, v = at_t - i, at_rh - j
    return a * (1 - u) * (1 - v) + b * (1 - u) * v + c * u * (1 - v) + d * u * v


def altitude_preset(h: Column, preset: str = "standard") -> Column:
    """Linear interpolation between whole hPa of the standard atmosphere at a preset's steps, clamped to -500..5000 m."""
    step = PRESETS[preset][2]
    exponent = 9.80665 * 0.0289644 / (8.31447 * 0.0065)
    table = tuple(float(round(SEA_LEVEL * (1 - 0.0065 * x / 288.15) ** exponent - SEA_LEVEL)) for x in range(-500, 5001, step))
    return interpolate(table, (clamp(h, -500, 5000) + 500) / step)


def sine_table(x: Column, entries: int = 64) -> Column:
    """Sine by linear interpolation between so many values of a turn."""
    turn = 2 * math.pi
    table = tuple(math.sin(turn * i / entries) for i in range(entries + 1))
    return interpolate(table, F.pmod(x, F.lit(turn)) / turn * entries)


def cosine_table(x: Column, entries: int = 64) -> Column:
    return sine_table(x + math.pi / 2, entries)


def tangent_table(x: Column, entries: int = 64) -> Column:
    """Null where the cosine is under 0.01."""
    c = cosine_table(x, entries)
    return F.when(F.abs(c) >= 0.01, sine_table(x, entries) / c)


def altitude_adjustment(h: Column) -> Column:
    """Table, in hPa, clamped to -500..5000 m."""
    return interpolate(ALTITUDE_HPA, (clamp(h, -500, 5000) + 500) / 100)


def standard_atmosphere(h: Column) -> Column:
    """Change of pressure against sea level."""
    return SEA_LEVEL * F.pow(1 - 0.0065 * h / 288.15, F.lit(9.80665 * 0.0289644 / (8.31447 * 0.0065))) - SEA_LEVEL


def pressure_to_altitude(p: Column) -> Column:
    return 288.15 / 0.0065 * (1 - F.pow(p / SEA_LEVEL, F.lit(8.31447 * 0.0065 / (9.80665 * 0.0289644))))


def expected_pressure(h: Column) -> Column:
    return SEA_LEVEL - 12.0 * h / 100


def thermal_decay(t: Column, dt_ms: Column, ambient: float = 20.0, k: float = 0.01) -> Column:
    return ambient + (t - ambient) * F.exp(-k * dt_ms / 1000.0)


def pressure_prediction(p: Column, dt_ms: Column) -> Column:
    return clamp(p + 0.01 * (SEA_LEVEL - p) * dt_ms / 3_600_000.0, 300, 1100)


def humidity_prediction(rh: Column, dt_ms: Column, tau_ms: float = 8000.0) -> Column:
    """Relaxes to 50 %; after two time constants a tenth of the distance is left."""
    x = dt_ms / tau_ms
    return 50.0 + (rh - 50.0) * F.when(x >= 2, F.lit(0.1)).otherwise(F.exp(-x))


def compensated_pressure(p: Column, t: Column, h: Column, coefficient: float = 0.0, reference_h: float = 0.0) -> Column:
    return (p + coefficient * (t - 20.0)) / F.pow(1 - 0.0065 * (h - reference_h) / 288.15, F.lit(5.255))


def safe_tan(x: Column) -> Column:
    """Null near the poles."""
    return F.when(F.abs(F.cos(x)) >= 0.01, F.tan(x))


def average_path_length(n: Column) -> Column:
    """Mean depth of a failed search among n points: 2 H(n - 1) - 2 (n - 1) / n; exact harmonic numbers up to 20."""
    exact = F.array(*[F.lit(sum(1.0 / i for i in range(1, k + 1))) for k in range(21)])
    m = n - 1
    harmonic = F.when(m <= 20, F.get(exact, F.greatest(m, F.lit(0)).cast("int"))).otherwise(F.log(m.cast("double")) + 0.5772156649015329 + 1 / (2.0 * m))
    return F.when(n <= 1, F.lit(0.0)).otherwise(2 * harmonic - 2.0 * m / n)


def anomaly_score(mean_path: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.5)).otherwise(F.pow(F.lit(2.0), -mean_path / F.when(n > 1, average_path_length(n))))
