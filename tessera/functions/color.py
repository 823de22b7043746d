"""Colour values and bands behind overlays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rgb = tuple[float, float, float]

#: The ends and middles of the maps.
BLUE, WHITE, RED = (0.23, 0.30, 0.75), (0.95, 0.95, 0.95), (0.71, 0.02, 0.15)
DARK, MIDDLE, LIGHT = (0.27, 0.00, 0.33), (0.13, 0.57, 0.55), (0.99, 0.91, 0.14)


def _mix(t: Column, a: Rgb, b: Rgb) -> list[Column]:
    return [F.lit(x) + (F.lit(y) - F.lit(x)) * t for x, y in zip(a, b, strict=True)]


def _pieces(t: Column, low: Rgb, mid: Rgb, high: Rgb) -> list[Column]:
    c = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return [F.when(c < 0.5, a).otherwise(b) for a, b in zip(_mix(c * 2, low, mid), _mix(c * 2 - 1, mid, high), strict=True)]


def diverging(value: Column, reach: Column) -> list[Column]:
    """Red, green, blue of a value in [-reach, reach]; white at 0."""
    return _pieces(F.coalesce(F.try_divide(value, reach), F.lit(0.0)) / 2 + 0.5, BLUE, WHITE, RED)


def sequential(value: Column, top: Column) -> list[Column]:
    """Red, green, blue of a value in [0, top]."""
    return _pieces(F.coalesce(F.try_divide(value, top), F.lit(0.0)), DARK, MIDDLE, LIGHT)


def categorical(k: Column) -> Column:
    """A hue in [0, 1) per number, neighbours far apart."""
    return F.pmod(k * F.lit(0.6180339887498949), F.lit(1.0))


def robust_range(df: DataFrame, value: str, by: list[str], q: float = 0.98) -> DataFrame:
    """by..., reach: sorted[min(n - 1, floor(q n))] of the finite absolute values."""
    w = Window.partitionBy(*by)
    r = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.abs(value).alias("_v"))
    r = r.withColumns({"_r": F.row_number().over(w.orderBy("_v")), "_n": F.count("*").over(w)})
    return r.where(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n"))) + 1).select(*by, F.col("_v").alias("reach"))


def isoline_band(d: Column, top: Column, bands: int = 20) -> Column:
    """Which of the equal bands of [0, top] a distance falls into."""
    return F.floor(F.try_divide(d * bands, top))
