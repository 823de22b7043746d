"""Vector algebra on triples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """The columns ``{prefix}x, {prefix}y, {prefix}z``."""
    return F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z")


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def scale(a: Vec, s: Column) -> Vec:
    return a[0] * s, a[1] * s, a[2] * s


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def angle(u: Vec, w: Vec) -> Column:
    """Angle between two vectors, as atan2 of the sine and cosine parts."""
    return F.atan2(norm(cross(u, w)), dot(u, w))


def cot(u: Vec, w: Vec) -> Column:
    """Cotangent of the angle between two vectors; null if they are parallel."""
    return F.try_divide(dot(u, w), norm(cross(u, w)))


def named(v: Vec, prefix: str) -> list[Column]:
    return [c.alias(prefix + k) for c, k in zip(v, "xyz", strict=True)]


def kahan_heron(a: Column, b: Column, c: Column) -> Column:
    """Triangle area from side lengths, stable for needles; 0 if they make no triangle."""
    s = F.array_sort(F.array(a, b, c))
    z, y, x = s[0], s[1], s[2]
    t = (x + (y + z)) * (z - (x - y)) * (z + (x - y)) * (x + (y - z))
    return F.lit(0.25) * F.sqrt(F.greatest(t, F.lit(0.0)))
