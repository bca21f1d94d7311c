"""Numerical helpers as Column functions: safe arithmetic, flux limiters, WENO weights, array algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(F.abs(b) < 1e-15, default).otherwise(F.try_divide(a, b))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    return F.abs(a - b) < tolerance


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column) -> Column:
    """In radians, against the x axis."""
    return F.atan2(v, u)


def minmod(r: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


def superbee(r: Column) -> Column:
    """The larger of min(2r, 1) and min(r, 2), and never below 0."""
    return F.greatest(F.lit(0.0), F.least(2 * r, F.lit(1.0)), F.least(r, F.lit(2.0)))


def van_leer(r: Column) -> Column:
    return F.when(r <= 0, 0.0).otherwise(2 * r / (1 + r))


LIMITERS = {"minmod": minmod, "superbee": superbee, "van_leer": van_leer}


def weno_weights(smoothness: list[Column], left: bool = True) -> list[Column]:
    """Nonlinear weights of the three candidate stencils."""
    ideal = (0.1, 0.6, 0.3) if left else (0.3, 0.6, 0.1)
    raw = [F.lit(g) / ((b + 1e-6) * (b + 1e-6)) for g, b in zip(ideal, smoothness, strict=True)]
    return [a / (raw[0] + raw[1] + raw[2]) for a in raw]


def weno5(a: Column, b: Column, c: Column, d: Column, e: Column, left: bool = True) -> Column:
    """The value at the right face of the middle cell, from five cell values."""
    sq = lambda x: x * x
    smooth = [
        13 / 12 * sq(a - 2 * b + c) + sq(a - 4 * b + 3 * c) / 4,
        13 / 12 * sq(b - 2 * c + d) + sq(b - d) / 4,
        13 / 12 * sq(c - 2 * d + e) + sq(3 * c - 4 * d + e) / 4,
    ]
    faces = [(2 * a - 7 * b + 11 * c) / 6, (5 * c - b + 2 * d) / 6, (2 * c + 5 * d - e) / 6]
    w = weno_weights(smooth, left)
    return w[0] * faces[0] + w[1] * faces[1] + w[2] * faces[2]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def elementwise(op: str, a: Column, b: Column) -> Column:
    ops = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: F.try_divide(x, y)}
    return F.zip_with(a, b, ops[op])


def scaled(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def hours_text(hours: Column) -> Column:
    """'2 days 3 hours'."""
    return F.format_string("%d days %d hours", F.floor(hours / 24).cast("int"), F.pmod(F.floor(hours), F.lit(24)).cast("int"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def normal(*of: str | Column) -> Column:
    """A standard normal number hashed from columns: the same for the same values, wherever and whenever it is computed."""
    whole = float(1 << 53)
    share = lambda k: (F.pmod(F.xxhash64(*of, F.lit(k)), F.lit(1 << 53)) + 0.5) / whole
    return F.sqrt(-2 * F.log(share(0))) * F.cos(2 * math.pi * share(1))
