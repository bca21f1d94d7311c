"""Physics of sea water and data assimilation weights as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rotation of the earth, gravity, reference density, ranges of a physical state.
OMEGA, GRAVITY, RHO0 = 7.2921159e-5, 9.81, 1025.0
LIMITS = {"temperature": (-2.0, 35.0), "salinity": (0.0, 45.0), "ice_concentration": (0.0, 1.0), "ice_thickness": (0.0, 20.0)}
MAX_SPEED, LEAST_ICE = 5.0, 0.01

#: The published polynomials of the international equation of state, by powers of the temperature.
PURE_WATER = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
SALT_A = (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
SALT_B = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
SALT_C = 4.8314e-4
BULK = (19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5)
BULK_A = (54.6746, -0.603459, 1.09987e-2, -6.1670e-5)
BULK_B = (7.944e-2, 1.6483e-2, -5.3009e-4)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """By Horner's rule, the constant first."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def surface_density(t: Column, s: Column) -> Column:
    return polynomial(t, PURE_WATER) + polynomial(t, SALT_A) * s + polynomial(t, SALT_B) * s * F.sqrt(s) + SALT_C * s * s


def density_a(t: Column, s: Column, pressure: Column) -> Column:
    """Density with the full secant bulk modulus; the pressure is divided by 10,000."""
    k = polynomial(t, BULK) + s * polynomial(t, BULK_A) + s * F.sqrt(s) * polynomial(t, BULK_B)
    return surface_density(t, s) / (1 - pressure / 10000.0 / k)


def density_b(t: Column, s: Column, pressure: Column) -> Column:
    """Density with the shortened bulk modulus of the flow model; the pressure is in pascals."""
    k = polynomial(t, BULK[:4]) + s * polynomial(t, BULK_A[:3])
    return surface_density(t, s) * (1 + pressure * 1e-5 / k)


def geostrophic(slope: Column, lat: Column) -> Column:
    """Velocity from a surface slope; 0 near the equator."""
    f = coriolis(lat)
    return F.when(F.abs(f) < 1e-10, 0.0).otherwise(F.try_divide(GRAVITY * slope, f))


def hydrostatic_pressure(density: Column, eta: Column, depth: Column | float = 1000.0) -> Column:
    return density * GRAVITY * (F.lit(depth) if not isinstance(depth, Column) else depth) + density * GRAVITY * eta


def rossby_number(speed: Column, lat: Column, length: float = 100_000.0) -> Column:
    f = F.abs(coriolis(lat))
    return F.when(f > 1e-10, F.try_divide(speed, f * length)).otherwise(0.0)


def gaspari_cohn(r: Column) -> Column:
    """The fifth-order compactly supported correlation; r is the distance over the radius, 0 from 2 on."""
    near = (((-0.25 * r + 0.5) * r + 0.625) * r - 5.0 / 3.0) * r * r + 1.0
    far = ((((r / 12.0 - 0.5) * r + 0.625) * r + 5.0 / 3.0) * r - 5.0) * r + 4.0 - F.try_divide(F.lit(2.0), 3.0 * r)
    return F.when(r <= 1, near).when(r <= 2, far).otherwise(0.0)


def physically_valid(t: Column, s: Column, ice: Column, thickness: Column, speed: Column) -> Column:
    values = dict(zip(LIMITS, (t, s, ice, thickness), strict=True))
    out = speed <= MAX_SPEED
    for name, (lo, hi) in LIMITS.items():
        out = out & values[name].between(lo, hi)
    return out


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull(), F.greatest(as_col(lo), F.least(as_col(hi), x)))


def constrained(name: str, x: Column) -> Column:
    """A state variable kept inside its physical range."""
    return clamp(x, *LIMITS[name])


def constrained_velocity(u: Column, v: Column) -> Column:
    """Both components, scaled so that the speed stays below the limit."""
    speed = F.sqrt(u * u + v * v)
    k = F.when(speed > MAX_SPEED, F.try_divide(F.lit(MAX_SPEED), speed)).otherwise(1.0)
    return F.struct((u * k).alias("u"), (v * k).alias("v"))
