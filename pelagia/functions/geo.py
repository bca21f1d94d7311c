"""Earth geometry as Column functions: projections, distances, bearings, local grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 axes, mean radius, metres and kilometres for a degree.
WGS84_A, WGS84_B, EARTH_RADIUS = 6378137.0, 6356752.314245, 6371000.0
M_PER_DEGREE, KM_PER_DEGREE = 111320.0, 111.32
FLATTENING = (WGS84_A - WGS84_B) / WGS84_A
E2 = 2 * FLATTENING - FLATTENING**2


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _sq(x: Column) -> Column:
    return x * x


def normal_radius(phi: Column) -> Column:
    """Radius of curvature in the prime vertical, at latitude phi in radians."""
    return F.lit(WGS84_A) / F.sqrt(1 - E2 * _sq(F.sin(phi)))


def geographic_to_cartesian(lon: Column, lat: Column, alt: Column | float = 0.0) -> Column:
    """Earth-centred x, y, z in metres."""
    lam, phi, h = F.radians(lon), F.radians(lat), _c(alt)
    n = normal_radius(phi)
    return F.struct(
        ((n + h) * F.cos(phi) * F.cos(lam)).alias("x"),
        ((n + h) * F.cos(phi) * F.sin(lam)).alias("y"),
        ((n * (1 - E2) + h) * F.sin(phi)).alias("z"),
    )


def cartesian_to_geographic(x: Column, y: Column, z: Column) -> Column:
    """lon, lat, alt by one step of Bowring's method."""
    p = F.sqrt(_sq(x) + _sq(y))
    theta = F.atan2(z * WGS84_A, p * WGS84_B)
    s, c = F.sin(theta), F.cos(theta)
    phi = F.atan2(z + E2 * WGS84_B / (1 - E2) * s * s * s, p - E2 * WGS84_A * c * c * c)
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(phi).alias("lat"), (p / F.cos(phi) - normal_radius(phi)).alias("alt"))


def mercator(lon: Column, lat: Column, central_meridian: float = 0.0, false_easting: float = 0.0, false_northing: float = 0.0, radius: float = WGS84_A) -> Column:
    phi = F.radians(lat)
    return F.struct(
        (F.radians(lon - central_meridian) * radius + false_easting).alias("x"),
        (F.ln(F.tan(math.pi / 4 + phi / 2)) * radius + false_northing).alias("y"),
    )


def inverse_mercator(x: Column, y: Column, central_meridian: float = 0.0, false_easting: float = 0.0, false_northing: float = 0.0, radius: float = WGS84_A) -> Column:
    return F.struct(
        (F.degrees((x - false_easting) / radius) + central_meridian).alias("lon"),
        F.degrees(2 * F.atan(F.exp((y - false_northing) / radius)) - math.pi / 2).alias("lat"),
    )


def stereographic(lon: Column, lat: Column, central_meridian: float = 0.0, central_parallel: float = 90.0) -> Column:
    """Polar at a central parallel of ±90 degrees, oblique elsewhere."""
    lam, phi = F.radians(lon - central_meridian), F.radians(lat)
    if abs(central_parallel) == 90:
        sign = math.copysign(1, central_parallel)
        k = F.lit(2 * WGS84_A) / (1 + sign * F.sin(phi))
        return F.struct((k * F.cos(phi) * F.sin(lam)).alias("x"), (-sign * k * F.cos(phi) * F.cos(lam)).alias("y"))
    s0, c0 = math.sin(math.radians(central_parallel)), math.cos(math.radians(central_parallel))
    k = F.lit(2 * WGS84_A) / (1 + s0 * F.sin(phi) + c0 * F.cos(phi) * F.cos(lam))
    return F.struct((k * F.cos(phi) * F.sin(lam)).alias("x"), (k * (c0 * F.sin(phi) - s0 * F.cos(phi) * F.cos(lam))).alias("y"))


def meridian_arc(phi: Column) -> Column:
    """Length of the meridian from the equator to latitude phi in radians."""
    e4, e6 = E2**2, E2**3
    terms = (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 * (E2 + e4 / 4 + 15 * e6 / 128) / 8, 15 * (e4 + 3 * e6 / 4) / 256, 35 * e6 / 3072)
    return WGS84_A * (terms[0] * phi - terms[1] * F.sin(2 * phi) + terms[2] * F.sin(4 * phi) - terms[3] * F.sin(6 * phi))


def transverse_mercator(lon: Column, lat: Column, central_meridian: Column | float, scale: float = 1.0, false_easting: float = 0.0, false_northing: Column | float = 0.0) -> Column:
    """x and y by the usual series to the sixth order."""
    phi = F.radians(lat)
    n, t, c = normal_radius(phi), _sq(F.tan(phi)), E2 / (1 - E2) * _sq(F.cos(phi))
    a = F.cos(phi) * F.radians(lon - _c(central_meridian))
    a2, a3 = a * a, a * a * a
    x = scale * n * (a + (1 - t + c) * a3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * E2) * a3 * a2 / 120) + false_easting
    y = scale * (meridian_arc(phi) + n * F.tan(phi) * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * E2) * a3 * a3 / 720)) + _c(false_northing)
    return F.struct(x.alias("x"), y.alias("y"))


def utm(lon: Column, lat: Column) -> Column:
    """x, y, zone and hemisphere; zone 60 holds the 180th meridian."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    north = lat >= 0
    xy = transverse_mercator(lon, lat, (zone - 1) * 6.0 - 177.0, 0.9996, 500000.0, F.when(north, 0.0).otherwise(10000000.0))
    return F.struct(xy["x"].alias("x"), xy["y"].alias("y"), zone.alias("zone"), F.when(north, "N").otherwise("S").alias("hemisphere"))


def _turned(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (x * c - y * s, x * s + y * c) if degrees else (x, y)


def grid_to_geographic(gx: Column, gy: Column, origin_lon: float, origin_lat: float, dx: float, dy: float, rotation: float = 0.0) -> Column:
    x, y = _turned(gx * dx, gy * dy, rotation)
    return F.struct((x / (M_PER_DEGREE * math.cos(math.radians(origin_lat))) + origin_lon).alias("lon"), (y / M_PER_DEGREE + origin_lat).alias("lat"))


def geographic_to_grid(lon: Column, lat: Column, origin_lon: float, origin_lat: float, dx: float, dy: float, rotation: float = 0.0) -> Column:
    """Whole grid coordinates, halves to even."""
    x, y = _turned((lon - origin_lon) * (M_PER_DEGREE * math.cos(math.radians(origin_lat))), (lat - origin_lat) * M_PER_DEGREE, -rotation)
    return F.struct(F.bround(x / dx).cast("long").alias("gx"), F.bround(y / dy).cast("long").alias("gy"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance in the unit of the radius."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = _sq(F.sin((p2 - p1) / 2)) + F.cos(p1) * F.cos(p2) * _sq(F.sin(F.radians(lon2 - lon1) / 2))
    a = F.when(a > 1, 1.0).otherwise(a)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees from 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, F.lit(360.0))


def destination(lon: Column, lat: Column, bearing_deg: Column, distance: Column, radius: float = EARTH_RADIUS) -> Column:
    """The point at a distance along an initial bearing."""
    p, b, d = F.radians(lat), F.radians(bearing_deg), distance / radius
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lam = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.struct(F.degrees(lam).alias("lon"), F.degrees(p2).alias("lat"))


def planar_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on a plane with longitudes shortened at the first point's latitude."""
    return F.sqrt(_sq((lat2 - lat1) * KM_PER_DEGREE) + _sq((lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians(lat1))))


def transform_point(source: str, target: str, x: Column, y: Column) -> Column:
    """x and y from one reference system to another; pairs that are not supported raise an error when the query is built."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    made = {
        ("WGS84", "MERCATOR"): lambda: mercator(x, y),
        ("MERCATOR", "WGS84"): lambda: inverse_mercator(x, y),
        ("WGS84", "UTM"): lambda: utm(x, y),
    }.get((source.upper(), target.upper()))
    if made is None:
        raise NotImplementedError(f"{source} to {target}")
    names = ("lon", "lat") if target.upper() == "WGS84" else ("x", "y")
    return F.struct(made()[names[0]].alias("x"), made()[names[1]].alias("y"))


def transform_chain(systems: list[str], x: Column, y: Column) -> Column:
    """Through several systems, one after the other."""
    point = F.struct(x.alias("x"), y.alias("y"))
    for a, b in zip(systems, systems[1:], strict=False):
        point = transform_point(a, b, point["x"], point["y"])
    return point


def valid_coordinates(lon: Column, lat: Column, system: str = "WGS84") -> Column:
    return (lon.between(-180, 180) & lat.between(-90, 90)) if system == "WGS84" else F.lit(True)


def spherical_to_cartesian(r: Column, theta: Column, phi: Column) -> Column:
    """theta is the azimuth and phi the angle from the pole, in radians."""
    return F.struct((r * F.sin(phi) * F.cos(theta)).alias("x"), (r * F.sin(phi) * F.sin(theta)).alias("y"), (r * F.cos(phi)).alias("z"))


def cartesian_to_spherical(x: Column, y: Column, z: Column) -> Column:
    r = F.sqrt(_sq(x) + _sq(y) + _sq(z))
    return F.struct(r.alias("r"), F.atan2(y, x).alias("theta"), F.acos(F.when(r > 0, z / F.nullif(r, F.lit(0.0))).otherwise(F.lit(1.0))).alias("phi"))


def world_to_grid(x: Column, origin: float, spacing: float, n: int) -> Column:
    """The nearest grid index, halves away from zero, kept inside the axis."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round((x - origin) / spacing).cast("int")))


def drift_direction(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """North or South if the latitude changed more, else East or West."""
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return F.when(F.abs(dlat) > F.abs(dlon), F.when(dlat > 0, "North").otherwise("South")).otherwise(F.when(dlon > 0, "East").otherwise("West"))


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of crossings; the ring closes itself."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1
