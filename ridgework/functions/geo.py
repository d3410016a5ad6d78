"""Geodesy and hex-grid algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, METRES_PER_DEGREE = 6_371_000.0, 111_320.0
#: Axial offsets of the six neighbours of a hex cell.
NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def slope_deg(rise: Column, run: Column) -> Column:
    """Unsigned slope angle; 0 over no distance."""
    return F.when(run == 0, 0.0).otherwise(F.degrees(F.atan(F.abs(rise) / F.nullif(run, F.lit(0.0)))))


def mock_elevation_m(lat: Column, lng: Column) -> Column:
    """The deterministic stand-in for a terrain model; results on it are estimates."""
    return F.greatest(F.lit(0.0), 100 + F.sin(0.07 * lat) * 120 + F.cos(0.05 * lng) * 80)


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lng: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lng) of the point at a bearing and distance on the sphere."""
    delta, theta, phi = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta))
    lam = F.radians(lng) + F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * F.sin(to))
    return F.degrees(to), F.degrees(lam)


def hex_center(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    """Local metres of a pointy-top axial cell."""
    return size * (3**0.5 * q + 3**0.5 / 2 * r), size * 1.5 * r


def hex_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def neighbour_array() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("dir"), F.lit(a).alias("dq"), F.lit(b).alias("dr")) for i, (a, b) in enumerate(NEIGHBOURS)))


def to_local(lat: Column, lng: Column, lat0: float, lng0: float) -> tuple[Column, Column]:
    """Local metres (x, y) east and north of an origin."""
    return (lng - lng0) * (METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0)))), (lat - lat0) * METRES_PER_DEGREE


def from_local(x: Column, y: Column, lat0: float, lng0: float) -> tuple[Column, Column]:
    """(lat, lng) of local metres."""
    return F.lit(lat0) + y / METRES_PER_DEGREE, F.lit(lng0) + x / (METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0))))
