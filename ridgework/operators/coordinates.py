"""Transverse Mercator coordinates, both ways, as column expressions: series in the third flattening, below a tenth of a millimetre within a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid's axis and flattening, scale on the central meridian, false easting and southern northing.
AXIS_M, FLATTENING, SCALE, EAST_M, SOUTH_M = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the series to the fourth order, forward, backward and of the latitude.
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def zone_of(lng: Column) -> Column:
    return (F.floor((lng + 180) / 6) + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def to_utm(lat: Column, lng: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) of a place in a zone; southern places count from ten thousand kilometres south of the equator."""
    phi, lam = F.radians(lat), F.radians(lng - central_meridian(zone))
    k = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    x, y = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = y + sum((a * F.cos(2 * j * x) * F.sinh(2 * j * y) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    north = x + sum((a * F.sin(2 * j * x) * F.cosh(2 * j * y) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    return EAST_M + SCALE * _RADIUS * east, SCALE * _RADIUS * north + F.when(lat < 0, SOUTH_M).otherwise(0.0)


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lat, lng) of coordinates of a zone's northern or southern half."""
    x, y = (northing - F.when(south, SOUTH_M).otherwise(0.0)) / (SCALE * _RADIUS), (easting - EAST_M) / (SCALE * _RADIUS)
    x0 = x - sum((b * F.sin(2 * j * x) * F.cosh(2 * j * y) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    y0 = y - sum((b * F.cos(2 * j * x) * F.sinh(2 * j * y) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x0) / F.cosh(y0))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), F.lit(0.0))
    return F.degrees(phi), central_meridian(zone) + F.degrees(F.atan2(F.sinh(y0), F.cos(x0)))


def grid_digits(text: Column) -> Column:
    """struct(easting, northing): three or four digits each of a grid reference; six or eight digits in all, whatever stands between them, else null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    half = lambda n: F.struct(F.substring(digits, 1, n).alias("easting"), F.substring(digits, n + 1, n).alias("northing"))
    return F.when(F.length(digits) == 6, half(3)).when(F.length(digits) == 8, half(4))
