"""Distances and the national grid projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col

# The GRS80 ellipsoid and the national grid's origin, scale and offsets.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
GRID_LAT0, GRID_LON0 = 53.5, -8.0
GRID_SCALE = 0.99982
GRID_EAST, GRID_NORTH = 600000.0, 750000.0
KM_PER_DEGREE = 111.2

_n = FLATTENING / (2 - FLATTENING)
_ecc = math.sqrt(FLATTENING * (2 - FLATTENING))
_radius = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
# Krueger's forward series to fourth order in the third flattening.
KRUEGER = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)


def _conformal_tangent(sin_lat: Column) -> Column:
    return F.sinh(F.atanh(sin_lat) - F.lit(_ecc) * F.atanh(F.lit(_ecc) * sin_lat))


def _origin_northing() -> float:
    s = math.sin(math.radians(GRID_LAT0))
    xi = math.atan(math.sinh(math.atanh(s) - _ecc * math.atanh(_ecc * s)))
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(KRUEGER))


def grid_xy(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Easting and northing in metres on the national transverse Mercator grid."""
    lam = F.radians(col(lon) - F.lit(GRID_LON0))
    t = _conformal_tangent(F.sin(F.radians(col(lat))))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(KRUEGER, start=1):
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    size = F.lit(GRID_SCALE * _radius)
    return (
        F.lit(GRID_EAST) + size * east,
        F.lit(GRID_NORTH) + size * (north - F.lit(_origin_northing())),
    )


def km_between(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Planar distance in km, longitude shrunk at the first point's latitude."""
    dy = (col(lat1) - col(lat2)) * KM_PER_DEGREE
    dx = (col(lon1) - col(lon2)) * KM_PER_DEGREE * F.cos(F.radians(col(lat1)))
    return F.sqrt(dy * dy + dx * dx)


def metres_between(ax, ay, bx, by) -> Column:
    dx, dy = col(ax).cast("double") - col(bx), col(ay).cast("double") - col(by)
    return F.sqrt(dx * dx + dy * dy)


def metres_to_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment, its projection clamped to the ends."""
    px, py, ax, ay, bx, by = (col(c).cast("double") for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))
    )
    ex, ey = px - ax - t * dx, py - ay - t * dy
    return F.sqrt(ex * ex + ey * ey)


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Which side of a-b the point c is on: -1, 0 or 1."""
    ax, ay, bx, by, cx, cy = (col(c).cast("double") for c in (ax, ay, bx, by, cx, cy))
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("int")
