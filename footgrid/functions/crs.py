"""Coordinate reference transforms as Column arithmetic.

Only closed forms are offered: a longitude/latitude plane, the cylindrical
equal-area plane used for areas, spherical web-mercator and transverse mercator.
Axis order is always x = longitude / easting, y = latitude / northing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from . import geometry as G

# fixed values: WGS 84 ellipsoid and the web-mercator sphere
A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


class UnknownCrs(ValueError):
    """Raised for a reference system without a closed form here."""


def _q(sinphi: Column) -> Column:
    return (1 - E2) * (sinphi / (1 - E2 * sinphi * sinphi)
                       - F.log((1 - E * sinphi) / (1 + E * sinphi)) / (2 * E))


_QP = (1 - E2) * (1 / (1 - E2) - math.log((1 - E) / (1 + E)) / (2 * E))


def cea_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area, true at the equator."""
    return F.radians(lon) * A, _q(F.sin(F.radians(lat))) * (A / 2)


def cea_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Authalic latitude series back to geodetic latitude."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * y / (A * _QP))))
    e4, e6 = E2 ** 2, E2 ** 3
    phi = (beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
           + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta))
    return F.degrees(x / A), F.degrees(phi)


def mercator_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * A


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - F.pi() / 2)


def _arc_length(phi: Column) -> Column:
    e4, e6 = E2 ** 2, E2 ** 3
    return A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
                - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
                + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))


def tmerc_forward(lon: Column, lat: Column, lon0: float, k0: float = 1.0,
                  false_x: float = 0.0, false_y: float = 0.0) -> tuple[Column, Column]:
    """Transverse mercator series (a few degrees around ``lon0``)."""
    phi, ep2 = F.radians(lat), E2 / (1 - E2)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi)
    a = F.radians(lon - lon0) * F.cos(phi)
    x = k0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6
                  + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120)
    y = k0 * (_arc_length(phi) + n * F.tan(phi) * (
        a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return x + false_x, y + false_y


def tmerc_inverse(x: Column, y: Column, lon0: float, k0: float = 1.0,
                  false_x: float = 0.0, false_y: float = 0.0) -> tuple[Column, Column]:
    ep2, e4, e6 = E2 / (1 - E2), E2 ** 2, E2 ** 3
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = (y - false_y) / k0 / (A * (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
    p = (mu + (1.5 * e1 - 27 * e1 ** 3 / 32) * F.sin(2 * mu)
         + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(4 * mu)
         + (151 * e1 ** 3 / 96) * F.sin(6 * mu) + (1097 * e1 ** 4 / 512) * F.sin(8 * mu))
    c, t = ep2 * F.cos(p) * F.cos(p), F.tan(p) * F.tan(p)
    w = 1 - E2 * F.sin(p) * F.sin(p)
    n, r = A / F.sqrt(w), A * (1 - E2) / F.pow(w, 1.5)
    d = (x - false_x) / (n * k0)
    lat = p - n * F.tan(p) / r * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6
           + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
    return F.degrees(lon) + lon0, F.degrees(lat)


def is_geographic(crs: str) -> bool:
    return crs.upper() == "EPSG:4326"


def _tmerc_args(crs: str) -> tuple[float, float, float, float]:
    name = crs.upper()
    if name.startswith("TMERC:"):
        parts = [float(p) for p in name.split(":")[1:]]
        defaults = [0.0, 1.0, 0.0, 0.0]
        lon0, k0, fx, fy = parts + defaults[len(parts):]
        return lon0, k0, fx, fy
    if name.startswith("EPSG:326") or name.startswith("EPSG:327"):
        zone = int(name[-2:])
        return zone * 6.0 - 183.0, 0.9996, 500000.0, 10000000.0 if name[7] == "7" else 0.0
    raise UnknownCrs(f"No closed form for {crs!r}. Use EPSG:4326, EPSG:3857, CEA, a UTM zone "
                     "(EPSG:326xx / EPSG:327xx) or TMERC:lon0[:k0[:x0[:y0]]].")


def transform_xy(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates from one named system to another, through longitude/latitude."""
    if source.upper() == target.upper():
        return x, y
    src, dst = source.upper(), target.upper()
    if src == "CEA":
        x, y = cea_inverse(x, y)
    elif src == "EPSG:3857":
        x, y = mercator_inverse(x, y)
    elif not is_geographic(src):
        x, y = tmerc_inverse(x, y, *_tmerc_args(src))
    if dst == "CEA":
        return cea_forward(x, y)
    if dst == "EPSG:3857":
        return mercator_forward(x, y)
    if is_geographic(dst):
        return x, y
    return tmerc_forward(x, y, *_tmerc_args(dst))


def transform_ring(ring: Column, source: str, target: str) -> Column:
    return G.map_points(ring, lambda x, y: transform_xy(x, y, source, target)[0],
                        lambda x, y: transform_xy(x, y, source, target)[1])


def true_area(ring: Column, crs: str) -> Column:
    """Planar area, through the equal-area plane when the system is geographic."""
    return G.area(transform_ring(ring, crs, "CEA") if is_geographic(crs) else ring)
