"""Coordinate reference systems in closed form.

Known: EPSG:4326, 3857, UTM on WGS 84 (326xx, 327xx) and EPSG:4526 (CGCS2000,
3-degree Gauss-Kruger zone 38). x is east and y is north everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public EPSG parameters.
MERCATOR_RADIUS = 6378137.0
WGS84 = (6378137.0, 1 / 298.257223563)
CGCS2000 = (6378137.0, 1 / 298.257222101)
UTM_SCALE, UTM_EASTING, UTM_SOUTHING = 0.9996, 500_000.0, 10_000_000.0
GK38_MERIDIAN, GK38_EASTING = 114.0, 38_500_000.0


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: tuple[float, float]
    meridian: float
    scale: float
    easting: float
    northing: float


def normalise(crs) -> str | None:
    """'EPSG:n' from 'EPSG:n', 'epsg:n', n or None."""
    if crs is None:
        return None
    text = str(crs).upper().strip()
    text = text if text.startswith("EPSG:") else f"EPSG:{text}"
    if not text[5:].isdigit():
        raise ValueError(f"not a CRS: {crs}")
    return text


def is_geographic(crs) -> bool:
    return normalise(crs) == "EPSG:4326"


def _projection(code: int) -> TransverseMercator:
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        south = code >= 32700
        return TransverseMercator(WGS84, -183.0 + 6 * (code % 100), UTM_SCALE, UTM_EASTING, UTM_SOUTHING * south)
    if code == 4526:
        return TransverseMercator(CGCS2000, GK38_MERIDIAN, 1.0, GK38_EASTING, 0.0)
    raise NotImplementedError(f"EPSG:{code} has no closed form here")


def transform(x: Column, y: Column, source, target) -> tuple[Column, Column]:
    """Coordinates of one CRS in another, by way of longitude and latitude in degrees."""
    source, target = normalise(source), normalise(target)
    if source is None or target is None:
        raise ValueError("both CRS must be known")
    if source == target:
        return x, y
    lon, lat = _to_degrees(x, y, int(source[5:]))
    return _from_degrees(lon, lat, int(target[5:]))


def _to_degrees(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return x, y
    if code == 3857:
        return F.degrees(x / MERCATOR_RADIUS), F.degrees(F.lit(math.pi / 2) - 2 * F.atan(F.exp(-y / MERCATOR_RADIUS)))
    return _inverse(_projection(code), x, y)


def _from_degrees(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return lon, lat
    if code == 3857:
        return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS
    return _forward(_projection(code), lon, lat)


# Krueger's series to the fourth order in the third flattening n, as
# (power of n, numerator, denominator) of each term.
ALPHA = (
    ((1, 1, 2), (2, -2, 3), (3, 5, 16), (4, 41, 180)),
    ((2, 13, 48), (3, -3, 5), (4, 557, 1440)),
    ((3, 61, 240), (4, -103, 140)),
    ((4, 49561, 161280),),
)
BETA = (
    ((1, 1, 2), (2, -2, 3), (3, 37, 96), (4, -1, 360)),
    ((2, 1, 48), (3, 1, 15), (4, -437, 1440)),
    ((3, 17, 480), (4, -37, 840)),
    ((4, 4397, 161280),),
)


def _series(terms, n: float) -> list[float]:
    return [sum(n**p * a / b for p, a, b in row) for row in terms]


def _constants(p: TransverseMercator) -> tuple[float, float, float]:
    """(n, rectifying radius times scale, eccentricity)."""
    a, f = p.ellipsoid
    n = f / (2 - f)
    return n, p.scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), math.sqrt(f * (2 - f))


def _forward(p: TransverseMercator, lon: Column, lat: Column) -> tuple[Column, Column]:
    n, radius, e = _constants(p)
    phi, lam = F.radians(lat), F.radians(lon - p.meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_series(ALPHA, n), 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return radius * east + p.easting, radius * north + p.northing


def _inverse(p: TransverseMercator, x: Column, y: Column) -> tuple[Column, Column]:
    n, radius, e = _constants(p)
    xi, eta = (y - p.northing) / radius, (x - p.easting) / radius
    xi1, eta1 = xi, eta
    for j, b in enumerate(_series(BETA, n), 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    conformal = F.sin(xi1) / F.sqrt(F.pow(F.sinh(eta1), F.lit(2.0)) + F.pow(F.cos(xi1), F.lit(2.0)))
    # isometric latitude back to latitude: a contraction by e^2 a step, six reach the last digit
    q = F.asinh(conformal)
    s = F.tanh(q)
    for _ in range(6):
        s = F.tanh(q + e * F.atanh(e * s))
    return F.degrees(lam) + p.meridian, F.degrees(F.asin(s))
