"""Per-flow expressions. A flow is four doubles: origin (ox, oy), destination (dx, dy)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDINATES = ("ox", "oy", "dx", "dy")
MODES = ("max", "sum", "min", "mean", "weighted")
#: Mean radius of the earth in km.
EARTH_KM = 6371.0


def columns(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in COORDINATES)


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; rounding that takes the haversine over 1 is cut off."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def length(prefix: str = "") -> Column:
    """Planar length in units of the CRS."""
    ox, oy, dx, dy = columns(prefix)
    return point_distance(dx, dy, ox, oy)


def angle(prefix: str = "") -> Column:
    """Direction in radians, counter-clockwise from east, in [-pi, pi]."""
    ox, oy, dx, dy = columns(prefix)
    return F.atan2(dy - oy, dx - ox)


def guarded_division(a: Column, b: Column) -> Column:
    """a / b with inf for a positive a over zero and NaN for 0 / 0, instead of an error."""
    return F.when(b != 0, a / b).when(a > 0, F.lit(math.inf)).otherwise(F.lit(math.nan))


def combine(do: Column, dd: Column, mode: str, w1: float = 1.0, w2: float = 1.0, lengths: Column | None = None, linear: bool = False) -> Column:
    """A flow distance from the distances of origins and destinations.

    weighted: sqrt(w1 do^2 + w2 dd^2), over the product of both lengths where lengths is
    given; linear: w1 do + w2 dd, the row-wise form without lengths.
    """
    if mode == "max":
        return F.greatest(do, dd)
    if mode == "min":
        return F.least(do, dd)
    if mode == "sum":
        return do + dd
    if mode == "mean":
        return (do + dd) / 2
    if mode == "weighted":
        if lengths is None and linear:
            return w1 * do + w2 * dd
        square = F.lit(float(w1)) * do * do + F.lit(float(w2)) * dd * dd
        return F.sqrt(square if lengths is None else guarded_division(square, lengths))
    raise ValueError(f"distance must be one of {MODES}, not {mode!r}")


def flow_distance(a: str, b: str, mode: str = "max", w1: float = 1.0, w2: float = 1.0, use_length: bool = False, geographic: bool = False, linear: bool = False) -> Column:
    """Distance of the flows in columns a+ox.. and b+ox..; geographic: in km on the sphere."""
    measure = haversine_km if geographic else point_distance
    p, q = columns(a), columns(b)
    lengths = length(a) * length(b) if mode == "weighted" and use_length else None
    return combine(measure(*p[:2], *q[:2]), measure(*p[2:], *q[2:]), mode, w1, w2, lengths, linear)


def wkt(prefix: str = "") -> Column:
    """FLOW (x1 y1, x2 y2), or FLOW EMPTY where a coordinate is missing."""
    ox, oy, dx, dy = (c.cast("string") for c in columns(prefix))
    return F.coalesce(F.concat(F.lit("FLOW ("), ox, F.lit(" "), oy, F.lit(", "), dx, F.lit(" "), dy, F.lit(")")), F.lit("FLOW EMPTY"))


def geo_interface(prefix: str = "") -> Column:
    ox, oy, dx, dy = columns(prefix)
    return F.to_json(F.struct(F.lit("Flow").alias("type"), F.array(F.array(ox, oy), F.array(dx, dy)).alias("coordinates")))


def svg(scale_factor: float = 1.0, fill_color: str = "#66cc99", opacity: float = 0.6, prefix: str = "") -> Column:
    """Two circles, for display."""
    ox, oy, dx, dy = columns(prefix)
    circle = lambda x, y: F.concat(F.lit('<circle cx="'), x.cast("string"), F.lit('" cy="'), y.cast("string"), F.lit(f'" r="{3.0 * scale_factor}" stroke="#555555" stroke-width="{1.0 * scale_factor}" fill="{fill_color}" opacity="{opacity}" />'))
    return F.coalesce(F.concat(F.lit("<g>"), circle(ox, oy), circle(dx, dy), F.lit("</g>")), F.lit("<g />"))
