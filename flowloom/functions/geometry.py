"""Polygons as Spark expressions.

A polygon is a list of parts, a part a list of rings (the first the shell, the
others holes), a ring a list of (x, y). Boundary points are outside for ``within``
and inside for ``intersects``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = tuple[tuple[float, float], ...]
RINGS = "array<array<array<struct<x:double,y:double>>>>"
BANDS = "array<array<array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>>>>"
#: Edges up to which a mask is spelt out, one comparison each; a larger one is a constant array of bands.
SPELT_EDGES = 200
BAND_COPIES = 8


@dataclass(frozen=True)
class Polygon:
    """One polygon or several, with holes."""

    parts: tuple[tuple[Ring, ...], ...]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = [x for part in self.parts for x, _ in part[0]]
        ys = [y for part in self.parts for _, y in part[0]]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def is_box(self) -> bool:
        if len(self.parts) != 1 or len(self.parts[0]) != 1:
            return False
        x0, y0, x1, y1 = self.bounds
        return len(self.parts[0][0]) == 5 and set(self.parts[0][0]) == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}

    def to_wkt(self) -> str:
        ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")"
        parts = ["(" + ", ".join(map(ring, p)) + ")" for p in self.parts]
        return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def box(minx: float, miny: float, maxx: float, maxy: float) -> Polygon:
    corners = ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))
    return Polygon(((tuple((float(x), float(y)) for x, y in corners),),))


def as_polygon(mask) -> Polygon:
    """A Polygon from a Polygon, a (minx, miny, maxx, maxy) tuple, WKT, GeoJSON, a ring, or a list of any of these (their union)."""
    if isinstance(mask, Polygon):
        return mask
    if isinstance(mask, str):
        return _from_geojson(json.loads(mask)) if mask.lstrip().startswith("{") else _from_wkt(mask)
    if isinstance(mask, dict):
        return _from_geojson(mask)
    if isinstance(mask, Sequence) and len(mask) == 4 and all(isinstance(v, (int, float)) for v in mask):
        return box(*mask)
    if isinstance(mask, Sequence) and mask and all(isinstance(v, Sequence) and len(v) in (2, 3) and all(isinstance(x, (int, float)) for x in v) for v in mask):
        return Polygon(((_closed(mask),),))
    if isinstance(mask, Sequence) and mask:
        return Polygon(tuple(part for m in mask for part in as_polygon(m).parts))
    raise TypeError(f"not a polygon: {type(mask).__name__}")


def _closed(ring) -> Ring:
    points = tuple((float(p[0]), float(p[1])) for p in ring)
    if len(set(points)) < 3:
        raise ValueError("a ring needs three different points")
    return points if points[0] == points[-1] else (*points, points[0])


def _from_geojson(value: dict) -> Polygon:
    kind = value.get("type")
    if kind == "Feature":
        return _from_geojson(value["geometry"])
    if kind == "FeatureCollection":
        return as_polygon([f["geometry"] for f in value["features"]])
    if kind == "Polygon":
        return Polygon((tuple(map(_closed, value["coordinates"])),))
    if kind == "MultiPolygon":
        return Polygon(tuple(tuple(map(_closed, p)) for p in value["coordinates"]))
    raise TypeError(f"not a polygon: {kind}")


def _from_wkt(text: str) -> Polygon:
    m = re.match(r"\s*(MULTI)?POLYGON\s*(?:Z\s*)?\(", text, re.I)
    if not m:
        raise TypeError(f"not a polygon: {text[:40]}")
    nested = re.sub(r"([-+\d.eE]+(?:\s+[-+\d.eE]+)+)", lambda p: "[" + ",".join(p[1].split()) + "]", text[m.end() - 1 :])
    value = json.loads(nested.replace("(", "[").replace(")", "]"))
    parts = value if m[1] else [value]
    return Polygon(tuple(tuple(map(_closed, p)) for p in parts))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains(polygon: Polygon, x: Column, y: Column, boundary: bool = False) -> Column:
    """Is (x, y) inside? The bounding box comes first, so that file statistics can skip rows. Null for null coordinates, which a filter drops."""
    x0, y0, x1, y1 = polygon.bounds
    if boundary:
        inside = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
    else:
        inside = (x > x0) & (x < x1) & (y > y0) & (y < y1)
    if polygon.is_box:
        return inside
    if sum(len(ring) - 1 for part in polygon.parts for ring in part) <= SPELT_EDGES:
        return inside & _any([_in_part(part, x, y, boundary) for part in polygon.parts])
    return inside & _in_bands(polygon, x, y, boundary)


def _in_part(part: tuple[Ring, ...], x: Column, y: Column, boundary: bool) -> Column:
    """Crossing parity over all edges of a part; a point on an edge counts as the boundary flag says.

    The sign of one cross product says on which side of an edge a point lies and whether it touches, so that both agree.
    """
    crossings, touches = [], []
    for ring in part:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            side = F.lit(bx - ax) * (y - F.lit(ay)) - F.lit(by - ay) * (x - F.lit(ax))
            if ay != by:
                crossings.append(F.when(((y < ay) != (y < by)) & (side > 0 if ay < by else side < 0), 1).otherwise(0))
            touches.append((side == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    odd = reduce(lambda a, b: a + b, crossings) % 2 == 1
    on_edge = _any(touches)
    return odd | on_edge if boundary else odd & ~on_edge


def in_rings(rings: Column, x: Column, y: Column, boundary: bool) -> Column:
    """Ray casting over a column of polygons, by higher-order functions."""
    def edges(ring: Column) -> Column:
        return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    return F.exists(rings, lambda part: _within_edges(F.flatten(F.transform(part, edges)), x, y, boundary))


def _within_edges(every: Column, x: Column, y: Column, boundary: bool) -> Column:
    """Crossing parity over a column of edges (p, q) of one part."""
    def side(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        left = F.when(p["y"] < q["y"], side(e) > 0).otherwise(side(e) < 0)
        return F.coalesce(((y < p["y"]) != (y < q["y"])) & left, F.lit(False))

    def touches(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return (side(e) == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    odd, edge = F.size(F.filter(every, crosses)) % 2 == 1, F.exists(every, touches)
    return odd | edge if boundary else odd & ~edge


def _in_bands(polygon: Polygon, x: Column, y: Column, boundary: bool) -> Column:
    """The same over a constant array of bands of y: a point looks at the edges that reach into its band, part by part.

    Bands get wider until edges are entered BAND_COPIES times each at most on average.
    """
    _, low, _, high = polygon.bounds
    parts = [[(a, b) for ring in part for a, b in zip(ring, ring[1:], strict=False)] for part in polygon.parts]
    total = sum(map(len, parts))
    n = total
    while True:
        height = (high - low) / n if high > low else 1.0
        reach = [[[min(n - 1, max(0, math.floor((v - low) / height))) for v in sorted((a[1], b[1]))] for a, b in part] for part in parts]
        if n == 1 or sum(to - at + 1 for part in reach for at, to in part) <= BAND_COPIES * total:
            break
        n = max(1, n // 2)
    bands: list[dict[int, list]] = [{} for _ in range(n)]
    for k, (part, spans) in enumerate(zip(parts, reach, strict=True)):
        for (a, b), (at, to) in zip(part, spans, strict=True):
            for band in range(at, to + 1):
                bands[band].setdefault(k, []).append({"p": {"x": a[0], "y": a[1]}, "q": {"x": b[0], "y": b[1]}})
    held = F.from_json(F.lit(json.dumps([list(band.values()) for band in bands])), BANDS)  # folded into one literal
    own = F.least(F.greatest(F.floor((y - F.lit(low)) / F.lit(height)), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.exists(F.get(held, own), lambda every: _within_edges(every, x, y, boundary))
