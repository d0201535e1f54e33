"""Flows from columns, arrays, geometries and CSV files."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ID, FlowFrame
from ..functions.flow import COORDINATES

FLOW_SCHEMA = f"{ID} long, ox double, oy double, dx double, dy double"


def flows_from_od(spark: SparkSession, o: Sequence, d: Sequence, crs=None) -> FlowFrame:
    """From two equally long lists of (x, y)."""
    points = [[tuple(map(float, p)) if isinstance(p, Sequence) else None for p in side] for side in (o, d)]
    if any(p is None or len(p) != 2 for side in points for p in side):
        raise ValueError("origins and destinations are lists of (x, y)")
    if len(points[0]) != len(points[1]):
        raise ValueError(f"{len(points[0])} origins and {len(points[1])} destinations")
    return FlowFrame(spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(zip(*points, strict=True))], FLOW_SCHEMA), crs)


def flows_from_points(o: DataFrame, d: DataFrame, on: str, crs=None) -> FlowFrame:
    """From two tables (on, x, y) that share a key."""
    both = o.select(F.col(on).alias(ID), F.col("x").alias("ox"), F.col("y").alias("oy")).join(d.select(F.col(on).alias(ID), F.col("x").alias("dx"), F.col("y").alias("dy")), ID)
    return FlowFrame(both, crs)


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def wkt_ends(wkt: Column) -> dict[str, Column]:
    """First and last vertex of FLOW, LINESTRING and MULTIPOINT texts; other kinds raise, a null or empty one is null."""
    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    empty = wkt.isNull() | F.upper(wkt).contains("EMPTY")
    checked = F.when(empty, None).when(kind.isin("FLOW", "LINESTRING", "MULTIPOINT"), wkt).otherwise(F.raise_error(F.concat(F.lit("not a flow, line or multipoint: "), F.substring(wkt, 1, 40))).cast("string"))
    vertices = F.regexp_extract_all(checked, F.lit(rf"({_NUMBER}\s+{_NUMBER})"), F.lit(1))
    first, last = F.split(F.get(vertices, F.lit(0)), r"\s+"), F.split(F.element_at(vertices, -1), r"\s+")
    return {"ox": first[0].cast("double"), "oy": first[1].cast("double"), "dx": last[0].cast("double"), "dy": last[1].cast("double"), "n_vertices": F.size(vertices)}


def flows_from_wkt(df: DataFrame, column: str, crs=None) -> FlowFrame:
    """From a text column; rows keep their order and attributes, crs is honoured. Lines of more vertices keep their ends."""
    ends = wkt_ends(F.col(column))
    made = df.select("*", *(e.alias(f"__{k}") for k, e in ends.items()))
    return FlowFrame(made.select(*(F.col(f"__{c}").alias(c) for c in COORDINATES), *[c for c in df.columns if c not in (*COORDINATES, column)]), crs)


def flows_from_geometry(spark: SparkSession, geometry: Sequence, crs=None) -> FlowFrame:
    """From a list of WKT texts, GeoJSON-like dicts or ((x, y), (x, y), ...) sequences, in their order."""
    if not isinstance(geometry, (list, tuple)):
        raise TypeError(f"a list of geometries is needed, not {type(geometry).__name__}")
    rows = []
    for i, g in enumerate(geometry):
        if isinstance(g, str):
            kind = g.strip().split("(")[0].split()[0].upper() if g.strip() else ""
            import re

            points = [tuple(map(float, p.split())) for p in re.findall(rf"{_NUMBER}\s+{_NUMBER}", g)]
        elif isinstance(g, dict):
            kind, points = str(g.get("type", "")).upper(), [tuple(p) for p in g.get("coordinates", ()) if isinstance(p, (list, tuple))]
        else:
            kind, points = "FLOW", [tuple(p) for p in g]
        if kind not in ("FLOW", "LINESTRING", "MULTIPOINT"):
            raise TypeError(f"not a flow, line or multipoint: {kind}")
        if not points:
            rows.append((i, None, None, None, None))
            continue
        if len(points) < 2:
            raise ValueError("a flow has two points")
        if len(points) > 2:
            warnings.warn("only the first and the last vertex are kept", UserWarning, stacklevel=2)
        rows.append((i, *map(float, points[0][:2]), *map(float, points[-1][:2])))
    return FlowFrame(spark.createDataFrame(rows, FLOW_SCHEMA), crs)


def read_csv(spark: SparkSession, path: str, use_cols: Sequence[str | int], crs=None, schema=None, **options) -> FlowFrame:
    """A CSV file with a header; the coordinates are four columns by name or by position. All columns are kept."""
    if len(use_cols) != 4:
        raise ValueError(f"four columns are needed, not {len(use_cols)}")
    options = {"header": True, **({} if schema else {"inferSchema": True}), **options}
    df = (spark.read.schema(schema) if schema else spark.read).csv(path, **options)
    names = [df.columns[c] if isinstance(c, int) else c for c in use_cols]
    copied = df.select("*", *(F.col(f"`{n}`").cast("double").alias(f"__{k}") for n, k in zip(names, COORDINATES, strict=True)))
    kept = [c for c in df.columns if c not in COORDINATES]
    return FlowFrame(copied.select(*(F.col(f"__{k}").alias(k) for k in COORDINATES), *[F.col(f"`{c}`") for c in kept]), crs)


def read_parquet(spark: SparkSession, path: str, crs=None, flow_cols=COORDINATES) -> FlowFrame:
    return FlowFrame(spark.read.parquet(path), crs, flow_cols)


def write_parquet(frame: FlowFrame, path: str, mode: str = "errorifexists") -> None:
    """Coordinates stay plain doubles, so that file statistics can skip rows of a box filter; the CRS is column metadata."""
    frame.df.write.mode(mode).parquet(path)


def write_csv(frame: FlowFrame, path: str, mode: str = "errorifexists") -> None:
    frame.df.write.mode(mode).csv(path, header=True)
