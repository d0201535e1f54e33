"""Flows on streams: stateless expressions and windowed summaries with late data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flow import angle, length
from ..functions.geometry import as_polygon, contains


def with_measures(stream: DataFrame) -> DataFrame:
    """Add length and angle."""
    return stream.withColumns({"length": length(), "angle": angle()})


def clip(stream: DataFrame, mask) -> DataFrame:
    polygon = as_polygon(mask)
    return stream.filter(contains(polygon, F.col("ox"), F.col("oy")) & contains(polygon, F.col("dx"), F.col("dy")))


def windowed_grid_counts(stream: DataFrame, time: str, delta: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, o_x, o_y, d_x, d_y, flow_count, total_length) of event-time windows and cells of side delta.

    Rows later than the watermark are left out, as in any windowed stream.
    """
    cells = [F.floor(F.col(c) / F.lit(float(delta))).cast("long").alias(n) for c, n in (("ox", "o_x"), ("oy", "o_y"), ("dx", "d_x"), ("dy", "d_y"))]
    placed = stream.withWatermark(time, late).select(time, *cells, length().alias("__len"))
    counts = placed.groupBy(F.window(time, window).alias("w"), "o_x", "o_y", "d_x", "d_y").agg(F.count("*").alias("flow_count"), F.sum("__len").alias("total_length"))
    return counts.select("w.start", "w.end", "o_x", "o_y", "d_x", "d_y", "flow_count", "total_length")


def windowed_directions(stream: DataFrame, time: str, n_directions: int = 6, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, sector, flow_count) of event-time windows."""
    if n_directions < 2:
        raise ValueError("n_directions must be at least 2")
    sector = (F.floor(F.pmod(angle(), F.lit(2 * math.pi)) / F.lit(2 * math.pi / n_directions)) % n_directions).alias("sector")
    counts = stream.withWatermark(time, late).select(time, sector).groupBy(F.window(time, window).alias("w"), "sector").agg(F.count("*").alias("flow_count"))
    return counts.select("w.start", "w.end", "sector", "flow_count")
