"""The flow expressions as SQL functions of a session: plain SQL that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FLOW = "ox DOUBLE, oy DOUBLE, dx DOUBLE, dy DOUBLE"
_TWO = "aox DOUBLE, aoy DOUBLE, adx DOUBLE, ady DOUBLE, box DOUBLE, boy DOUBLE, bdx DOUBLE, bdy DOUBLE"
_DO = "sqrt((aox - box) * (aox - box) + (aoy - boy) * (aoy - boy))"
_DD = "sqrt((adx - bdx) * (adx - bdx) + (ady - bdy) * (ady - bdy))"

FUNCTIONS = {
    "flow_length": (_FLOW, "DOUBLE", "sqrt((dx - ox) * (dx - ox) + (dy - oy) * (dy - oy))"),
    "flow_angle": (_FLOW, "DOUBLE", "atan2(dy - oy, dx - ox)"),
    "flow_wkt": (_FLOW, "STRING", "coalesce('FLOW (' || ox || ' ' || oy || ', ' || dx || ' ' || dy || ')', 'FLOW EMPTY')"),
    "flow_within_box": (_FLOW + ", minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE", "BOOLEAN", "ox > minx AND ox < maxx AND dx > minx AND dx < maxx AND oy > miny AND oy < maxy AND dy > miny AND dy < maxy"),
    "flow_distance_max": (_TWO, "DOUBLE", f"greatest({_DO}, {_DD})"),
    "flow_distance_min": (_TWO, "DOUBLE", f"least({_DO}, {_DD})"),
    "flow_distance_sum": (_TWO, "DOUBLE", f"{_DO} + {_DD}"),
    "flow_distance_mean": (_TWO, "DOUBLE", f"({_DO} + {_DD}) / 2"),
    "haversine_km": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "DOUBLE",
        "2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
