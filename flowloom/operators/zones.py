"""Grids, zones and the irreplaceability index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import ID, FlowFrame
from ..functions import crs as crs_functions
from ..functions.flow import length
from ..functions.geometry import RINGS, as_polygon, in_rings
from ..plans.lineage import cut

BOX = ("minx", "miny", "maxx", "maxy")
#: Values of one group that are sorted in one task for its median; larger groups are narrowed down first.
MEDIAN_ROWS = 1_000_000


def to_grid(frame: FlowFrame, delta_x: float | None = None, delta_y: float | None = None, x_size: int | None = None, y_size: int | None = None) -> FlowFrame:
    """Add o/d_grid_x, o/d_grid_y and o/d_grid_id = grid_y * x_size + grid_x, by cell size or by number of cells.

    Cells count from the extent's lower corner. With cell sizes x_size is cut down to whole
    cells, so points on the far edge have grid_x = x_size and share an id with the next row's
    first cell. Missing coordinates give -1.
    """
    b = frame.total_bounds().first()
    wide, high = (0.0, 0.0) if b["minx"] is None else (b["maxx"] - b["minx"], b["maxy"] - b["miny"])
    if delta_x is not None and delta_y is not None:
        x_size = int(wide / delta_x)
    elif x_size is not None and y_size is not None:
        delta_x, delta_y = wide / x_size, high / y_size
    else:
        raise ValueError("give delta_x and delta_y, or x_size and y_size")
    made: dict[str, Column] = {}
    for p in "od":
        for axis, low, delta in (("x", b["minx"], delta_x), ("y", b["miny"], delta_y)):
            cell = F.try_divide(F.col(p + axis) - F.lit(low), F.lit(float(delta)))
            whole = F.when(F.isnan(cell), None).otherwise(cell).cast("bigint")
            made[f"{p}_grid_{axis}"] = F.coalesce(whole, F.lit(-1).cast("bigint"))
    df = frame.df.withColumns(made)
    return frame._with(df.withColumns({f"{p}_grid_id": F.col(f"{p}_grid_y") * x_size + F.col(f"{p}_grid_x") for p in "od"}))


def od_counts(grid: FlowFrame, weight: str | None = None) -> DataFrame:
    """(o_grid_id, d_grid_id, flow_count[, total]) of a frame with a grid."""
    total = [F.sum(weight).alias("total")] if weight else []
    return grid.df.groupBy("o_grid_id", "d_grid_id").agg(F.count("*").alias("flow_count"), *total)


def grid_zones(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, size: float) -> DataFrame:
    """Square zones (zone_id, minx, miny, maxx, maxy) that cover an extent, row by row."""
    nx, ny = math.ceil((maxx - minx) / size), math.ceil((maxy - miny) / size)
    at = spark.range(nx * ny).withColumnRenamed("id", "zone_id")
    x, y = (F.col("zone_id") % nx).cast("double"), F.floor(F.col("zone_id") / nx).cast("double")
    return at.select("zone_id", (minx + x * size).alias("minx"), (miny + y * size).alias("miny"), (minx + (x + 1) * size).alias("maxx"), (miny + (y + 1) * size).alias("maxy"))


def polygon_zones(spark: SparkSession, polygons: dict) -> DataFrame:
    """Zones (zone_id, minx, ..., rings) from {zone_id: polygon}."""
    rows = []
    for zone, value in polygons.items():
        p = as_polygon(value)
        rows.append((zone, *p.bounds, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in p.parts]))
    return spark.createDataFrame(rows, f"zone_id long, minx double, miny double, maxx double, maxy double, rings {RINGS}")


def _inside(x: Column, y: Column, boundary: bool, rings: bool) -> Column:
    a, b, c, d = (F.col(k) for k in BOX)
    near = (x >= a) & (x <= c) & (y >= b) & (y <= d) if boundary or rings else (x > a) & (x < c) & (y > b) & (y < d)
    return near & in_rings(F.col("rings"), x, y, boundary) if rings else near


def spatial_join(points: DataFrame, x: str, y: str, zones: DataFrame, boundary: bool = False) -> DataFrame:
    """Inner join of points and zones, each point with every zone that holds it.

    Zones are entered into all cells that they reach, points into theirs, and both meet by
    cell; the exact test follows. Cells are as large as the average zone, and doubled for a
    larger zone until it reaches into three by three of them at most; points look at each
    size that there is.
    """
    size = zones.agg(F.avg(F.col("maxx") - F.col("minx")), F.avg(F.col("maxy") - F.col("miny"))).first()
    if size[0] is None:
        return points.join(zones, F.lit(False))
    wide, high = (v if v > 0 else 1.0 for v in size)
    cell = lambda c, w: F.floor(F.col(c) / (F.lit(w) * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    times = F.greatest((F.col("maxx") - F.col("minx")) / F.lit(wide), (F.col("maxy") - F.col("miny")) / F.lit(high), F.lit(1.0))
    zones_at = zones.withColumn("__level", F.ceil(F.log2(times)).cast("int"))
    levels = sorted(r[0] for r in zones_at.select("__level").distinct().collect())  # at most as many as a double has exponents
    across = F.explode(F.sequence(cell("minx", wide), cell("maxx", wide)))
    entered = zones_at.withColumn("__cx", across).withColumn("__cy", F.explode(F.sequence(cell("miny", high), cell("maxy", high))))
    leveled = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels))) if len(levels) > 1 else F.lit(levels[0]))
    placed = leveled.withColumns({"__cx": cell(x, wide), "__cy": cell(y, high)})
    met = placed.join(entered, ["__level", "__cx", "__cy"])
    return met.filter(_inside(F.col(x), F.col(y), boundary, "rings" in zones.columns)).drop("__level", "__cx", "__cy")


def zones_touched(zones: DataFrame, frame: FlowFrame) -> DataFrame:
    """The zones that any endpoint intersects (semi join, the boundary included)."""
    ends = frame.df.select(F.inline(F.array(F.struct(F.col("ox").alias("__x"), F.col("oy").alias("__y")), F.struct(F.col("dx").alias("__x"), F.col("dy").alias("__y"))))).distinct()
    hit = spatial_join(ends, "__x", "__y", zones, boundary=True).select("zone_id").distinct()
    return zones.join(hit, "zone_id", "left_semi")


def group_median(df: DataFrame, group: str, value: str, rows: int = MEDIAN_ROWS) -> DataFrame:
    """(group, median), exact. Groups over rows are narrowed to the slices of their range that hold the middle ranks."""
    sizes = df.groupBy(group).agg(F.count(value).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    if largest <= rows:
        return df.groupBy(group).agg(F.median(value).alias("median"))
    slices = 4096
    width = (F.col("__hi") - F.col("__lo")) / slices
    sliced = df.join(sizes, group).withColumn("__s", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / F.when(width > 0, width)), F.lit(slices - 1))).otherwise(0))
    counts = sliced.groupBy(group, "__n", "__s").agg(F.count("*").alias("__c"))
    run = counts.withColumn("__to", F.sum("__c").over(Window.partitionBy(group).orderBy("__s")))
    middle = [F.floor((F.col("__n") + k) / 2) for k in (1, 2)]  # 1-based ranks
    need = run.filter(((F.col("__to") - F.col("__c") < middle[0]) & (middle[0] <= F.col("__to"))) | ((F.col("__to") - F.col("__c") < middle[1]) & (middle[1] <= F.col("__to"))))
    kept = sliced.join(need.select(group, "__s", (F.col("__to") - F.col("__c")).alias("__before")), [group, "__s"])
    tally = kept.groupBy(group, "__n", "__s", "__before", F.col(value).alias("__v")).agg(F.count("*").alias("__m"))
    to = F.col("__before") + F.sum("__m").over(Window.partitionBy(group, "__s").orderBy("__v"))
    ranked = tally.withColumn("__end", to).withColumn("__from", F.col("__end") - F.col("__m"))
    held = lambda r: F.max(F.when((F.col("__from") < r) & (r <= F.col("__end")), F.col("__v")))
    return ranked.groupBy(group).agg(((held(middle[0]) + held(middle[1])) / 2).alias("median"))


def i_index(frame: FlowFrame, zones: DataFrame, alpha: float | None = None, od_type: str = "d", zones_crs=None) -> DataFrame:
    """Irreplaceability of zones: zone_id, I_index, flow_count, total_length, alpha, then the zones' other columns.

    Of the flows whose destination (od_type d) or origin (o) lies within a zone: the largest
    h such that h of them are at least h * alpha long. alpha: by default the median of the
    zones' median lengths over the median of their counts, over zones that have flows.
    Lengths are summed in thousands. Zones that no flow hits have zeros.

    Ranks come from counts per (zone, floor(length / alpha)), so a zone with many flows is
    summed up before it moves; capped values at the zone's count leave the index as it is.
    """
    if "zone_id" not in zones.columns:
        raise ValueError("zones need a zone_id")
    side = od_type.lower()
    if side not in ("o", "d"):
        raise ValueError("od_type must be 'o' or 'd'")
    if zones_crs is not None and frame.crs is not None and crs_functions.normalise(zones_crs) != frame.crs:
        zones = reproject_zones(zones, zones_crs, frame.crs)
    points = frame.df.select(F.col(side + "x").alias("__x"), F.col(side + "y").alias("__y"), length().alias("__len"))
    near = zones.select("zone_id", *BOX, *[c for c in ("rings",) if c in zones.columns])
    met = cut(spatial_join(points, "__x", "__y", near).select("zone_id", "__len"))  # read by medians, sums and ranks
    sums = met.groupBy("zone_id").agg(F.count("*").alias("flow_count"), (F.sum("__len") / 1000).alias("total_length"))
    if alpha is None:
        both = group_median(met, "zone_id", "__len").join(sums, "zone_id").agg(F.median("median").alias("l"), F.median("flow_count").alias("c")).first()
        alpha = both["l"] / both["c"] if both["c"] else math.nan
    alpha = float(alpha)
    if math.isnan(alpha) or alpha <= 0:
        value = F.lit(None).cast("double") if math.isnan(alpha) else F.when(F.col("__len") > 0, F.lit(math.inf))
    else:
        value = F.col("__len") / alpha
    limited = met.join(sums.select("zone_id", F.col("flow_count").alias("__n")), "zone_id").select("zone_id", F.floor(F.least(value, F.col("__n").cast("double"))).alias("v"))
    tally = limited.filter("v >= 1").groupBy("zone_id", "v").agg(F.count("*").alias("c"))
    above = F.sum("c").over(Window.partitionBy("zone_id").orderBy(F.col("v").desc()))
    index = tally.withColumn("__above", above).groupBy("zone_id").agg(F.max(F.least("v", "__above")).alias("I_index"))
    out = zones.join(sums, "zone_id", "left").join(index, "zone_id", "left")
    filled = [F.coalesce("I_index", F.lit(0)).cast("long").alias("I_index"), F.coalesce("flow_count", F.lit(0)).alias("flow_count"), F.coalesce("total_length", F.lit(0.0)).alias("total_length"), F.lit(alpha).alias("alpha")]
    return out.select("zone_id", *filled, *[c for c in zones.columns if c != "zone_id"])


def reproject_zones(zones: DataFrame, source, target) -> DataFrame:
    """Zones in another CRS: vertices are moved, boxes become those of the moved corners."""
    rings = F.col("rings") if "rings" in zones.columns else F.array(F.array(F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])))

    def move(p: Column) -> Column:
        x, y = crs_functions.transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    moved = zones.withColumn("rings", F.transform(rings, lambda part: F.transform(part, lambda ring: F.transform(ring, move))))
    every = F.flatten(F.flatten(F.col("rings")))
    ends = {"minx": F.array_min(F.transform(every, lambda p: p["x"])), "miny": F.array_min(F.transform(every, lambda p: p["y"])), "maxx": F.array_max(F.transform(every, lambda p: p["x"])), "maxy": F.array_max(F.transform(every, lambda p: p["y"]))}
    return moved.withColumns(ends)


__all__ = ["ID", "grid_zones", "group_median", "i_index", "od_counts", "polygon_zones", "reproject_zones", "spatial_join", "to_grid", "zones_touched"]
