"""FlowFrame: a DataFrame whose rows are flows, with its CRS.

Physical schema: flow_id BIGINT, ox, oy, dx, dy DOUBLE, then any attributes. The
wrapper is immutable and lazy: every method returns a new frame over a new plan.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import crs as crs_functions
from .functions import flow as flow_functions
from .functions.flow import COORDINATES
from .functions.geometry import as_polygon, contains
from .plans.lineage import cut

ID = "flow_id"
#: Partitions up to which the table of their offsets is broadcast.
BROADCAST_PARTITIONS = 10_000
QUARTILES = (25, 50, 75)
#: Values that one task may order, and the slices that a larger range is counted in.
QUANTILE_ROWS = 1_000_000
SLICES = 4096


class FlowFrame:
    def __init__(self, df: DataFrame, crs=None, flow_cols: tuple[str, str, str, str] = COORDINATES, id_col: str = ID) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError(f"a FlowFrame needs a DataFrame, not {type(df).__name__}")
        if len(flow_cols) != 4:
            raise ValueError(f"four coordinate columns are needed, not {len(flow_cols)}")
        missing = [c for c in flow_cols if c not in df.columns]
        if missing:
            if crs is not None and len(missing) == 4:
                raise ValueError("a CRS needs flow columns")
            raise AttributeError(f"no flow columns {missing}; there are {df.columns}")
        tagged = {df.schema[c].metadata.get("crs") for c in flow_cols} - {None}
        given = crs_functions.normalise(crs)
        if len(tagged) > 1 or tagged and given and tagged != {given}:
            raise ValueError(f"the data's CRS {sorted(tagged)} is not {given}")
        self._crs = given or next(iter(tagged), None)
        self.id_col = ID
        if id_col != ID and id_col in df.columns:
            df = df.withColumnRenamed(id_col, ID)
        elif ID not in df.columns:
            df = with_positions(df, ID)
        meta = {"crs": self._crs} if self._crs else {}
        named = {c: F.col(f"`{c}`").cast("double").alias(k, metadata=meta) for c, k in zip(flow_cols, COORDINATES, strict=True)}
        rest = [F.col(f"`{c}`") for c in df.columns if c not in named and c != ID and c not in COORDINATES]
        self.df = df.select(F.col(ID).cast("long").alias(ID), *named.values(), *rest)

    # -- containers

    def _with(self, df: DataFrame, crs="same") -> FlowFrame:
        out = object.__new__(FlowFrame)
        out.id_col, out._crs, out.df = ID, self._crs if crs == "same" else crs, df
        return out

    @property
    def crs(self) -> str | None:
        return self._crs

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def __getitem__(self, keys):
        """One column, or a projection, which stays a FlowFrame while it keeps all flow columns."""
        if isinstance(keys, str):
            return self.df[keys]
        chosen = self.df.select(*keys)
        return self._with(chosen) if {ID, *COORDINATES} <= set(chosen.columns) else chosen

    def with_column(self, name: str, value: Column) -> FlowFrame:
        if name in COORDINATES:
            raise ValueError("set flows with set_geometry")
        return self._with(self.df.withColumn(name, value))

    def set_geometry(self, flow_cols, crs=None) -> FlowFrame:
        """Make four other columns, four expressions, or one flow for all rows the active one."""
        if not isinstance(flow_cols, (list, tuple)):
            raise TypeError("four columns, four expressions, or ((ox, oy), (dx, dy)) are needed")
        if len(flow_cols) == 2:
            flow_cols = [F.lit(float(v)) for point in flow_cols for v in point]
        if len(flow_cols) != 4:
            raise TypeError(f"four columns are needed, not {len(flow_cols)}")
        absent = [c for c in flow_cols if isinstance(c, str) and c not in self.df.columns]
        if absent:
            raise TypeError(f"no such columns: {absent}")
        exprs = [F.col(c) if isinstance(c, str) else c for c in flow_cols]
        df = self.df.select(ID, *(e.cast("double").alias(k) for e, k in zip(exprs, COORDINATES, strict=True)), *(F.col(f"`{c}`") for c in self.df.columns if c not in (ID, *COORDINATES)))
        return self._with(df, crs_functions.normalise(crs) if crs is not None else self._crs)._tagged()

    def set_flow(self, flow_id: int, flow: tuple[tuple[float, float], tuple[float, float]]) -> FlowFrame:
        """Replace one row's flow."""
        values = [float(v) for point in flow for v in point]
        if len(values) != 4:
            raise TypeError("a flow is two points")
        return self._with(self.df.withColumns({c: F.when(F.col(ID) == flow_id, v).otherwise(F.col(c)) for c, v in zip(COORDINATES, values, strict=True)}))._tagged()

    def _tagged(self) -> FlowFrame:
        meta = {"crs": self._crs} if self._crs else {}
        return self._with(self.df.withColumns({c: F.col(c).alias(c, metadata=meta) for c in COORDINATES}))

    def copy(self) -> FlowFrame:
        return self._with(self.df)

    def astype(self, dtype) -> FlowFrame:
        if dtype not in ("object", object):
            raise TypeError("flows can only be taken as objects")
        return self.copy()

    def head(self, n: int = 5) -> FlowFrame:
        return self._with(self.df.orderBy(ID).limit(n))

    def loc(self, ids) -> FlowFrame:
        if isinstance(ids, DataFrame):
            return self._with(self.df.join(ids.select(F.col(ids.columns[0]).alias(ID)), ID, "left_semi"))
        return self._with(self.df.filter(F.col(ID).isin(list(ids))))

    def filter(self, condition) -> FlowFrame:
        return self._with(self.df.filter(condition))

    def drop(self, *names: str) -> FlowFrame:
        if set(names) & {ID, *COORDINATES}:
            raise ValueError("a FlowFrame keeps its flow columns")
        return self._with(self.df.drop(*names))

    def reset_index(self) -> FlowFrame:
        return self._with(with_positions(self.df.orderBy(ID).drop(ID), ID).select(ID, *[c for c in self.df.columns if c != ID]))

    def merge(self, other: DataFrame, on, how: str = "left") -> FlowFrame:
        return self._with(self.df.join(other, on, how))

    def top(self, n: int, column: str) -> FlowFrame:
        return self._with(self.df.orderBy(F.col(column).desc(), ID).limit(n))

    def describe(self, *columns: str) -> DataFrame:
        return describe(self.df, *columns)

    # -- CRS

    def set_crs(self, crs, allow_override: bool = False) -> FlowFrame:
        """Relabel; no coordinate changes."""
        new = crs_functions.normalise(crs)
        if self._crs is not None and new != self._crs and not allow_override:
            raise ValueError(f"the frame has CRS {self._crs}; allow_override=True replaces it")
        return self._with(self.df, new)._tagged()

    @crs.setter
    def crs(self, value) -> None:
        new = crs_functions.normalise(value)
        if self._crs is not None:
            warnings.warn("assigning over a CRS is deprecated; use set_crs", DeprecationWarning, stacklevel=2)
        self._crs = new
        self.df = self._tagged().df

    def to_crs(self, crs) -> FlowFrame:
        """Reproject both endpoints."""
        if self._crs is None:
            raise ValueError("the frame has no CRS to come from")
        new = crs_functions.normalise(crs)
        ox, oy = crs_functions.transform(F.col("ox"), F.col("oy"), self._crs, new)
        dx, dy = crs_functions.transform(F.col("dx"), F.col("dy"), self._crs, new)
        moved = self.df.select(ID, *(e.alias(k) for e, k in zip((ox, oy, dx, dy), COORDINATES, strict=True)), *(F.col(f"`{c}`") for c in self.df.columns if c not in (ID, *COORDINATES)))
        return self._with(moved, new)._tagged()

    def check_geographic(self, what: str) -> None:
        if crs_functions.is_geographic(self._crs):
            warnings.warn(f"{what} of geographic coordinates is in degrees; reproject first", UserWarning, stacklevel=3)

    # -- expressions

    @property
    def o(self) -> DataFrame:
        return self.df.select(ID, F.struct(F.col("ox").alias("x"), F.col("oy").alias("y")).alias("o"))

    @property
    def d(self) -> DataFrame:
        return self.df.select(ID, F.struct(F.col("dx").alias("x"), F.col("dy").alias("y")).alias("d"))

    def length(self) -> DataFrame:
        return self.df.select(ID, flow_functions.length().alias("length"))

    def angle(self) -> DataFrame:
        self.check_geographic("the angle")
        return self.df.select(ID, flow_functions.angle().alias("angle"))

    def wkt(self) -> DataFrame:
        return self.df.select(ID, flow_functions.wkt().alias("wkt"))

    def within_column(self, mask) -> Column:
        polygon = as_polygon(mask)
        return contains(polygon, F.col("ox"), F.col("oy")) & contains(polygon, F.col("dx"), F.col("dy"))

    def within(self, mask) -> DataFrame:
        """(flow_id, within): both endpoints inside the mask, its boundary being outside."""
        return self.df.select(ID, F.coalesce(self.within_column(mask), F.lit(False)).alias("within"))

    def within_each(self, boxes: DataFrame) -> DataFrame:
        """Row-wise: each flow against the box (flow_id, minx, miny, maxx, maxy) of its id."""
        both = self.df.join(boxes.select(ID, "minx", "miny", "maxx", "maxy"), ID, "left")
        test = [(F.col(x) > F.col(a)) & (F.col(x) < F.col(b)) for p in "od" for x, a, b in ((f"{p}x", "minx", "maxx"), (f"{p}y", "miny", "maxy"))]
        return both.select(ID, F.coalesce(test[0] & test[1] & test[2] & test[3], F.lit(False)).alias("within"))

    def clip(self, mask) -> FlowFrame:
        """The flows within a mask; none is cut."""
        return self._with(self.df.filter(self.within_column(mask)))

    def distance(self, other, distance: str = "max", w1: float = 1.0, w2: float = 1.0, length: bool = False) -> DataFrame:
        """(flow_id, distance) to one flow ((x, y), (x, y)) or to the flow of the same id in another frame."""
        if distance not in flow_functions.MODES:
            raise ValueError(f"distance must be one of {flow_functions.MODES}")
        own = self.df.select(ID, *(F.col(c).alias("a_" + c) for c in COORDINATES))
        if isinstance(other, FlowFrame):
            both = own.join(other.df.select(ID, *(F.col(c).alias("b_" + c) for c in COORDINATES)), ID)
        else:
            values = [float(v) for point in other for v in point]
            both = own.select("*", *(F.lit(v).alias("b_" + c) for c, v in zip(COORDINATES, values, strict=True)))
        return both.select(ID, flow_functions.flow_distance("a_", "b_", distance, w1, w2, length, linear=True).alias("distance"))

    # -- extent

    def bounds(self) -> DataFrame:
        least, most = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
        return self.df.select(ID, least("ox", "dx").alias("minx"), least("oy", "dy").alias("miny"), most("ox", "dx").alias("maxx"), most("oy", "dy").alias("maxy"))

    def total_bounds(self) -> DataFrame:
        """One row: minx, miny, maxx, maxy over both endpoints."""
        return self.df.agg(F.min(F.least("ox", "dx")).alias("minx"), F.min(F.least("oy", "dy")).alias("miny"), F.max(F.greatest("ox", "dx")).alias("maxx"), F.max(F.greatest("oy", "dy")).alias("maxy"))

    def volume_density(self) -> DataFrame:
        """One row: volume, density, n. The density of a flat extent is inf."""
        self.check_geographic("the volume")
        wide = F.max(F.greatest("ox", "dx")) - F.min(F.least("ox", "dx"))
        high = F.max(F.greatest("oy", "dy")) - F.min(F.least("oy", "dy"))
        one = self.df.agg((wide * high).alias("volume"), F.count("*").alias("n"))
        return one.select("volume", flow_functions.guarded_division(F.col("n").cast("double"), F.col("volume")).alias("density"), "n")

    @property
    def volume(self) -> float:
        return self.volume_density().first()["volume"]

    @property
    def density(self) -> float:
        return self.volume_density().first()["density"]

    # -- display

    def plot_data(self, column: str | None = None, zoom: float = 0.03) -> DataFrame:
        """(flow_id, x, y, u, v, color, limits): arrows, a value or a category's index, and padded limits.

        Categories are numbered in sorted order. The distinct values are ranked, not the rows.
        """
        if column is not None and column not in self.df.columns:
            raise ValueError(f"no column {column!r}")
        arrows = self.df.select(ID, F.col("ox").alias("x"), F.col("oy").alias("y"), (F.col("dx") - F.col("ox")).alias("u"), (F.col("dy") - F.col("oy")).alias("v"), *([F.col(column).alias("__value")] if column else []))
        if column is None:
            arrows = arrows.withColumn("color", F.lit(None).cast("double"))
        elif self.df.schema[column].dataType.typeName() in ("string", "boolean"):
            values = with_positions(arrows.select("__value").filter("__value is not null").distinct().orderBy("__value"), "color")
            arrows = arrows.join(values, "__value", "left").withColumn("color", F.col("color").cast("double"))
        else:
            arrows = arrows.withColumn("color", F.col("__value").cast("double"))
        pad = lambda lo, hi, sign: (F.col(hi if sign > 0 else lo) + sign * zoom * (F.col(hi) - F.col(lo)))
        limits = self.total_bounds().select(pad("minx", "maxx", -1).alias("xmin"), pad("minx", "maxx", 1).alias("xmax"), pad("miny", "maxy", -1).alias("ymin"), pad("miny", "maxy", 1).alias("ymax"))
        row = limits.first()
        return arrows.select(ID, "x", "y", "u", "v", "color", *(F.lit(row[c]).alias(c) for c in limits.columns))


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """Number rows 0, 1, ... in their order, without bringing them together: a count per partition, then offsets.

    The marked rows are written once, so that counts and numbers are of the same run. The table
    of offsets has one short row per partition; it is broadcast up to BROADCAST_PARTITIONS of them.
    """
    part, at = "__part", "__at"
    marked = cut(df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = marked.groupBy(part).count().orderBy(part).collect()
    base, starts = 0, []
    for row in sizes:
        starts.append((row[part], base))
        base += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, __base long")
    numbered = marked.join(F.broadcast(offsets) if len(starts) <= BROADCAST_PARTITIONS else offsets, part)
    return numbered.withColumn(name, F.col("__base") + F.col(at)).drop(part, at, "__base")


def concat(*frames: FlowFrame) -> FlowFrame:
    """All rows of all frames, numbered anew. Frames of different CRS can't be joined."""
    if not all(isinstance(f, FlowFrame) for f in frames):
        raise TypeError("only FlowFrames can be put together")
    if len({f.crs for f in frames}) > 1:
        raise ValueError(f"frames of different CRS: {sorted(str(f.crs) for f in frames)}")
    df = frames[0].df.withColumn("__source", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        df = df.unionByName(f.df.withColumn("__source", F.lit(i)), allowMissingColumns=True)
    ordered = df.orderBy("__source", ID).drop("__source", ID)
    return frames[0]._with(with_positions(ordered, ID).select(ID, *ordered.columns))._tagged()


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max), one row per numeric column, with exact quartiles."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    chosen = columns or [c for c in numeric if c != ID]
    if not chosen:
        raise ValueError("no numeric column")
    aggregates = []
    for c in chosen:
        v = F.col(f"`{c}`").cast("double")
        quartiles = exact_quantiles(df.select(v.alias("v")), [q / 100 for q in QUARTILES])
        aggregates.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            *(F.lit(x).cast("double").alias(f"q{q}") for q, x in zip(QUARTILES, quartiles, strict=True)), F.max(v).alias("max"),
        ))
    return df.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows"))


def exact_quantiles(df: DataFrame, shares: list[float], rows: int | None = None) -> list[float | None]:
    """Quantiles of the column v, nulls left out, interpolated between neighbours; None if there are no values.

    A rank's range is narrowed by counts of SLICES equal slices until it holds at most rows values;
    those alone are brought together. Ranges of one value need no more narrowing.
    """
    rows = QUANTILE_ROWS if rows is None else rows
    v = F.col("v")
    df = df.filter(v.isNotNull())
    n, least, most = df.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(shares)
    if n <= rows:
        return list(df.agg(*(F.percentile(v, share) for share in shares)).first())

    def at(rank: int) -> float:
        """The value of a 0-based rank."""
        low, high, before, count = least, most, 0, n
        while low < high and count > rows:
            width = (high - low) / SLICES
            if not 0 < width < float("inf") or low + width == low:
                break
            inside = df.filter((v >= low) & (v <= high))
            piece = F.least(F.floor((v - low) / width), F.lit(SLICES - 1))
            for s in inside.groupBy(piece.alias("s")).agg(F.count(v).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("s").collect():
                if rank < before + s["c"]:
                    low, high, count = s["lo"], s["hi"], s["c"]
                    break
                before += s["c"]
        if low == high:
            return low
        tally = df.filter((v >= low) & (v <= high)).groupBy("v").count()
        upto = tally.withColumn("upto", F.sum("count").over(Window.orderBy("v")))
        return upto.filter(F.col("upto") > rank - before).agg(F.min("v")).first()[0]

    out = []
    for share in shares:
        place = (n - 1) * share
        low = at(int(place))
        high = at(int(place) + 1) if place > int(place) else low
        out.append(low + (high - low) * (place - int(place)))
    return out
