"""Every query of the flow operators over the test tables, with its SQL for DuckDB.

Floats are rounded to six places, as the engines sum in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import ID, FlowFrame, concat, describe
from .functions import flow as ff
from .operators import cluster, manifold, pairs, stats, zones
from .plans import views
from .plans.views import EMBEDDING_SQL, ITEMS_SQL, ORDERS_SQL, ZONES_SQL, flows_emb, flows_li, flows_ord

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LEN = "sqrt((dx - ox) * (dx - ox) + (dy - oy) * (dy - oy))"
EMB = f"with f as ({EMBEDDING_SQL})"
ORD = f"with f as ({ORDERS_SQL})"
LI = f"with f as ({ITEMS_SQL})"
DO, DD = "sqrt((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy))", "sqrt((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy))"
PAIRS = f"{EMB}, d as (select a.flow_id as i, b.flow_id as j, {DO} as o_dist, {DD} as d_dist, sqrt((a.dx - a.ox) * (a.dx - a.ox) + (a.dy - a.oy) * (a.dy - a.oy)) * sqrt((b.dx - b.ox) * (b.dx - b.ox) + (b.dy - b.oy) * (b.dy - b.oy)) as ll from f a cross join f b)"
MODES = {"max": "greatest(o_dist, d_dist)", "sum": "o_dist + d_dist", "min": "least(o_dist, d_dist)", "mean": "(o_dist + d_dist) / 2"}
PI2 = "(pi() * pi())"
TARGET = ((250.0, 250.0), (750.0, 500.0))
W1, W2 = 0.3, 0.7
BOX = (100.0, 100.0, 900.0, 800.0)
TRIANGLE = ((100.0, 100.0), (900.0, 200.0), (500.0, 800.0), (100.0, 100.0))
EMB_BOX = (-0.1, -0.15, 0.2, 0.15)
DR, LOCAL_R, EPS = 0.05, 0.25, 0.06
MEDOIDS = ((0.0, 0.0, 0.0, 0.0), (0.1, 0.1, -0.1, -0.1), (-0.1, 0.1, 0.1, -0.1), (0.15, -0.15, 0.15, 0.0))


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def rounded_pairs(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """rounded() for a row per pair, without a decimal number for each: half up in doubles, as DuckDB rounds. Other than small values of no sign go the usual way."""
    z = F.col(column) * 10.0**digits
    down = F.floor(z)
    half_up = (down + F.when(z - down >= 0.5, 1).otherwise(0)) / F.lit(10.0**digits)
    return df.withColumn(column, F.when((z >= 0) & (z < 2.0**52), half_up).otherwise(F.round(column, digits)))


# ---------------------------------------------------------------- zones


def _i_index_sql(side: str, alpha: str | None) -> str:
    a = alpha or "(select median(med) / median(c) from (select median(len) as med, count(*) as c from m group by zone_id))"
    return f"""{LI}, z as ({ZONES_SQL}), m as (select zone_id, {LEN} as len from f join z on {side}x > minx and {side}x < maxx and {side}y > miny and {side}y < maxy),
a as (select {a} as alpha), r as (select zone_id, len, row_number() over (partition by zone_id order by len desc) as rk from m),
s as (select zone_id, max(case when rk <= len / alpha then rk else 0 end) as h, count(*) as c, sum(len) / 1000 as t from r, a group by zone_id)
select z.zone_id, cast(coalesce(h, 0) as bigint) as "I_index", coalesce(c, 0) as flow_count, round(coalesce(t, 0), 6) as total_length, round(alpha, 6) as alpha, minx, miny, maxx, maxy from z left join s using (zone_id), a"""


@query("i_index_auto_d", _i_index_sql("d", None))
def _(spark, d):
    return rounded(zones.i_index(flows_li(spark, d), views.zones(spark)), "total_length", "alpha")


@query("i_index_alpha_o", _i_index_sql("o", "cast(25 as double)"))
def _(spark, d):
    return rounded(zones.i_index(flows_li(spark, d), views.zones(spark), 25.0, "o"), "total_length", "alpha")


@query("topk_zones", f"select zone_id, \"I_index\", flow_count from ({_i_index_sql('d', None)}) order by \"I_index\" desc, zone_id limit 10")
def _(spark, d):
    return zones.i_index(flows_li(spark, d), views.zones(spark)).select("zone_id", "I_index", "flow_count").orderBy(F.desc("I_index"), "zone_id").limit(10)


@query("zones_semi_join", f"{ORD}, z as ({ZONES_SQL}) select zone_id, minx, miny, maxx, maxy from z where exists (select 1 from f where ox >= minx and ox <= maxx and oy >= miny and oy <= maxy or dx >= minx and dx <= maxx and dy >= miny and dy <= maxy)")
def _(spark, d):
    return zones.zones_touched(views.zones(spark), flows_ord(spark, d))


_TRI_ZONES = {1: TRIANGLE, 2: ((0.0, 500.0), (500.0, 1000.0), (0.0, 1000.0))}


def _left_of(points, x: str, y: str) -> str:
    """Strictly inside a convex ring that runs counter-clockwise."""
    ring = points if points[0] == points[-1] else (*points, points[0])
    return " and ".join(f"(cast({bx - ax} as double) * ({y} - {ay}) - cast({by - ay} as double) * ({x} - {ax})) > 0" for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))


@query("zones_polygon_join", f"{ORD}, m as (select flow_id, 1 as zone_id from f where {_left_of(_TRI_ZONES[1], 'ox', 'oy')} union all select flow_id, 2 from f where {_left_of(_TRI_ZONES[2], 'ox', 'oy')}) select flow_id, cast(zone_id as bigint) as zone_id from m")
def _(spark, d):
    polygons = zones.polygon_zones(spark, _TRI_ZONES)
    return zones.spatial_join(flows_ord(spark, d).df.select(ID, "ox", "oy"), "ox", "oy", polygons).select(ID, "zone_id")


# ---------------------------------------------------------------- expressions


@query("flow_length", f"{ORD} select flow_id, round({LEN}, 6) as length from f")
def _(spark, d):
    return rounded(flows_ord(spark, d).length(), "length")


@query("flow_angle", f"{ORD} select flow_id, round(atan2(dy - oy, dx - ox), 6) as angle from f")
def _(spark, d):
    return rounded(flows_ord(spark, d).angle(), "angle")


def _to_target(mode: str) -> str:
    (ox, oy), (dx, dy) = TARGET
    o, d_ = f"sqrt((ox - {ox}::double) * (ox - {ox}::double) + (oy - {oy}::double) * (oy - {oy}::double))", f"sqrt((dx - {dx}::double) * (dx - {dx}::double) + (dy - {dy}::double) * (dy - {dy}::double))"
    value = {"weighted": f"{W1}::double * o_dist + {W2}::double * d_dist", **MODES}[mode]
    return f"{ORD}, d as (select flow_id, {o} as o_dist, {d_} as d_dist from f) select flow_id, round({value}, 6) as distance from d"


for _mode in (*MODES, "weighted"):
    @query(f"distance_{_mode}", _to_target(_mode))
    def _(spark, d, mode=_mode):
        return rounded(flows_ord(spark, d).distance(TARGET, mode, W1, W2), "distance")


def _reversed(frame: FlowFrame) -> FlowFrame:
    return frame.set_geometry(["dx", "dy", "ox", "oy"])


@query("distance_weighted_len", f"{EMB}, p as (select flow_id, {LEN} as l, sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) as g from f) select flow_id, round(sqrt(({W1}::double * g * g + {W2}::double * g * g) / (l * l)), 6) as distance from p")
def _(spark, d):
    f = flows_emb(spark, d)
    return rounded(f.distance(_reversed(f), "weighted", W1, W2, length=True), "distance")


HAVERSINE = "2 * 6371.0::double * asin(sqrt(least(pow(sin((radians({3}) - radians({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin((radians({2}) - radians({0})) / 2), 2), 1::double)))"


@query("haversine_length", f"{EMB} select flow_id, round({HAVERSINE.format('ox', 'oy', 'dx', 'dy')}, 6) as km from f")
def _(spark, d):
    return flows_emb(spark, d).df.select(ID, F.round(ff.haversine_km(*ff.columns()), 6).alias("km"))


@query("volume_density", f"{LI}, b as (select (max(greatest(ox, dx)) - min(least(ox, dx))) * (max(greatest(oy, dy)) - min(least(oy, dy))) as v, count(*) as n from f) select round(v, 6) as volume, round(n / v, 6) as density, n from b")
def _(spark, d):
    return rounded(flows_li(spark, d).volume_density(), "volume", "density")


@query("od_wkt", f"{ORD} select flow_id, 'FLOW (' || cast(ox as varchar) || ' ' || cast(oy as varchar) || ', ' || cast(dx as varchar) || ' ' || cast(dy as varchar) || ')' as wkt from f")
def _(spark, d):
    return flows_ord(spark, d).wkt()


def _strict(x: str, y: str, b) -> str:
    return f"{x} > {b[0]} and {x} < {b[2]} and {y} > {b[1]} and {y} < {b[3]}"


@query("within_box", f"{ORD} select flow_id, ({_strict('ox', 'oy', BOX)} and {_strict('dx', 'dy', BOX)}) as within from f")
def _(spark, d):
    return flows_ord(spark, d).within(BOX)


@query("clip_polygon", f"{ORD} select flow_id, ox, oy, dx, dy, o_totalprice from f where {_left_of(TRIANGLE, 'ox', 'oy')} and {_left_of(TRIANGLE, 'dx', 'dy')}")
def _(spark, d):
    return flows_ord(spark, d).clip(TRIANGLE).df


# ---------------------------------------------------------------- grids


def _grid_sql(by_size: bool, base: str, tail: str) -> str:
    cells = "40 as xs, w / 40 as ddx, h / 25 as ddy" if by_size else "cast(floor(w / 20) as bigint) as xs, 20::double as ddx, 30::double as ddy"
    at = ", ".join(f"cast(trunc(({p}{a} - min{a}) / dd{a}) as bigint) as {p}_grid_{a}" for p in "od" for a in "xy")
    return f"""{base}, b as (select min(least(ox, dx)) as minx, min(least(oy, dy)) as miny, max(greatest(ox, dx)) - min(least(ox, dx)) as w, max(greatest(oy, dy)) - min(least(oy, dy)) as h from f),
c as (select *, {cells} from b), g as (select f.*, xs, {at} from f, c), g2 as (select *, o_grid_y * xs + o_grid_x as o_grid_id, d_grid_y * xs + d_grid_x as d_grid_id from g) {tail}"""


GRID_COLUMNS = ("o_grid_x", "o_grid_y", "d_grid_x", "d_grid_y", "o_grid_id", "d_grid_id")


@query("grid_delta", _grid_sql(False, ORD, f"select flow_id, {', '.join(GRID_COLUMNS)} from g2"))
def _(spark, d):
    return zones.to_grid(flows_ord(spark, d), 20.0, 30.0).df.select(ID, *GRID_COLUMNS)


@query("grid_size", _grid_sql(True, ORD, f"select flow_id, {', '.join(GRID_COLUMNS)} from g2"))
def _(spark, d):
    return zones.to_grid(flows_ord(spark, d), x_size=40, y_size=25).df.select(ID, *GRID_COLUMNS)


@query("grid_od_counts", _grid_sql(False, LI, "select o_grid_id, d_grid_id, count(*) as flow_count, round(sum(w), 2) as total from (select o_grid_id, d_grid_id, g2.w from g2) group by 1, 2").replace("as h from f)", "as h from f)", 1).replace("- min(least(ox, dx)) as w,", "- min(least(ox, dx)) as bw,").replace("w / 20", "bw / 20"))
def _(spark, d):
    return zones.od_counts(zones.to_grid(flows_li(spark, d), 20.0, 30.0), "w").withColumn("total", F.round("total", 2))


# ---------------------------------------------------------------- pairs

for _mode, _sql in MODES.items():
    @query(f"pairwise_{_mode}", f"{PAIRS} select i, j, round({_sql}, 6) as dist from d")
    def _(spark, d, mode=_mode):
        return rounded_pairs(pairs.pairwise_distances(flows_emb(spark, d), mode), "dist")


@query("pairwise_weighted", f"{PAIRS} select i, j, round(sqrt({W1}::double * o_dist * o_dist + {W2}::double * d_dist * d_dist), 6) as dist from d")
def _(spark, d):
    return rounded_pairs(pairs.pairwise_distances(flows_emb(spark, d), "weighted", w1=W1, w2=W2, length=False), "dist")


@query("pairwise_weighted_len", f"{PAIRS} select i, j, case when i = j then 0 else round(sqrt(({W1}::double * o_dist * o_dist + {W2}::double * d_dist * d_dist) / ll), 6) end as dist from d")
def _(spark, d):
    return rounded_pairs(pairs.pairwise_distances(flows_emb(spark, d), "weighted", w1=W1, w2=W2), "dist")


@query("pairwise_haversine", f"{EMB} select a.flow_id as i, b.flow_id as j, round(greatest({HAVERSINE.format('a.ox', 'a.oy', 'b.ox', 'b.oy')}, {HAVERSINE.format('a.dx', 'a.dy', 'b.dx', 'b.dy')}), 6) as dist from f a cross join f b")
def _(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return rounded_pairs(pairs.pairwise_distances(flows_emb(spark, d).set_crs(4326)), "dist")


def _knn_sql(k: int) -> str:
    return f"{PAIRS}, r as (select i, {MODES['max']} as dist, row_number() over (partition by i order by {MODES['max']}, j) as rk from d where i <> j) select i as flow_id, round(dist, 6) as dist from r where rk = {k}"


for _k in (1, 5):
    @query(f"knn_k{_k}", _knn_sql(_k))
    def _(spark, d, k=_k):
        return rounded(pairs.k_neighbor_distances(flows_emb(spark, d), k), "dist")


for _mode, _sql in MODES.items():
    @query("eps_pairs" if _mode == "max" else f"eps_pairs_{_mode}", f"{PAIRS} select i, j, round({_sql}, 6) as dist from d where i <> j and {_sql} <= {EPS}::double")
    def _(spark, d, mode=_mode):
        return rounded_pairs(pairs.eps_pairs(flows_emb(spark, d), EPS, mode), "dist")


@query("snn_distance", f"""{PAIRS}, ro as (select i, j, row_number() over (partition by i order by o_dist, j) as rk from d where i <> j), rd as (select i, j, row_number() over (partition by i order by d_dist, j) as rk from d where i <> j),
so as (select a.i, b.i as j, count(*) as c from ro a join ro b on a.j = b.j where a.rk <= 5 and b.rk <= 5 group by 1, 2), sd as (select a.i, b.i as j, count(*) as c from rd a join rd b on a.j = b.j where a.rk <= 5 and b.rk <= 5 group by 1, 2)
select d.i, d.j, case when d.i = d.j then 0 else round(1 - coalesce(so.c, 0) / 5::double * coalesce(sd.c, 0) / 5::double, 6) end as dist from d left join so on d.i = so.i and d.j = so.j left join sd on d.i = sd.i and d.j = sd.j""")
def _(spark, d):
    return rounded_pairs(pairs.snn_distance(flows_emb(spark, d), 5), "dist")


# ---------------------------------------------------------------- statistics


@query("entropy", f"{ORD}, c as (select count(*)::double as n from f) select round(-n * (1 / n) * log2(1 / n + 1e-10), 6) as entropy from c")
def _(spark, d):
    return rounded(stats.flow_entropy(flows_ord(spark, d)), "entropy")


@query("entropy_batty", f"{EMB}, c as (select count(*)::double as n from f), a as (select (1 + (x.flow_id + y.flow_id) % 7)::double as a from f x cross join f y), s as (select sum(a) + 1e-10 as t from a) select round(-sum(1 / n * log2((1 / n) / (a / t + 1e-10) + 1e-10)), 4) as entropy from a, s, c")
def _(spark, d):
    f = flows_emb(spark, d)
    area = pairs.all_pairs(f.df).select("i", "j", (1 + (F.col("i") + F.col("j")) % 7).cast("double").alias("a"))
    return stats.flow_entropy(f, area).withColumn("entropy", F.round("entropy", 4))


@query("divergence_6", f"{LI}, a as (select case when t < 0 then t + 2 * pi() else t end as t from (select atan2(dy - oy, dx - ox) as t from f)), b as (select floor(t / (2 * pi() / 6))::bigint % 6 as s, count(*)::double as c from a group by 1), p as (select c / (select sum(c) from b) as p from b) select round(coalesce(-sum(p * log2(p + 1e-10)), 0), 6) as divergence from p")
def _(spark, d):
    return rounded(stats.flow_divergence(flows_li(spark, d)), "divergence")


def _density(k: int, where: str = "") -> str:
    return f"nn as (select i, dist from (select i, {MODES['max']} as dist, row_number() over (partition by i order by {MODES['max']}, j) as rk from d where i <> j) where rk = {k} {where}), den as (select count(*) / ({PI2} * sum(pow(dist, 4))) as lam from nn)"


for _k in (1, 3):
    @query("second_order_density" + f"_k{_k}" * (_k > 1), f"{PAIRS}, {_density(_k)} select round(lam, 4) as density from den")
    def _(spark, d, k=_k):
        return stats.second_order_density(flows_emb(spark, d), k=k).withColumn("density", F.round("density", 4))


MASKED = f"(select flow_id from f where {_strict('ox', 'oy', EMB_BOX)} and {_strict('dx', 'dy', EMB_BOX)})"


def _curve_sql(value: str, masked: bool) -> str:
    where = f"and i in {MASKED}" if masked else ""
    return f"""{PAIRS}, {_density(1, where)}, m as (select cast(floor(sqrt(pow(max(greatest(ox, dx)) - min(least(ox, dx)), 2) + pow(max(greatest(oy, dy)) - min(least(oy, dy)), 2)) / {DR}::double) as bigint) as m from f),
st as (select unnest(generate_series(1, (select m from m))) as step), n as (select count(*)::double as n from f {"where flow_id in " + MASKED if masked else ""}),
c as (select step, {DR}::double * step as r, count(*)::double as c from st join d on {MODES['max']} <= {DR}::double * step where true {where} group by step)
select step, round(r, 6) as r, {value} from c, n, den"""


@query("k_func", _curve_sql('round((c - n) / (n * lam), 6) as k', False))
def _(spark, d):
    return rounded(stats.k_func(flows_emb(spark, d), DR), "r", "k")


@query("k_func_mask", _curve_sql('round((c - n) / (n * lam), 6) as k', True))
def _(spark, d):
    return rounded(stats.k_func(flows_emb(spark, d), DR, mask=EMB_BOX), "r", "k")


@query("l_func", _curve_sql(f'round(pow(c / (n * lam) / {PI2}, 0.25::double) - r, 6) as l', False))
def _(spark, d):
    return rounded(stats.l_func(flows_emb(spark, d), DR), "r", "l")


@query("local_l", f"{PAIRS}, {_density(1)}, c as (select i, count(*)::double as c from d where {MODES['max']} <= {LOCAL_R}::double group by i) select i as flow_id, round(pow(c / ({PI2} * lam), 0.25::double) - {LOCAL_R}::double, 6) as l from c, den")
def _(spark, d):
    return rounded(stats.local_l_func(flows_emb(spark, d), LOCAL_R), "l")


# ---------------------------------------------------------------- tables


@query("concat", f"{ORD} select ox, oy, dx, dy from f union all select dx, dy, ox, oy from f")
def _(spark, d):
    f = flows_ord(spark, d)
    return concat(f, _reversed(f)).df.select("ox", "oy", "dx", "dy")


@query("head", f"{ORD} select flow_id, ox, oy, dx, dy, o_totalprice from f order by flow_id limit 100")
def _(spark, d):
    return flows_ord(spark, d).head(100).df


@query("describe_lengths", f"{LI}, v as (select {LEN} as l from f) select 'length' as \"column\", count(l) as count, round(avg(l), 6) as mean, round(stddev_samp(l), 6) as std, round(min(l), 6) as min, round(quantile_cont(l, 0.25), 6) as q25, round(quantile_cont(l, 0.5), 6) as q50, round(quantile_cont(l, 0.75), 6) as q75, round(max(l), 6) as max from v")
def _(spark, d):
    return rounded(describe(flows_li(spark, d).length(), "length"), "mean", "std", "min", "q25", "q50", "q75", "max")


@query("set_crs", f"{EMB} select flow_id, ox, oy, dx, dy, label from f")
def _(spark, d):
    return flows_emb(spark, d).set_crs("EPSG:4326").set_crs("EPSG:3857", allow_override=True).df


def _mercator(x: str, y: str) -> tuple[str, str]:
    return f"round(radians({x}) * 6378137::double, 4)", f"round(ln(tan(pi() / 4 + radians({y}) / 2)) * 6378137::double, 4)"


@query("to_crs_3857", f"{EMB} select flow_id, {', '.join(f'{e} as {n}' for e, n in zip((*_mercator('ox', 'oy'), *_mercator('dx', 'dy')), ff.COORDINATES, strict=True))} from f")
def _(spark, d):
    return flows_emb(spark, d).set_crs(4326).to_crs(3857).df.select(ID, *(F.round(c, 4).alias(c) for c in ff.COORDINATES))


@query("to_crs_utm_round_trip", f"{EMB} select flow_id, round(ox, 6) as ox, round(oy, 6) as oy, round(dx, 6) as dx, round(dy, 6) as dy from f")
def _(spark, d):
    moved = flows_emb(spark, d).set_crs(4326).to_crs(32631).to_crs(4326)
    return rounded(moved.df.select(ID, *ff.COORDINATES), *ff.COORDINATES)


@query("plot_data", f"""{EMB}, t as (select min(least(ox, dx)) as x0, max(greatest(ox, dx)) as x1, min(least(oy, dy)) as y0, max(greatest(oy, dy)) as y1 from f)
select flow_id, round(ox, 6) as x, round(oy, 6) as y, round(dx - ox, 6) as u, round(dy - oy, 6) as v, label::double as color, round(x0 - 0.03::double * (x1 - x0), 6) as xmin, round(x1 + 0.03::double * (x1 - x0), 6) as xmax, round(y0 - 0.03::double * (y1 - y0), 6) as ymin, round(y1 + 0.03::double * (y1 - y0), 6) as ymax from f, t""")
def _(spark, d):
    return rounded(flows_emb(spark, d).plot_data("label"), "x", "y", "u", "v", "xmin", "xmax", "ymin", "ymax")


@query("merge_attributes", f"{ORD} select flow_id, ox, oy, dx, dy, f.o_totalprice, o_orderstatus from f left join orders on flow_id = o_orderkey")
def _(spark, d):
    status = views.table(spark, d, "orders").select(F.col("o_orderkey").alias(ID), "o_orderstatus")
    return flows_ord(spark, d).merge(status, ID).df


# ---------------------------------------------------------------- clusters


@query("dbscan_labels", f"""with recursive f as ({EMBEDDING_SQL}), e as (select a.flow_id as i, b.flow_id as j from f a cross join f b where greatest({DO}, {DD}) <= {EPS}::double),
core as (select i from e group by i having count(*) >= 5), ce as (select i, j from e where i in (select i from core) and j in (select i from core)),
reach as (select i, j from ce union select r.i, ce.j from reach r join ce on r.j = ce.i), roots as (select i, min(j) as root from reach group by i), lab as (select i, dense_rank() over (order by root) - 1 as label from roots),
border as (select e.i, min(label) as label from e join lab on e.j = lab.i where e.i not in (select i from core) group by e.i)
select flow_id, cast(coalesce(lab.label, border.label, -1) as bigint) as label, lab.i is not null as core from f left join lab on flow_id = lab.i left join border on flow_id = border.i""")
def _(spark, d):
    return cluster.dbscan(flows_emb(spark, d), EPS, 5)


def _medoid_sql() -> str:
    each = [f"select flow_id, {k} as label, greatest(sqrt((ox - {a}::double) * (ox - {a}::double) + (oy - {b}::double) * (oy - {b}::double)), sqrt((dx - {c}::double) * (dx - {c}::double) + (dy - {e}::double) * (dy - {e}::double))) as dist from f" for k, (a, b, c, e) in enumerate(MEDOIDS)]
    return f"{EMB}, m as ({' union all '.join(each)}), r as (select *, row_number() over (partition by flow_id order by dist, label) as rk from m)"


@query("kmedoid_assign", f"{_medoid_sql()} select flow_id, label::bigint as label, round(dist, 6) as dist from r where rk = 1")
def _(spark, d):
    near = cluster.assign(flows_emb(spark, d).df, [(k, *m) for k, m in enumerate(MEDOIDS)])
    return rounded(near.select(ID, "label", "dist"), "dist")


@query("kmedoid_inertia", f"{_medoid_sql()} select round(sum(dist), 6) as inertia from r where rk = 1")
def _(spark, d):
    near = cluster.assign(flows_emb(spark, d).df, [(k, *m) for k, m in enumerate(MEDOIDS)])
    return near.agg(F.round(F.sum("dist"), 6).alias("inertia"))


@query("kmedoid")
def _(spark, d):
    return cluster.kmedoid(flows_emb(spark, d), n_clusters=4, n_init=1, max_iter=5, random_state=0)


# ---------------------------------------------------------------- manifold


def _p_sql(kernel: str) -> str:
    return f"""{PAIRS}, k as (select i, j, {kernel} as k from d where i <> j), s as (select i, sum(k) as s from k group by i), p as (select k.i, k.j, k / s as p from k join s on k.i = s.i), n as (select count(*)::double as n from f)
select i, j, round(greatest((a.p + b.p) / (2 * n), 1e-10) * 1000000, 4) as p from (select i, j, p from p) a join (select j as i, i as j, p from p) b using (i, j), n union all select flow_id, flow_id, 0 from f"""


_EO, _ED = "exp(-o_dist * o_dist / (2 * 0.02::double))", "exp(-d_dist * d_dist / (2 * 0.03::double))"


@query("ftsne_p_intersection", _p_sql("exp(-(o_dist * o_dist / (2 * 0.02::double) + d_dist * d_dist / (2 * 0.03::double)))"))
def _(spark, d):
    return rounded_pairs(manifold.multivariate_p(flows_emb(spark, d), ("o", "d"), (0.02, 0.03), "intersection").withColumn("p", F.col("p") * 1000000), "p", 4)


@query("ftsne_p_union", _p_sql(f"{_EO} + {_ED} - exp(-(o_dist * o_dist / (2 * 0.02::double) + d_dist * d_dist / (2 * 0.03::double)))"))
def _(spark, d):
    return rounded_pairs(manifold.multivariate_p(flows_emb(spark, d), ("o", "d"), (0.02, 0.03), "union").withColumn("p", F.col("p") * 1000000), "p", 4)


@query("ftsne")
def _(spark, d):
    return manifold.FTSNE(random_state=0).fit_transform(flows_emb(spark, d), identity={"o": 0, "d": 1})


__all__ = ["ORACLES", "QUERIES", "DataFrame", "SparkSession"]
