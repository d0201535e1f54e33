"""Flow frames: construction, CRS rules, expressions, table operations."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowloom.frame import FlowFrame, concat, describe
from flowloom.functions import geometry
from flowloom.functions.geometry import as_polygon, box
from flowloom.sources.tables import flows_from_geometry, flows_from_od, flows_from_points, flows_from_wkt, read_csv

SCHEMA = "flow_id long, ox double, oy double, dx double, dy double"


def frame(spark, rows, crs=None, extra="", ids=True):
    return FlowFrame(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA + extra), crs)


def values(df, column):
    return [r[column] for r in df.orderBy("flow_id").collect()]


@pytest.fixture()
def chain(spark):
    return frame(spark, [(float(i), float(i), i + 1.0, i + 1.0, i + 1) for i in range(5)], 3857, ", value long")


def test_length_angle_and_wkt(chain):
    assert values(chain.length(), "length") == pytest.approx([math.sqrt(2)] * 5)
    assert values(chain.angle(), "angle") == pytest.approx([math.pi / 4] * 5)
    assert values(chain.wkt(), "wkt")[0] == "FLOW (0.0 0.0, 1.0 1.0)"


def test_angle_of_axes(spark):
    f = frame(spark, [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)], 32618)
    assert values(f.angle(), "angle") == pytest.approx([0, math.pi / 2])


def test_geographic_angle_and_volume_warn(spark):
    f = frame(spark, [(0.0, 0.0, 1.0, 1.0)], 4326)
    with pytest.warns(UserWarning):
        f.angle()
    with pytest.warns(UserWarning):
        f.volume_density()


def test_volume_and_density(chain, spark):
    assert (chain.volume, chain.density) == (25.0, 0.2)
    assert frame(spark, [(1.0, 1.0, 1.0, 1.0)], 3857).density == math.inf


def test_within_leaves_the_boundary_out(spark):
    f = frame(spark, [(0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 3.0, 1.0), (None, 0.0, 1.0, 1.0)], 4326)
    assert values(f.within((-1, -1, 3, 3)), "within") == [False, True, False, False]
    assert [r["flow_id"] for r in f.clip(box(-1, -1, 3, 3)).df.collect()] == [1]


def test_polygon_with_hole_and_parts(spark):
    mask = "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 0, 30 0, 25 10, 20 0)))"
    points = [(1, 1), (5, 5), (4, 5), (25, 5), (15, 5), (10, 5), (25, 10)]
    f = frame(spark, [(float(x), float(y), float(x), float(y)) for x, y in points])
    assert values(f.within(mask), "within") == [True, False, False, True, False, False, False]
    assert as_polygon(as_polygon(mask).to_wkt()) == as_polygon(mask)
    assert values(f.within([(0, 0, 3, 3), (24, 4, 26, 6)]), "within") == [True, False, False, True, False, False, False]


def test_rowwise_masks(spark, chain):
    boxes = spark.createDataFrame([(0, -1.0, -1.0, 2.0, 2.0), (1, 5.0, 5.0, 6.0, 6.0)], "flow_id long, minx double, miny double, maxx double, maxy double")
    assert values(chain.within_each(boxes), "within") == [True, False, False, False, False]


def test_distances(spark, chain):
    to = ((0.0, 0.0), (4.0, 5.0))
    f = frame(spark, [(3.0, 4.0, 4.0, 5.0), (0.0, 0.0, 4.0, 8.0)])
    got = {m: values(f.distance(to, m), "distance") for m in ("max", "sum", "min", "mean")}
    assert got == {"max": [5.0, 3.0], "sum": [5.0, 3.0], "min": [0.0, 0.0], "mean": [2.5, 1.5]}
    assert values(f.distance(to, "weighted", 2, 3), "distance") == [10.0, 9.0]
    other = frame(spark, [(0.0, 0.0, 3.0, 4.0), (1.0, 1.0, 4.0, 5.0)])
    assert values(f.distance(other, "max"), "distance") == [5.0, 3.0]
    with pytest.raises(ValueError):
        f.distance(to, "median")


def test_weighted_distance_of_a_flow_without_length(spark):
    a = frame(spark, [(0.0, 0.0, 0.0, 0.0)])
    b = frame(spark, [(1.0, 0.0, 1.0, 1.0)])
    assert values(a.distance(b, "weighted", length=True), "distance") == [math.inf]


def test_crs_rules(spark, chain):
    assert chain.crs == "EPSG:3857" and chain.df.schema["ox"].metadata["crs"] == "EPSG:3857"
    with pytest.raises(ValueError):
        chain.set_crs(4326)
    assert chain.set_crs(4326, allow_override=True).crs == "EPSG:4326"
    with pytest.raises(ValueError):
        FlowFrame(chain.df, 4326)
    with pytest.raises(ValueError):
        FlowFrame(spark.range(3), 4326)
    with pytest.raises(AttributeError):
        FlowFrame(spark.range(3))
    with pytest.warns(DeprecationWarning):
        chain.copy().crs = 4326
    with pytest.raises(NotImplementedError):
        chain.to_crs(2056)


def test_mercator_and_back(spark):
    f = frame(spark, [(0.0, 0.0, 1.0, 1.0), (1.0, 2.0, 3.0, 4.0)], 4326)
    m = f.to_crs(3857)
    row = m.df.orderBy("flow_id").first()
    assert (row["dx"], row["dy"]) == pytest.approx((111319.490793, 111325.142866), abs=1e-5)
    back = m.to_crs(4326).df.orderBy("flow_id").collect()
    assert [tuple(r)[1:] for r in back] == [pytest.approx((0, 0, 1, 1), abs=1e-9), pytest.approx((1, 2, 3, 4), abs=1e-9)]


@pytest.mark.parametrize(("code", "lon", "lat"), [(32618, -75.0, 40.0), (32718, -72.5, -33.0), (32631, 3.7, 51.2), (4526, 114.9, 30.5)])
def test_transverse_mercator_round_trip(spark, code, lon, lat):
    f = frame(spark, [(lon, lat, lon + 0.5, lat - 0.5)], 4326)
    back = f.to_crs(code).to_crs(4326).df.first()
    assert tuple(back)[1:] == pytest.approx((lon, lat, lon + 0.5, lat - 0.5), abs=1e-9)


def test_utm_central_meridian(spark):
    row = frame(spark, [(-75.0, 0.0, -75.0, 40.0)], 4326).to_crs(32618).df.first()
    assert (row["ox"], row["oy"]) == pytest.approx((500000, 0), abs=1e-6)
    # meridian arc to 40 degrees on WGS 84 is 4,429,529.03 m; times 0.9996
    assert (row["dx"], row["dy"]) == pytest.approx((500000, 4429529.0302 * 0.9996), abs=0.01)


def test_containers(spark, chain):
    assert isinstance(chain[["flow_id", "ox", "oy", "dx", "dy"]], FlowFrame)
    assert chain[["value"]].columns == ["value"]
    assert values(chain.head(2).df, "value") == [1, 2]
    assert values(chain.loc([1, 3]).df, "value") == [2, 4]
    assert values(chain.with_column("twice", F.col("value") * 2).df, "twice") == [2, 4, 6, 8, 10]
    assert values(chain.set_flow(1, ((9.0, 9.0), (8.0, 8.0))).df, "ox") == [0, 9, 2, 3, 4]
    assert values(chain.set_geometry(["dx", "dy", "ox", "oy"]).df, "ox") == [1, 2, 3, 4, 5]
    assert set(values(chain.set_geometry(((0, 0), (1, 1))).df, "dx")) == {1.0}
    assert values(chain.filter("value > 3").reset_index().df, "value") == [4, 5]
    assert values(chain.top(2, "value").df, "value") == [4, 5]
    for bad in ("ox", ["ox", "oy"][:1], ["a", "b", "c", "d"]):
        with pytest.raises(TypeError):
            chain.set_geometry(bad)
    with pytest.raises(TypeError):
        chain.astype("float")


def test_concat(chain, spark):
    both = concat(chain, chain)
    assert values(both.df, "flow_id") == list(range(10)) and values(both.df, "value") == [1, 2, 3, 4, 5] * 2
    with pytest.raises(ValueError):
        concat(chain, chain.set_crs(4326, allow_override=True))
    with pytest.raises(TypeError):
        concat(chain, chain.df)


def test_describe(chain):
    row = describe(chain.df, "value").first()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (5, 3.0, 1.0, 3.0, 5.0)


def test_plot_data(spark):
    f = frame(spark, [(0.0, 0.0, 1.0, 2.0, "B"), (1.0, 1.0, 2.0, 2.0, "A"), (2.0, 2.0, 3.0, 3.0, "B")], None, ", kind string")
    rows = f.plot_data("kind").orderBy("flow_id").collect()
    assert [r["color"] for r in rows] == [1.0, 0.0, 1.0] and (rows[0]["u"], rows[0]["v"]) == (1.0, 2.0)
    assert (rows[0]["xmin"], rows[0]["xmax"]) == pytest.approx((-0.09, 3.09))
    with pytest.raises(ValueError):
        f.plot_data("none")


def test_flows_from_od(spark):
    f = flows_from_od(spark, [(0, 0), (1, 2), (3, 4)], [(1, 1), (2, 3), (5, 6)])
    assert values(f.df, "dx") == [1, 2, 5]
    for o, d in (([0, 1], [(1, 1), (2, 2)]), ([(0, 0)], [(1, 1), (2, 2)])):
        with pytest.raises(ValueError):
            flows_from_od(spark, o, d)


def test_flows_from_points(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "k long, x double, y double")
    assert values(flows_from_points(o, o, "k").length(), "length") == [0, 0]


def test_flows_from_geometry(spark):
    mixed = ["LINESTRING (0 0, 1 1)", {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, ((5, 6), (7, 8))]
    f = flows_from_geometry(spark, mixed, 3857)
    assert f.crs == "EPSG:3857" and values(f.df, "ox") == [0, 1, 5]
    with pytest.warns(UserWarning):
        flows_from_geometry(spark, ["LINESTRING (0 0, 1 1, 2 2)"])
    for bad in (["POINT (0 0)"], "LINESTRING (0 0, 1 1)"):
        with pytest.raises(TypeError):
            flows_from_geometry(spark, bad)


def test_flows_from_wkt_column(spark):
    df = spark.createDataFrame([(0, "LINESTRING (0 0, 5 5, 1.5 -2e1)"), (1, "FLOW EMPTY"), (2, None), (3, "multipoint ((1 2), (3 4))")], "flow_id long, g string")
    rows = flows_from_wkt(df, "g").df.orderBy("flow_id").collect()
    assert [tuple(r)[1:5] for r in rows] == [(0, 0, 1.5, -20), (None,) * 4, (None,) * 4, (1, 2, 3, 4)]
    with pytest.raises(PySparkException):
        flows_from_wkt(spark.createDataFrame([(0, "POINT (1 2)")], "flow_id long, g string"), "g").df.collect()


def test_read_csv(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("o_x,o_y,d_x,d_y,name\n0,0,1,1,a\n1,2,3,4,b\n")
    for cols in (["o_x", "o_y", "d_x", "d_y"], [0, 1, 2, 3]):
        f = read_csv(spark, str(path), cols, 4326)
        assert values(f.df, "dx") == [1, 3] and values(f.df, "name") == ["a", "b"] and values(f.df, "o_x") == [0, 1]
    with pytest.raises(ValueError):
        read_csv(spark, str(path), ["o_x", "o_y"])


def test_a_mask_of_many_edges(spark, monkeypatch):
    ring = [((2 + math.sin(7 * t)) * math.cos(t), (2 + math.sin(7 * t)) * math.sin(t)) for t in (2 * math.pi * k / 5000 for k in range(5000))]
    rng = random.Random(3)
    ends = [*ring[:20], *((rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(400))]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(ends)], "i long, x double, y double")
    short = ring[::50]  # spelt out, and by bands, with equal results
    parts = [short, (-2, -2, 0.5, 0.1), [(0, 0), (3, 3), (0, 3), (1.5, 1.4)]]
    tall = [(-3 + k / 10, -3 if k % 2 else 3) for k in range(60)]
    for mask, limits in ((ring, (200,)), (short, (200, 0)), (parts, (200, 0)), (tall, (1000, 0))):
        found = []
        for limit in limits:
            monkeypatch.setattr(geometry, "SPELT_EDGES", limit)
            for boundary in (False, True):
                found.append([r["i"] for r in points.filter(geometry.contains(geometry.as_polygon(mask), F.col("x"), F.col("y"), boundary)).orderBy("i").collect()])
        assert found[0] and set(found[0]) <= set(found[1]) and found[:2] == found[-2:]


def test_points_beside_an_edge_follow_its_cross_product(spark):
    ring = ((100.0, 100.0), (900.0, 200.0), (500.0, 800.0), (100.0, 100.0))
    at = [(125.6, 144.8), (127.6, 148.3), (131.6, 155.3), (899.8, 200.3), (125.5, 144.7), (500.0, 800.0)]
    left = lambda x, y: all((bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0 for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))
    want = [i for i, p in enumerate(at) if left(*p)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "i long, x double, y double")
    got = points.filter(geometry.contains(as_polygon(ring), F.col("x"), F.col("y"))).orderBy("i").collect()
    assert want and [r["i"] for r in got] == want
