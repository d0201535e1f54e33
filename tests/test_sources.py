"""Vector files: what is written is read back."""

import json

import pytest
from pyspark.errors import PySparkException

from flowloom.frame import FlowFrame
from flowloom.sources.tables import read_parquet
from flowloom.sources.vector import read_file, to_file, wkb_ends

SCHEMA = "flow_id long, ox double, oy double, dx double, dy double, name string, weight double"
ROWS = [(0, 0.0, 0.5, 1.0, 1.5, "a", 2.5), (1, -1.0, 2.0, 3.0, 4.25, None, None), (2, 5.0, 5.0, 6.0, 6.0, "ü", -1.0)]


@pytest.fixture()
def flows(spark):
    return FlowFrame(spark.createDataFrame(ROWS, SCHEMA), 3857)


@pytest.mark.parametrize("name", ["f.gpkg", "f.shp", "f.geojson", "f.parquet"])
def test_round_trip(spark, flows, tmp_path, name):
    path = str(tmp_path / name)
    to_file(flows, path)
    back = read_file(spark, path)
    rows = sorted(tuple(r[c] for c in ("ox", "oy", "dx", "dy", "name", "weight")) for r in back.df.collect())
    assert rows == sorted(r[1:] for r in ROWS)
    if not name.endswith("geojson"):
        assert back.crs == "EPSG:3857"


def test_feature_collection(spark, tmp_path):
    line = lambda c: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": c}, "properties": {"v": 1}}
    path = tmp_path / "c.geojson"
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32618"}}
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": [line([[0, 0], [9, 9], [1, 1]]), line([[2, 2], [3, 3]])]}))
    f = read_file(spark, str(path))
    assert f.crs == "EPSG:32618"
    assert sorted(tuple(r)[1:] for r in f.df.collect()) == [(0, 0, 1, 1, 1), (2, 2, 3, 3, 1)]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [[0, 0]]}, "properties": {}}]}))
    with pytest.raises(PySparkException):
        read_file(spark, str(path)).df.collect()


def test_append_and_layers(spark, flows, tmp_path):
    path = str(tmp_path / "l.gpkg")
    to_file(flows, path, layer="one")
    to_file(flows, path, layer="one", mode="a")
    to_file(flows.head(1), path, layer="two", mode="a")
    assert read_file(spark, path, layer="one").df.count() == 6
    assert read_file(spark, path, layer="two").df.count() == 1
    with pytest.raises(ValueError):
        read_file(spark, path, layer="three")


def test_parquet_filter_reaches_the_scan(spark, flows, tmp_path):
    path = str(tmp_path / "p.parquet")
    flows.df.write.parquet(path)
    clipped = read_parquet(spark, path).clip((4, 4, 9, 9))
    assert clipped.df.count() == 1
    plan = clipped.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(ox,4.0)" in plan


def test_unknown_format(spark, flows, tmp_path):
    with pytest.raises(NotImplementedError):
        read_file(spark, str(tmp_path / "x.kml"))
    with pytest.raises(NotImplementedError):
        to_file(flows, str(tmp_path / "x.kml"))


def test_wkb():
    import struct

    line = struct.pack("<BII6d", 1, 2, 3, 0, 0, 5, 5, 1, 2)
    assert wkb_ends(line) == (0, 0, 1, 2)
    points = struct.pack(">BII", 0, 4, 2) + b"".join(struct.pack(">BIdd", 0, 1, x, y) for x, y in ((1, 2), (3, 4)))
    assert wkb_ends(points) == (1, 2, 3, 4)
    with pytest.raises(TypeError):
        wkb_ends(struct.pack("<BIdd", 1, 1, 0, 0) + bytes(8))
