"""The flow value and the SQL functions."""

import math

import pytest

from flowloom import Flow, FlowFrame
from flowloom.functions.sql import register


def test_flow():
    f = Flow([(0, 0), (1, 1, 5)])
    assert (f.o, f.d, f.wkt, len(f)) == ((0.0, 0.0), (1.0, 1.0, 5.0), "FLOW (0.0 0.0, 1.0 1.0)", 2)
    assert Flow(f) == f and Flow().is_empty and str(Flow()) == "FLOW EMPTY"
    assert f.__geo_interface__["type"] == "Flow" and f.svg().count("<circle") == 2
    for bad in ([0, 1], [(0, 0)], [(0, 0), (1, 1), (2, 2)], [(0,), (1,)]):
        with pytest.raises(ValueError):
            Flow(bad)


def test_flow_as_a_literal(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 3.0, 4.0)], "flow_id long, ox double, oy double, dx double, dy double")
    assert FlowFrame(df).distance(Flow([(0, 0), (0, 0)])).first()["distance"] == 5.0


def test_sql_functions(spark):
    assert "flow_length" in register(spark)
    row = spark.sql("select flow_length(0, 0, 3, 4) as l, flow_angle(0, 0, 0, 1) as a, flow_wkt(0, 0, 1, 1) as w, flow_within_box(1, 1, 2, 2, 0, 0, 2, 3) as i, flow_distance_max(0, 0, 0, 0, 3, 4, 1, 0) as d, haversine_km(0, 0, 1, 1) as h").first()
    assert (row["l"], row["a"], row["w"], row["i"], row["d"]) == (5.0, pytest.approx(math.pi / 2), "FLOW (0.0 0.0, 1.0 1.0)", False, 5.0)
    assert row["h"] == pytest.approx(157.249381272)
