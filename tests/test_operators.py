"""Pairs, statistics, zones and clusters against hand-computed and brute-force values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.frame import FlowFrame
from flowloom.operators import pairs as P
from flowloom.operators import stats as S
from flowloom.operators import zones as Z
from flowloom.operators.cluster import DBSCANFlow, KMedoidFlow, assign, dbscan, inertia

SCHEMA = "flow_id long, ox double, oy double, dx double, dy double"


def frame(spark, rows, crs=3857):
    return FlowFrame(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], SCHEMA), crs)


@pytest.fixture(scope="module")
def chain(spark):
    return frame(spark, [(i, i, i + 1, i + 1) for i in range(5)])


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(5)
    rows = [tuple(round(rng.random(), 3) for _ in range(4)) for _ in range(60)] + [(0.5, 0.5, 0.5, 0.5)] * 3
    return frame(spark, rows), np.array(rows)


def matrix(x, mode="max"):
    o = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2))
    d = np.sqrt(((x[:, None, 2:] - x[None, :, 2:]) ** 2).sum(2))
    return {"max": np.maximum(o, d), "min": np.minimum(o, d), "sum": o + d, "mean": (o + d) / 2, "o": o, "d": d}[mode]


def by_id(df, column):
    return [r[column] for r in df.orderBy("flow_id").collect()]


@pytest.mark.parametrize("mode", ["max", "sum", "min", "mean"])
def test_pairwise(cloud, mode):
    f, x = cloud
    assert np.allclose(P.to_dense(P.pairwise_distances(f, mode)), matrix(x, mode))


def test_pairwise_golden(chain):
    got = P.to_dense(P.pairwise_distances(chain))
    assert np.allclose(got, math.sqrt(2) * np.abs(np.subtract.outer(range(5), range(5))))
    weighted = P.to_dense(P.pairwise_distances(chain, "weighted", w1=1, w2=1))
    assert np.allclose(weighted, np.sqrt(2 * got**2 / 2))


def test_pairwise_haversine(spark):
    f = frame(spark, [(0, 0, 1, 1), (1, 1, 2, 2)], 4326)
    with pytest.warns(UserWarning):
        got = P.to_dense(P.pairwise_distances(f, "min"))
    assert got[0, 1] == pytest.approx(157.225432038, abs=1e-6)
    with pytest.raises(ValueError):
        P.pairwise_distances(f, handle_geographic="error")
    assert P.to_dense(P.pairwise_distances(f, handle_geographic="ignore"))[0, 1] == pytest.approx(math.sqrt(2))
    with pytest.raises(ValueError):
        P.pairwise_distances(f, metric="none", handle_geographic="ignore")


def test_knn_golden(chain):
    r = math.sqrt(2)
    assert by_id(P.k_neighbor_distances(chain, 1), "dist") == pytest.approx([r] * 5)
    assert by_id(P.k_neighbor_distances(chain, 2), "dist") == pytest.approx([2 * r, r, r, r, 2 * r])
    assert by_id(P.k_neighbor_distances(chain, 5), "dist") == [math.inf] * 5
    with pytest.raises(ValueError):
        P.k_neighbor_distances(chain, 0)
    with pytest.raises(IndexError):
        P.k_neighbor_distances(chain, 6)


@pytest.mark.parametrize("mode", ["max", "mean"])
def test_knn_from_grid_cells(cloud, mode, monkeypatch):
    f, x = cloud
    monkeypatch.setattr(P, "ALL_PAIRS_FLOWS", 10)
    want = np.sort(matrix(x, mode) + np.diag([np.inf] * len(x)), axis=1)[:, 3]
    assert by_id(P.k_neighbor_distances(f, 4, mode), "dist") == pytest.approx(list(want))


@pytest.mark.parametrize("mode", ["max", "sum", "min", "mean", "weighted"])
def test_eps_pairs(cloud, mode):
    f, x = cloud
    d = np.sqrt(matrix(x, "o") ** 2 + matrix(x, "d") ** 2) if mode == "weighted" else matrix(x, mode)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.2), strict=True) if i != j}
    assert {(r["i"], r["j"]) for r in P.eps_pairs(f, 0.2, mode).collect()} == want


def test_snn(chain):
    got = P.to_dense(P.snn_distance(chain, 2))
    want = np.full((5, 5), 0.75)
    want[[1, 2, 2, 3], [2, 1, 3, 2]] = 1.0
    np.fill_diagonal(want, 0)
    assert np.allclose(got, want)
    assert np.allclose(P.to_dense(P.snn_distance(chain, 4))[0, 1:], 1 - 0.75**2)


def test_entropy_and_divergence(spark, chain):
    assert S.flow_entropy(chain).first()[0] == pytest.approx(2.3219280942, abs=1e-8)
    area = P.all_pairs(chain.df).select("i", "j", F.lit(1.0).alias("a"))
    assert S.flow_entropy(chain, area).first()[0] == pytest.approx(-11.6096404566, abs=1e-6)
    assert S.flow_divergence(chain).first()[0] == pytest.approx(0, abs=1e-8)
    empty = FlowFrame(spark.createDataFrame([], SCHEMA), 3857)
    assert S.flow_divergence(empty).first()[0] == 0.0
    four = frame(spark, [(0, 0, 1, 0), (0, 0, 0, 1), (0, 0, -1, 0), (0, 0, 0, -1)])
    assert S.flow_divergence(four, 4).first()[0] == pytest.approx(2.0, abs=1e-8)
    with pytest.raises(ValueError):
        S.flow_divergence(chain, 1)


def test_density_and_k(chain):
    assert S.second_order_density(chain).first()[0] == pytest.approx(0.0253302959, abs=1e-9)
    with pytest.raises(NotImplementedError):
        S.second_order_density(chain, "sum")
    k = [r["k"] for r in S.k_func(chain, 1.0).orderBy("step").collect()]
    assert k == pytest.approx([0, 63.165468, 110.539569, 110.539569, 142.122303, 157.913670, 157.913670], abs=1e-5)
    ell = [r["l"] for r in S.l_func(chain, 1.0).orderBy("step").collect()]
    assert ell == pytest.approx([0.414214, -0.204198, -1.025483, -2.025483, -2.928884, -3.885257, -4.885257], abs=1e-5)
    local = by_id(S.local_l_func(chain, 2.0), "l")
    assert local == pytest.approx([-0.318207, -0.138790, -0.138790, -0.138790, -0.318207], abs=1e-5)


def test_k_with_r_max_and_mask(cloud):
    f, _ = cloud
    whole = {r["step"]: r["k"] for r in S.k_func(f, 0.1, k=4).collect()}
    part = {r["step"]: r["k"] for r in S.k_func(f, 0.1, k=4, r_max=0.45).collect()}
    assert len(part) == 4 and all(part[s] == pytest.approx(whole[s]) for s in part)
    dist = P.pairwise_distances(f)
    a = [r["k"] for r in S.k_func(f, 0.2, k=4, mask=(0.1, 0.1, 0.9, 0.9)).orderBy("step").collect()]
    b = [r["k"] for r in S.k_func(f, 0.2, k=4, mask=(0.1, 0.1, 0.9, 0.9), pairs=dist).orderBy("step").collect()]
    assert a == pytest.approx(b)


def test_grid(spark):
    f = frame(spark, [(0, 0, 10, 10), (2.5, 5, 9.9, 0)])
    by_delta = Z.to_grid(f, 2.5, 5.0).df.orderBy("flow_id").collect()
    assert [(r["o_grid_x"], r["o_grid_y"], r["d_grid_x"], r["d_grid_y"]) for r in by_delta] == [(0, 0, 4, 2), (1, 1, 3, 0)]
    assert [r["o_grid_id"] for r in by_delta] == [0, 5]
    assert Z.to_grid(f, x_size=4, y_size=2).df.select("o_grid_id").orderBy("flow_id").collect()[1][0] == 5
    with pytest.raises(ValueError):
        Z.to_grid(f, delta_x=1)


def test_i_index_golden(spark):
    f = frame(spark, [(0, 0, 5000, 0), (0, 0, 4000, 0), (0, 0, 3000, 0), (0, 0, 2000, 0), (0, 0, 100, 0)])
    zones = spark.createDataFrame([(1, -1.0, -1.0, 9000.0, 1.0, "a"), (2, 9000.0, -1.0, 9999.0, 1.0, "b")], "zone_id long, minx double, miny double, maxx double, maxy double, name string")
    rows = {r["zone_id"]: r for r in Z.i_index(f, zones, 1000.0).collect()}
    assert (rows[1]["I_index"], rows[1]["flow_count"], rows[1]["total_length"], rows[1]["name"]) == (3, 5, pytest.approx(14.1), "a")
    assert (rows[2]["I_index"], rows[2]["flow_count"], rows[2]["total_length"]) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        Z.i_index(f, zones.drop("zone_id"))
    with pytest.raises(ValueError):
        Z.i_index(f, zones, od_type="x")
    far = Z.i_index(f, zones.filter("zone_id = 2")).first()
    assert math.isnan(far["alpha"]) and far["I_index"] == 0


def test_median_of_large_groups(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([1, 2, rng.random() * 9]))) for k in (1, 2, 3) for _ in range(50 + k)]
    df = spark.createDataFrame(rows, "g long, v double")
    a = {r["g"]: r["median"] for r in Z.group_median(df, "g", "v").collect()}
    b = {r["g"]: r["median"] for r in Z.group_median(df, "g", "v", rows=10).collect()}
    assert a == pytest.approx(b)


def test_polygon_zones_and_boundaries(spark):
    zones = Z.polygon_zones(spark, {1: "POLYGON ((0 0, 4 0, 0 4, 0 0))", 2: (0, 0, 1, 1)})
    points = spark.createDataFrame([(0, 1.5, 1.5), (1, 2.0, 2.0), (2, 3.0, 3.0), (3, 0.5, 0.5)], "p long, x double, y double")
    inside = {(r["p"], r["zone_id"]) for r in Z.spatial_join(points, "x", "y", zones).collect()}
    assert inside == {(0, 1), (3, 1), (3, 2)}
    assert (1, 1) in {(r["p"], r["zone_id"]) for r in Z.spatial_join(points, "x", "y", zones, boundary=True).collect()}
    assert Z.grid_zones(spark, 0, 0, 10, 5, 5).count() == 2


def brute_dbscan(d, eps, m):
    near = d <= eps
    core = near.sum(1) >= m
    label = np.full(len(d), -1)
    k = 0
    for i in range(len(d)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    if core[j]:
                        todo += [q for q in np.flatnonzero(near[j]) if label[q] < 0]
            k += 1
    return label


def test_dbscan(cloud):
    f, x = cloud
    got = np.array(by_id(dbscan(f, 0.22, 3), "label"))
    want = brute_dbscan(matrix(x), 0.22, 3)
    assert (got == want).all() and want.max() >= 1
    model = DBSCANFlow(0.22, 3)
    with pytest.raises(ValueError):
        _ = model.n_clusters
    assert model.fit(f).n_clusters == want.max() + 1
    with pytest.raises(ValueError):
        DBSCANFlow(distance="weighted")


@pytest.mark.parametrize("mode", ["max", "sum", "min", "mean"])
def test_dbscan_of_repeated_flows(spark, mode):
    rng = random.Random(5)
    places = [tuple(rng.random() for _ in range(4)) for _ in range(25)]
    x = np.array([rng.choice(places) for _ in range(120)])
    got = dbscan(frame(spark, [tuple(map(float, r)) for r in x]), 0.3, 9, mode)
    want = brute_dbscan(matrix(x, mode), 0.3, 9)
    assert by_id(got, "label") == list(want) and want.max() >= 0


def test_dbscan_leaves_flows_without_coordinates_alone(spark):
    rows = [(0, 0.0, 0.0, 1.0, 1.0), *((i, None, 0.0, 1.0, 1.0) for i in range(1, 5)), *((i, float("nan"), 0.0, 1.0, 1.0) for i in range(5, 9)), (9, 0.0, 0.0, 1.0, 1.0)]
    f = FlowFrame(spark.createDataFrame(rows, "flow_id long, ox double, oy double, dx double, dy double"))
    got = {r["flow_id"]: (r["label"], r["core"]) for r in dbscan(f, 0.5, 2).collect()}
    assert got == {i: ((0, True) if i in (0, 9) else (-1, False)) for i in range(10)}
    assert dbscan(f._with(f.df.filter("false")), 0.5, 2).count() == 0


@pytest.mark.parametrize("mode", ["max", "sum", "mean"])
def test_eps_pairs_at_the_very_distance(spark, mode):
    rows = [(i * 0.1, 0.0, 0.0, i * 0.1) for i in range(-12, 12)]
    x = np.array(rows)
    for eps in (0.1, 0.2, 0.30000000000000004):
        d = matrix(x, mode)
        want = {(i, j) for i, j in zip(*np.nonzero(d <= eps), strict=True) if i != j}
        assert {(r["i"], r["j"]) for r in P.eps_pairs(frame(spark, rows), eps, mode).collect()} == want


def test_kmedoid_metric_at_every_size(spark):
    rows = [(0.0, 60.0, 0.0, 60.0), (1.0, 60.0, 1.0, 60.0), (0.0, 61.0, 0.0, 61.0), (40.0, 0.0, 40.0, 0.0)]
    geographic = frame(spark, rows, 4326)
    for method, metric in (("auto", "euclidean"), ("precompute", "euclidean"), ("online", "haversine")):
        model = KMedoidFlow(2, method=method, n_init=1, random_state=0, metric=metric).fit(geographic)
        assert model.inertia_ == pytest.approx(inertia(assign(geographic.df, model.medoids_, "max", metric == "haversine")))
    with pytest.raises(ValueError):
        KMedoidFlow(2, metric="haversine").fit(frame(spark, rows))
    with pytest.raises(ValueError):
        KMedoidFlow(metric="cosine")


def test_kmedoid(spark):
    rng = random.Random(2)
    rows = [tuple(c + rng.random() / 10 for c in base) for base in ((0, 0, 1, 1), (5, 5, 6, 6)) for _ in range(10)]
    f = frame(spark, rows)
    model = KMedoidFlow(2, n_init=2, random_state=0, update="within").fit(f)
    labels = by_id(model.labels_, "label")
    assert len(set(labels[:10])) == 1 and len(set(labels[10:])) == 1 and labels[0] != labels[10]
    assert by_id(model.predict(f), "label") == labels
    assert model.inertia_ < 3
    with pytest.raises(ValueError):
        KMedoidFlow(method="fast")


def test_nth_largest(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (2, 5.0), (2, 7.0)], "g long, v double")
    assert {tuple(r) for r in S.nth_largest(df, "g", "v", 2).collect()} == {(1, 2.0), (2, 5.0)}
    with pytest.raises(ValueError):
        S.nth_largest(df, "g", "v", 3)


def test_quantiles_by_narrowing(spark, monkeypatch):
    from flowloom import frame as frames

    rng = np.random.RandomState(3)
    for values in (rng.exponential(1.0, 997) ** 4, np.r_[np.zeros(600), rng.rand(301)], np.array([5.0]), np.arange(10.0), np.r_[rng.rand(500), 1e300]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = frames.exact_quantiles(df, [0.0, 0.25, 0.5, 0.75, 1.0], rows=20)
        assert np.allclose(got, np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]), rtol=1e-12)
    assert frames.exact_quantiles(df.filter("false"), [0.5]) == [None]


def test_a_large_zone_among_small_ones(spark):
    """Each zone reaches into few cells, whatever its size, and the join is that of all pairs."""
    rows = [(i, float(i), 0.0, i + 1.0, 1.0) for i in range(40)] + [(40, -5000.0, -5000.0, 5000.0, 5000.0), (41, 3.0, 0.5, 3.0, 0.5)]
    boxes = spark.createDataFrame(rows, "zone_id long, minx double, miny double, maxx double, maxy double")
    points = [(float(x), float(y)) for x, y in np.random.RandomState(1).uniform(-3, 43, (200, 2)).tolist()] + [(3.0, 0.5), (4999.0, -4999.0)]
    df = spark.createDataFrame(points, "x double, y double")
    for boundary in (False, True):
        inside = (lambda x, y, b: b[1] <= x <= b[3] and b[2] <= y <= b[4]) if boundary else (lambda x, y, b: b[1] < x < b[3] and b[2] < y < b[4])
        want = sorted((x, y, b[0]) for x, y in points for b in rows if inside(x, y, b))
        got = sorted((r["x"], r["y"], r["zone_id"]) for r in Z.spatial_join(df, "x", "y", boxes, boundary).collect())
        assert got == want


def test_zone_points_beside_an_edge_follow_its_cross_product(spark):
    ring = ((100.0, 100.0), (900.0, 200.0), (500.0, 800.0), (100.0, 100.0))
    at = [(125.6, 144.8), (127.6, 148.3), (131.6, 155.3), (899.8, 200.3), (125.5, 144.7), (500.0, 800.0)]
    left = lambda x, y: all((bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0 for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))
    want = [i for i, p in enumerate(at) if left(*p)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "i long, x double, y double")
    got = Z.spatial_join(points, "x", "y", Z.polygon_zones(spark, {1: ring})).orderBy("i").collect()
    assert want and [r["i"] for r in got] == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_copied_or_mirrored(cloud):
    f, x = cloud
    pairs = P.pairwise_distances(f, "sum")
    assert np.allclose(P.to_dense(pairs), matrix(x, "sum")) and "inline" not in plan_of(pairs)
    assert P.blocks_for(51_282) <= 26  # a flow moves once a block on either side
    assert np.allclose(P.to_dense(P.pairwise_distances(f, "sum", metric=lambda ax, ay, bx, by: F.abs(ax - bx))), np.abs(x[:, None, 0] - x[None, :, 0]) + np.abs(x[:, None, 2] - x[None, :, 2]))


def test_eps_min_pairs_are_found_once(spark):
    rng = np.random.RandomState(5)
    x = rng.randint(0, 6, (60, 4)) / 10
    got = P.eps_pairs(frame(spark, x.tolist()), 0.1, "min")
    assert "Aggregate" not in plan_of(got)
    d = matrix(x, "min")
    want = sorted((i, j) for i, j in zip(*np.nonzero(d <= 0.1), strict=True) if i != j)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_nearest_from_tiles_with_ties(spark, monkeypatch):
    x = np.random.RandomState(6).randint(0, 3, (70, 4)).astype(float)
    f = frame(spark, x.tolist())
    ids = [r["flow_id"] for r in f.df.orderBy("flow_id").collect()]
    for mode in ("max", "sum", "min", "mean"):
        d = matrix(x, mode)
        got = P.k_nearest(f.df, 4, P.pair_distance(f, mode), len(x), mode=mode)
        assert "MapInArrow" in plan_of(got)
        want = {(ids[i], ids[j], r) for i in range(len(x)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:4], 1)}
        assert {(r["i"], r["j"], r["rank"]) for r in got.collect()} == want
    assert "MapInArrow" in plan_of(P.k_neighbor_distances(f, 3))
    assert "MapInArrow" not in plan_of(P.k_neighbor_distances(FlowFrame(f.df.withColumn("ox", F.expr("nullif(ox, 1)"))), 3))


def test_snn_joins_no_rows_of_all_pairs(cloud):
    f, x = cloud
    got = P.snn_distance(f, 3)
    assert not [line for line in plan_of(got).splitlines() if "LeftOuter" in line and "__q" not in line]
    near = {e: [set([j for j in np.lexsort((np.arange(len(x)), matrix(x, e)[i])) if j != i][:3]) for i in range(len(x))] for e in "od"}
    want = [[0.0 if i == j else 1 - len(near["o"][i] & near["o"][j]) * len(near["d"][i] & near["d"][j]) / 9 for j in range(len(x))] for i in range(len(x))]
    assert np.allclose(P.to_dense(got), want)


@pytest.mark.parametrize("distance", ["max", "mean"])
def test_curves_count_pairs_in_tiles(cloud, distance):
    f, x = cloud
    for mask in (None, (0.1, 0.1, 0.9, 0.9)):
        got = S._curve(f, 0.1, 1, distance, mask, None, None)[0]
        assert "MapInArrow" in plan_of(got)
        want = S._curve(f, 0.1, 1, distance, mask, P.pairwise_distances(f, distance), None)[0]
        assert got.orderBy("step").collect() == want.orderBy("step").collect()


def test_written_pairs_hold_a_distance_once(spark, tmp_path):
    x = np.random.RandomState(6).rand(700, 4)
    out = str(tmp_path / "pairs")
    P.pairwise_distances(frame(spark, x.tolist()), "max").coalesce(1).write.parquet(out)
    assert spark.read.parquet(out).count() == 700 * 700
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * 700 * 700  # nearly nine bytes a row if each order has its own


def test_pairs_in_numpy_equal_the_expressions(spark, monkeypatch):
    x = np.round(np.random.RandomState(7).rand(70, 4), 2)
    x[3], x[4], x[5, 2:], x[6, 2:] = x[2], [0.1, 0.1, 0.1, 0.1], x[5, :2], x[6, :2]
    monkeypatch.setattr(P, "RUN_FLOWS", 8)
    monkeypatch.setattr(P, "BLOCK_FLOWS", 30)
    flows = frame(spark, x.tolist())
    for mode, metric, use_length in (*((m, "euclidean", False) for m in ("max", "sum", "min", "mean", "weighted")), *(("weighted", m, True) for m in P.METRICS)):
        got = {(r["i"], r["j"]): r["dist"] for r in P.pairwise_distances(flows, mode, metric, 0.3, 0.7, use_length).collect()}
        dist = P.pair_distance(flows, mode, metric, 0.3, 0.7, use_length)
        want = {(r["i"], r["j"]): r["dist"] if r["i"] != r["j"] else 0.0 for r in P.all_pairs(flows.df).select("i", "j", dist.alias("dist")).collect()}
        assert got.keys() == want.keys() and len(got) == 70 * 70
        keys = sorted(got)
        np.testing.assert_allclose([got[k] for k in keys], [want[k] for k in keys], rtol=1e-13 if metric == "haversine" else 0, atol=0)


def test_pairs_of_flows_without_a_coordinate(spark):
    got = P.pairwise_distances(FlowFrame(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 3.0, 4.0, None, 1.0)], SCHEMA), 3857), "max").collect()
    assert sorted((r["i"], r["j"], r["dist"]) for r in got) == [(0, 0, 0.0), (0, 1, 5.0), (1, 0, 5.0), (1, 1, 0.0)]
