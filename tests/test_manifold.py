"""Flow t-SNE: kernels against plain numpy, and that the loss falls."""

import math
import re

import numpy as np
import pytest

from flowloom.frame import FlowFrame
from flowloom.operators import manifold as M

SCHEMA = "flow_id long, ox double, oy double, dx double, dy double"


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.randn(20, 4) * 0.1, rng.randn(20, 4) * 0.1 + 3])
    return FlowFrame(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], SCHEMA)), x


def joint(x, perplexity):
    p, _ = M.conditional_p(M.sq_distances(x, x), np.arange(len(x)), perplexity)
    return M.make_joint(p)


def test_perplexity_is_met(flows):
    _, x = flows
    p, sigma2 = M.conditional_p(M.sq_distances(x, x), np.arange(len(x)), 7.0)
    entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
    assert np.allclose(np.exp(entropy), 7.0, atol=1e-3) and (sigma2 > 0).all() and np.allclose(p.sum(1), 1)


def test_tiles_equal_the_dense_matrix(flows, monkeypatch):
    f, x = flows
    model = M.FTSNE(perplexity=5)
    ids, values = model._values(f, {"o"})
    tiles = model._tiles(f.spark, values, ("identity", ("o",), (0,)), {}, "probability", len(x))
    got = np.zeros((len(x), len(x)))
    for r in M.tiles_to_pairs(tiles, ids).collect():
        got[r["i"], r["j"]] = r["p"]
    assert np.allclose(got, joint(x[:, :2], 5))


@pytest.mark.parametrize("loss", ["kl", "hd"])
def test_gradient_by_differences(flows, loss):
    f, x = flows
    model = M.FTSNE(perplexity=5)
    _, values = model._values(f, {"o"})
    tiles = model._tiles(f.spark, values, ("identity", ("o",), (0, 1)), {}, "probability", len(x))
    p = joint(x[:, :2], 5)
    p /= p.sum()
    y = np.random.RandomState(1).randn(len(x), 2)

    def value(y):
        w = M.inv_sd(y)
        np.fill_diagonal(w, 0)
        q = w / w.sum()
        on = p > 0
        return (p[on] * np.log(p[on] / q[on])).sum() if loss == "kl" else ((np.sqrt(p) - np.sqrt(q)) ** 2).sum()

    g, _ = M.gradient(tiles, y, 1.0, loss)
    for i, k in ((0, 0), (7, 1), (33, 0)):
        up, down = y.copy(), y.copy()
        up[i, k] += 1e-5
        down[i, k] -= 1e-5
        assert g[i, k] * 4 / M.GRADIENT_FACTOR == pytest.approx((value(up) - value(down)) / 2e-5, rel=2e-2, abs=1e-6)


@pytest.mark.parametrize("options", [{}, {"method": "barnes_hut"}, {"loss_func": "hd"}])
def test_loss_falls(flows, options):
    f, _ = flows
    model = M.FTSNE(perplexity=5, max_iter=8, early_exaggeration_iter=0, learning_rate=1.0, random_state=0, **options)
    out = model.fit_transform(f, identity={("o", "d"): (0, 1)})
    assert out.count() == 40 and out.columns == ["flow_id", "e0", "e1"]
    assert model.losses_[-1] < model.losses_[0]


@pytest.mark.parametrize("relation", ["probability", "distance"])
def test_combined_mappings(flows, relation):
    f, _ = flows
    out = M.FTSNE(perplexity=5, max_iter=2, random_state=0).fit_transform(f, identity={"length": 0}, intersection={("o", "d"): 1}, union={("o", "angle"): 2}, metrics={"angle": "cosine"}, relation=relation)
    assert all(math.isfinite(v) for r in out.collect() for v in r)


def test_refusals(flows):
    f, _ = flows
    model = M.FTSNE(perplexity=5)
    for error, kw in (
        (ValueError, {}),
        (ValueError, {"identity": {"none": 0}}),
        (ValueError, {"identity": {"o": 1}}),
        (ValueError, {"intersection": {"o": 0}}),
        (ValueError, {"identity": {"o": 0}, "relation": "sum"}),
        (ValueError, {"identity": {"o": 0}, "metrics": {"o": "haversine"}}),
    ):
        with pytest.raises(error):
            model.fit_transform(f, **kw)
    with pytest.raises(NotImplementedError):
        M.FTSNE(perplexity=5, method="barnes_hut").fit_transform(f, union={("o", "d"): 0})
    with pytest.raises(ValueError):
        M.FTSNE(perplexity=5, max_flows=10).fit_transform(f, identity={"o": 0})


def test_divergences():
    p = np.array([[0.0, 0.5], [0.5, 0.0]])
    assert M.kl_divergence(p, np.maximum(p, 1e-12)) == pytest.approx(0, abs=1e-9)
    assert M.hd_distance(p, p) == 0
    assert M.kl_divergence(np.array([0.5]), np.array([0.25])) == pytest.approx(math.log(2))


def test_tiles_are_computed_without_a_join_or_stored_copies(spark, monkeypatch):
    x = np.random.RandomState(2).randn(300, 4)
    f = FlowFrame(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], SCHEMA))
    monkeypatch.setattr(M, "STRIP_CELLS", 30_000)
    for options, kind, attrs in (({}, "identity", ("o",)), ({"method": "barnes_hut"}, "identity", ("o",)), ({}, "union", ("o", "d")), ({}, "intersection", ("o", "d"))):
        for relation in ("probability", "distance"):
            model = M.FTSNE(perplexity=5, **options)
            ids, values = model._values(f, set(attrs))
            tiles = model._tiles(f.spark, values, (kind, attrs, (0,)), {}, relation, len(x))
            plan = tiles._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan and "Existing" not in plan
            got = np.zeros((len(x), len(x)))
            for r in M.tiles_to_pairs(tiles, ids).collect():
                got[r["i"], r["j"]] = r["p"]
            own, each = np.arange(len(x)), [M.sq_distances(x[:, c], x[:, c]) for c in ([0, 1], [2, 3])[: len(attrs)]]
            if len(attrs) > 1 and relation == "probability":
                scaled = [sq / M.conditional_p(sq, own, 5)[1][:, None] for sq in each]
                whole = np.exp(-0.5 * sum(scaled))
                p = whole if kind == "intersection" else sum(np.exp(-0.5 * s) for s in scaled) - whole
                np.fill_diagonal(p, 0.0)
                p /= np.maximum(p.sum(axis=1, keepdims=True), M.EPS)
            else:
                sq = np.maximum.reduce(each) if kind == "intersection" else np.minimum.reduce(each)
                if options:
                    far = sq + np.where(np.eye(len(x)) > 0, np.inf, 0)
                    sq = np.where(far <= np.sort(far, axis=1)[:, 15:16], sq, 1e300)
                p = M.conditional_p(sq, own, 5)[0]
            assert np.allclose(got, M.make_joint(p), atol=1e-12)


def test_given_sigmas_need_no_join_of_pairs(flows):
    f, x = flows
    for combination in ("intersection", "union"):
        out = M.multivariate_p(f, ("o", "d"), (0.5, 0.7), combination)
        assert not re.search(r"Join Inner, \(\(i#\d+L? = i#", out._jdf.queryExecution().optimizedPlan().toString())
        a, b = M.sq_distances(x[:, :2], x[:, :2]) / 1.0, M.sq_distances(x[:, 2:], x[:, 2:]) / 1.4
        k = np.exp(-a - b) if combination == "intersection" else np.exp(-a) + np.exp(-b) - np.exp(-a - b)
        np.fill_diagonal(k, 0.0)
        got = np.zeros_like(k)
        for r in out.collect():
            got[r["i"], r["j"]] = r["p"]
        assert np.allclose(got, M.make_joint(k / k.sum(axis=1, keepdims=True)))


def test_line_sums_equal_all_differences():
    rng = np.random.RandomState(3)
    for scale in (1e-4, 0.2, 3.0, 40.0):
        y = np.concatenate([rng.randn(200), [0.0, 0.0]]) * scale
        d = y[:, None] - y[None, :]
        for got, kernel in zip(M.line_sums(y, M.KERNELS), M.KERNELS, strict=True):
            want = kernel(d).sum(axis=1)
            assert np.allclose(got, want, rtol=1e-10, atol=1e-11 * np.abs(kernel(d)).max() * len(y))
    assert M.line_sums(np.array([0.0, 1e9]), M.KERNELS) is None


@pytest.mark.parametrize("options", [{}, {"method": "barnes_hut"}])
def test_near_flows_and_lines_equal_the_dense_matrix(spark, monkeypatch, options):
    x = np.random.RandomState(4).randn(400, 4)
    x[:40] = x[0]  # copies: more than the perplexity
    f = FlowFrame(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], SCHEMA))
    monkeypatch.setattr(M, "STRIP_CELLS", 30_000)
    model = M.FTSNE(perplexity=5, **options)
    _, values = model._values(f, {"o", "d"})
    rows = [model._rows(spark, values, ("identity", (a,), (k,)), {}, "probability", len(x)) for k, a in enumerate("od")]
    near = M.near_table(spark, rows)
    for scale, exaggeration in ((1e-4, 12.0), (2.0, 1.0)):
        y = np.random.RandomState(5).randn(len(x), 2) * scale
        for k, (g, value) in enumerate(M.line_gradients(near, [y[:, 0], y[:, 1]], exaggeration)):
            want, loss = M.gradient(M.joint_tiles(spark, rows[k]), y[:, [k]], exaggeration)
            assert np.allclose(g, want[:, 0], rtol=1e-9, atol=1e-9 * np.abs(want).max()) and value == pytest.approx(loss, rel=1e-9)
    if not options:
        own = np.arange(len(x))
        p = M.conditional_p(M.sq_distances(x[:, :2], x[:, :2]), own, 5)[0]
        tiles = M.joint_tiles(spark, rows[0])
        got = np.zeros((len(x), len(x)))
        for r in M.tiles_to_pairs(tiles, own.tolist()).collect():
            got[r["i"], r["j"]] = r["p"]
        assert np.allclose(got, M.make_joint(p), atol=1e-12)


def test_one_dimension_takes_no_tiles(flows, monkeypatch):
    f, _ = flows
    plain = M.FTSNE(perplexity=5, max_iter=12, random_state=0)
    with monkeypatch.context() as m:
        m.setattr(M, "line_gradients", lambda *a: None)
        want = plain.fit_transform(f, identity={"o": 0, "d": 1}) and plain.embedding_
    monkeypatch.setattr(M, "gradient", None)
    model = M.FTSNE(perplexity=5, max_iter=12, random_state=0)
    model.fit_transform(f, identity={"o": 0, "d": 1})
    assert np.allclose(model.embedding_, want, rtol=1e-7, atol=1e-12) and np.allclose(model.losses_, plain.losses_)


def test_query_runs_all_iterations(spark, monkeypatch):
    from flowloom import catalog

    made = []
    monkeypatch.setattr(M.FTSNE, "fit_transform", lambda self, *a, **b: made.append(self))
    catalog.QUERIES["ftsne"](spark, "/root/testdata/sf0.001")
    assert made[0].max_iter == M.FTSNE().max_iter == 100


def test_near_columns_are_all_that_matter(monkeypatch):
    monkeypatch.setattr(M, "FIT_AMONG", 2)
    x = np.random.RandomState(8).randn(3_000, 2)
    x[:150], x[-1] = x[0], 40.0  # copies, and a flow far from all
    rows, n = M.Rows([x], ["euclidean"], "probability", "identity"), len(x)
    order = rows.order(50)
    assert sorted(order) == list(range(n))
    strips = [order[k : k + 50] for k in range(0, n, 50)]
    fits = np.concatenate([rows.fit(s, 5.0, None) for s in strips], axis=1)
    fits[:, order] = fits.copy()
    sq = M.sq_distances(x, x)
    for got, want in zip(fits, M.fit_rows(sq, np.arange(n), 5.0)[2:5], strict=False):
        assert np.allclose(got, want, rtol=1e-9)
    p = M.make_joint(M.conditional_p(sq, np.arange(n), 5.0)[0])
    rows.fits = list(fits)
    got = np.full((n, n), 1e-10)
    for s in strips:
        a, j, value = rows.above(s, 1e-10)
        got[s[a], j] = value
    np.fill_diagonal(got, 0.0)
    assert np.allclose(got, p, rtol=1e-6, atol=1e-15)
