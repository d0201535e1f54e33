"""Clustering of flows: DBSCAN and K-medoids."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ID, FlowFrame, with_positions
from ..functions.flow import COORDINATES, EARTH_KM, combine, haversine_km, point_distance
from ..plans.lineage import cut
from .pairs import eps_pairs, pair_distance, sides

PLANAR_MODES = ("max", "sum", "min", "mean")


def smallest_reachable(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, root): the smallest node of each node's component. Labels spread along links and jump to their own label in turn."""
    labels = cut(nodes.select("i", F.col("i").alias("root")))
    links = cut(links.select("i", "j"))
    while True:
        near = links.join(labels.select(F.col("i").alias("j"), F.col("root").alias("r")), "j").groupBy("i").agg(F.min("r").alias("r"))
        spread = labels.join(near, "i", "left").select("i", "root", F.least("root", F.coalesce("r", "root")).alias("new"))
        jump = labels.select(F.col("i").alias("new"), F.col("root").alias("further"))
        moved = cut(spread.join(jump, "new").select("i", "root", F.least("new", "further").alias("new")))
        changed = moved.filter("new <> root").limit(1).count()
        labels = moved.select("i", F.col("new").alias("root"))
        if not changed:
            return labels


def dbscan(frame: FlowFrame, eps: float = 0.5, min_samples: int = 5, distance: str = "max") -> DataFrame:
    """(flow_id, label, core). A flow counts as its own neighbour; noise is -1.

    Clusters are numbered by their lowest core flow; a border flow takes the lowest-numbered
    cluster next to it. Distances are planar.
    """
    if distance not in PLANAR_MODES:
        raise ValueError(f"distance must be one of {PLANAR_MODES}")
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    # Equal flows are one point of a weight: they are neighbours, and core or not, together. A point's id is its lowest flow's.
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in COORDINATES])
    alone = F.when(~whole, F.col(ID))  # a flow without all coordinates equals no other
    flows = frame.df.select(ID, *COORDINATES, alone.alias("__alone"))
    points = cut(flows.groupBy(*COORDINATES, "__alone").agg(F.min(ID).alias("i"), F.count("*").alias("w")))
    weights = points.select("i", "w")
    pairs = cut(eps_pairs(FlowFrame(points.select(F.col("i").alias(ID), *COORDINATES), frame.crs), eps, distance).select("i", "j"))
    around = pairs.join(weights.select(F.col("i").alias("j"), "w"), "j").groupBy("i").agg(F.sum("w").alias("n"))
    core = cut(weights.join(around, "i", "left").filter(F.col("w") + F.coalesce("n", F.lit(0)) >= min_samples).select("i"))
    between = pairs.join(core, "i", "left_semi").join(core.withColumnRenamed("i", "j"), "j", "left_semi")
    roots = cut(smallest_reachable(between, core))
    numbers = with_positions(cut(roots.select("root").distinct().orderBy("root")).orderBy("root"), "label")
    cores = roots.join(numbers, "root").select("i", "label")
    border = pairs.join(core, "i", "left_anti").join(cores.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min("label").alias("label"))
    found = cores.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    labelled = points.join(found, "i", "left").select(*[F.col(c).alias("__" + c) for c in COORDINATES], F.col("__alone").alias("__same"), "label", "core")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("__" + c)) for c in COORDINATES], F.col("__alone").eqNullSafe(F.col("__same")))
    return flows.join(labelled, same).select(ID, F.coalesce("label", F.lit(-1)).cast("long").alias("label"), F.coalesce("core", F.lit(False)).alias("core"))


class DBSCANFlow:
    def __init__(self, eps: float = 0.5, min_samples: int = 5, distance: str = "max") -> None:
        if distance not in PLANAR_MODES:
            raise ValueError(f"distance must be one of {PLANAR_MODES}")
        self.eps, self.min_samples, self.distance = eps, min_samples, distance
        self.labels_: DataFrame | None = None

    def fit(self, frame: FlowFrame) -> DBSCANFlow:
        found = cut(dbscan(frame, self.eps, self.min_samples, self.distance))
        self.labels_ = found.select(ID, "label")
        self.core_sample_indices_ = found.filter("core").select(ID)
        self.n_clusters_ = found.filter("label >= 0").agg(F.countDistinct("label")).first()[0]
        return self

    def fit_predict(self, frame: FlowFrame) -> DataFrame:
        return self.fit(frame).labels_

    @property
    def n_clusters(self) -> int:
        if self.labels_ is None:
            raise ValueError("fit first")
        return self.n_clusters_


def assign(df: DataFrame, medoids: list[tuple[int, float, float, float, float]], distance: str = "max", geographic: bool = False) -> DataFrame:
    """(flow_id, label, dist) of the nearest of a few medoids, given as literals; ties go to the first."""
    measure = haversine_km if geographic else point_distance
    own = [F.col(c) for c in COORDINATES]
    each = []
    for label, m in enumerate(medoids):
        lits = [F.lit(float(v)) for v in m[1:]]
        each.append(F.struct(combine(measure(*own[:2], *lits[:2]), measure(*own[2:], *lits[2:]), distance).alias("dist"), F.lit(label).cast("long").alias("label")))
    return df.select(ID, *COORDINATES, F.array_min(F.array(*each)).alias("near")).select(ID, *COORDINATES, "near.label", "near.dist")


def inertia(assigned: DataFrame) -> float:
    return assigned.agg(F.sum("dist")).first()[0] or 0.0


def _point_distances(a: np.ndarray, b: np.ndarray, geographic: bool) -> np.ndarray:
    if not geographic:
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    (lon1, lat1), (lon2, lat2) = np.radians(a.T[:, :, None]), np.radians(b.T[:, None, :])
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


class KMedoidFlow:
    """K-medoids with D^2 seeding.

    The update samples up to medoid_sample_size flows of a cluster and keeps the one with
    the least summed distance: to the flows outside of the cluster by default
    (update='outside', the parity rule), or to those inside (update='within', the textbook
    rule). All flows in one cluster keep the lowest id. The driver holds medoids and samples
    alone, never all flows.

    metric: 'euclidean', or 'haversine' for km on the sphere, at every size. None is the
    parity rule: on a geographic CRS km with method 'precompute', and with 'auto' up to
    5,000 flows; plain degrees otherwise.
    """

    def __init__(self, n_clusters: int = 5, distance: str = "max", method: str = "auto", medoid_sample_size: int = 100, max_iter: int = 100, n_init: int = 10, random_state: int | None = None, update: str = "outside", metric: str | None = None) -> None:
        if distance not in PLANAR_MODES:
            raise ValueError(f"distance must be one of {PLANAR_MODES}")
        if method not in ("auto", "precompute", "online"):
            raise ValueError("method must be auto, precompute or online")
        if update not in ("outside", "within"):
            raise ValueError("update must be outside or within")
        if metric not in (None, "euclidean", "haversine"):
            raise ValueError("metric must be euclidean or haversine")
        self.n_clusters, self.distance, self.method, self.update = n_clusters, distance, method, update
        self.medoid_sample_size, self.max_iter, self.n_init, self.random_state = medoid_sample_size, max_iter, n_init, random_state
        self.metric = metric
        self.labels_: DataFrame | None = None

    def fit(self, frame: FlowFrame) -> KMedoidFlow:
        from ..functions.crs import is_geographic

        df = cut(frame.df.select(ID, *COORDINATES))
        n = df.count()
        if not 1 <= self.n_clusters <= n:
            raise ValueError(f"{self.n_clusters} clusters of {n} flows")
        if self.metric == "haversine" and not is_geographic(frame.crs):
            raise ValueError("haversine needs geographic points")
        parity = is_geographic(frame.crs) and (self.method == "precompute" or self.method == "auto" and n <= 5000)
        self._geographic = parity if self.metric is None else self.metric == "haversine"
        rng = np.random.RandomState(self.random_state)
        best = None
        for _ in range(self.n_init):
            medoids = self._seed(df, n, rng)
            for _ in range(self.max_iter):
                labelled = assign(df, medoids, self.distance, self._geographic)
                before, medoids = medoids, self._updated(labelled, medoids, n, rng)
                if [m[0] for m in medoids] == [m[0] for m in before]:
                    break
            total = inertia(labelled)
            if best is None or total < best[0]:
                best = total, medoids, labelled
        self.inertia_, self.medoids_, labelled = best
        self.labels_ = labelled.select(ID, "label")
        return self

    def _pick(self, df: DataFrame, rng, weight=None, count: int = 1) -> list[tuple]:
        """Random flows, with chances in proportion to a weight: the least of exponential draws that a hash of ids makes."""
        salt = int(rng.randint(1 << 31))
        u = (F.pmod(F.xxhash64(ID, F.lit(salt)), F.lit(1 << 52)).cast("double") + 1) / F.lit(float((1 << 52) + 2))
        draw = -F.log(u) if weight is None else F.when(weight > 0, -F.log(u) / weight)
        rows = df.withColumn("__draw", draw).filter("__draw is not null").orderBy("__draw", ID).limit(count).select(ID, *COORDINATES).collect()
        return [tuple(r) for r in rows]

    def _seed(self, df: DataFrame, n: int, rng) -> list[tuple]:
        medoids = self._pick(df, rng)
        while len(medoids) < self.n_clusters:
            near = assign(df, medoids, self.distance, self._geographic)
            more = self._pick(near, rng, F.col("dist") * F.col("dist"))
            if not more:
                raise ValueError("fewer different flows than clusters")
            medoids += more
        return medoids

    def _updated(self, labelled: DataFrame, medoids: list[tuple], n: int, rng) -> list[tuple]:
        """One job draws candidates, a second sums their distances; each task returns one number per candidate."""
        salt = int(rng.randint(1 << 31))
        order = Window.partitionBy("label").orderBy(F.xxhash64(ID, F.lit(salt)), ID)
        drawn = labelled.select(ID, *COORDINATES, "label", F.row_number().over(order).alias("__r")).filter(F.col("__r") <= self.medoid_sample_size)
        rows = sorted((r["label"], r[ID], *(r[c] for c in COORDINATES)) for r in drawn.collect())
        labels = np.array([r[0] for r in rows])
        points = np.array([r[2:] for r in rows], np.float64)
        if len(set(labels)) == 1 and self.n_clusters > 1:
            lowest = tuple(labelled.orderBy(ID).select(ID, *COORDINATES).first())
            return [lowest if label == labels[0] else self._pick(labelled, rng)[0] for label in range(self.n_clusters)]
        totals = self._sums(labelled, labels, points)
        out = []
        for label in range(self.n_clusters):
            own = np.flatnonzero(labels == label)
            out.append(rows[own[np.argmin(totals[own])]][1:] if len(own) else self._pick(labelled, rng)[0])
        return out

    def _sums(self, labelled: DataFrame, labels: np.ndarray, points: np.ndarray) -> np.ndarray:
        geographic, within, mode = self._geographic, self.update == "within" or self.n_clusters == 1, self.distance

        def run(batches):
            import pandas as pd

            total = np.zeros(len(labels))
            for pdf in batches:
                for at in range(0, len(pdf), 2048):
                    part = pdf.iloc[at : at + 2048]
                    x = part[list(COORDINATES)].to_numpy()
                    ends = [_point_distances(x[:, i : i + 2], points[:, i : i + 2], geographic) for i in (0, 2)]
                    dist = {"max": np.maximum, "min": np.minimum, "sum": np.add, "mean": lambda a, b: (a + b) / 2}[mode](*ends)
                    same = part["label"].to_numpy()[:, None] == labels[None, :]
                    total += np.where(same if within else ~same, dist, 0.0).sum(axis=0)
            yield pd.DataFrame({"k": np.arange(len(labels)), "total": total})

        sums = labelled.select(*COORDINATES, "label").mapInPandas(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total"))
        return np.array([r["total"] for r in sums.orderBy("k").collect()])

    def fit_predict(self, frame: FlowFrame) -> DataFrame:
        return self.fit(frame).labels_

    def predict(self, frame: FlowFrame | None = None) -> DataFrame:
        """Labels of the fit, or of other flows by their nearest medoid."""
        if self.labels_ is None:
            raise ValueError("fit first")
        if frame is None:
            return self.labels_
        return assign(frame.df, self.medoids_, self.distance, self._geographic).select(ID, "label")


def kmedoid(frame: FlowFrame, **options) -> DataFrame:
    return KMedoidFlow(**options).fit_predict(frame)


__all__ = ["DBSCANFlow", "KMedoidFlow", "assign", "dbscan", "inertia", "kmedoid", "pair_distance", "sides", "smallest_reachable"]
