"""Flow t-SNE: embeddings whose dimensions follow chosen attributes of flows.

Each mapping (one attribute, or several by intersection or union) has a joint
probability matrix of square tiles. A first job fits each row (its precision, shift and
sum); tiles are then computed from the two flows' rows where they are used and are never
stored, joined or gathered. An iteration is one Spark job over the tiles with the current
embedding; tasks return sums per block of rows. Attribute values, rows' fits and the
embedding (n x a few doubles) go to every task, so n is checked against max_flows.

A mapping to one dimension with one distance needs no tiles: its joint probabilities are
the floor eps but for near flows, which are written once. An iteration reads those alone;
what all pairs have in common (the floor's pull, the push, the normaliser) is a sum of
smooth kernels along a line, taken through Chebyshev nodes to about 13 digits.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ID, FlowFrame
from ..functions import crs as crs_functions
from ..functions.flow import EARTH_KM, angle, length
from ..plans.lineage import cut

TILE = 256
#: Distances that are held at once while rows are fitted.
STRIP_CELLS = 1_000_000
#: Rows are fitted on this many nearest flows a unit of perplexity, if the rest are sure not to matter.
FIT_NEAREST = 24
#: These are sought among so many times as many flows, those nearest to a strip of rows.
FIT_AMONG = 8
#: Chebyshev nodes of a box of a line, and the most boxes; kernels have poles at a distance of a box's greatest width.
NODES = 24
MOST_BOXES = 2_048
EPS = float(np.finfo(np.float64).eps)
#: The gradient's factor: 4 of the derivation, times 4 as the parity rule has it.
GRADIENT_FACTOR = 16.0
TILES = "bi int, bj int, p binary"


# ---------------------------------------------------------------- kernels


def sq_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "haversine":
        lon1, lat1, lon2, lat2 = np.radians(a[:, None, 0]), np.radians(a[:, None, 1]), np.radians(b[None, :, 0]), np.radians(b[None, :, 1])
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
        return (2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))) ** 2
    if metric == "cityblock":
        return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2) ** 2
    out = np.zeros((len(a), len(b)))
    for x, z in zip(a.T, b.T, strict=True):
        each = x[:, None] - z[None, :]
        each *= each
        out += each
    return out


def fit_rows(sq: np.ndarray, own: np.ndarray, perplexity: float, steps: int = 100, tol: float = 1e-5, left_out: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities, and for each row sigma^2 = 1 / (2 beta), beta, shift and sum: p = exp(-(sq - shift) * beta) / sum. By bisection; own[r] is row r's own column.

    Last, is a row sure to be what it is with left_out more columns, none nearer than those
    here? Such columns only raise an entropy, and below the target they must be negligible.
    """
    rows = np.arange(len(sq))
    target = math.log(perplexity)
    beta, low, high = np.ones(len(sq)), np.full(len(sq), -np.inf), np.full(len(sq), np.inf)
    shifted = sq.copy()
    shifted[rows, own] = np.inf
    shift = shifted.min(axis=1)
    shifted -= shift[:, None]
    shifted[rows, own] = 0.0
    p, used, total = np.zeros_like(sq), beta, np.full(len(sq), EPS)
    edge, sure, negligible = shifted.max(axis=1), np.ones(len(sq), dtype=bool), np.ones(len(sq), dtype=bool)
    for _ in range(steps):
        used = beta
        p = np.exp(-shifted * beta[:, None])
        p[rows, own] = 0.0
        total = np.maximum(p.sum(axis=1), EPS)
        entropy = np.log(total) + beta * (shifted * p).sum(axis=1) / total
        p /= total[:, None]
        off = entropy - target
        negligible = left_out * np.exp(-edge * beta) * (1 + edge * beta) <= 1e-15 * total
        sure &= negligible | (off > tol)
        if (np.abs(off) <= tol).all():
            break
        up, down = off > tol, off < -tol
        low[up], high[down] = beta[up], beta[down]
        beta = np.where(up, np.where(np.isinf(high), beta * 2, (beta + high) / 2), np.where(down, np.where(np.isinf(low), beta / 2, (beta + low) / 2), beta))
    return p, 1 / (2 * beta), used, shift, total, sure & negligible


def conditional_p(sq: np.ndarray, own: np.ndarray, perplexity: float, steps: int = 100, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Rows of conditional probabilities and sigma^2 = 1 / (2 beta), by bisection. own[r] is row r's own column."""
    return fit_rows(sq, own, perplexity, steps, tol)[:2]


def inv_sd(y: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
    """Student-t kernel 1 / (1 + d^2)."""
    return 1 / (1 + sq_distances(y, y if z is None else z))


def d2q(y: np.ndarray) -> np.ndarray:
    w = inv_sd(y)
    np.fill_diagonal(w, 0.0)
    return np.maximum(w / w.sum(), EPS)


def kl_divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Square matrices: sum p log(p / q); condensed ones count twice."""
    each = np.maximum(p, EPS) * np.log(np.maximum(p, EPS) / np.maximum(q, EPS))
    return float(each.sum() * (2.0 if p.ndim == 1 else 1.0))


def hd_distance(p: np.ndarray, q: np.ndarray) -> float:
    return float(((np.sqrt(p) - np.sqrt(q)) ** 2).sum())


def make_joint(conditional: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    p = np.maximum((conditional + conditional.T) / (2 * len(conditional)), eps)
    np.fill_diagonal(p, 0.0)
    return p


class GDOptimizer:
    """y -= lr * g + momentum * (gradient before), g averaged over mappings."""

    def __init__(self, lr: float, momentum: float, lr_scheduler=None) -> None:
        self.lr, self.momentum, self.lr_scheduler, self.before = lr, momentum, lr_scheduler, 0.0

    def step(self, y: np.ndarray, gradients: list[np.ndarray], at: int = 0) -> np.ndarray:
        g = sum(gradients) / len(gradients)
        lr = self.lr_scheduler(self.lr, at) if self.lr_scheduler else self.lr
        y = y - (lr * g + self.momentum * self.before)
        self.before = g
        return y


# ---------------------------------------------------------------- tiles


@dataclass
class Rows:
    """A mapping's attribute values and metrics, and the fits of its rows, one array for each."""

    values: list[np.ndarray]
    metrics: list[str]
    relation: str
    combination: str
    fits: list[np.ndarray] = field(default_factory=list)

    @property
    def joined(self) -> bool:
        """Is there one distance, of which nearest neighbours and a perplexity are known?"""
        return len(self.values) == 1 or self.relation == "distance"

    def squares(self, rows: slice | np.ndarray, columns: slice | np.ndarray) -> list[np.ndarray]:
        each = [sq_distances(v[rows], v[columns], m) for v, m in zip(self.values, self.metrics, strict=True)]
        if len(each) > 1 and self.joined:
            each = [np.maximum.reduce(each) if self.combination == "intersection" else np.minimum.reduce(each)]
        return each

    @property
    def boxed(self) -> bool:
        """Do boxes around values bound their distances?"""
        return len(self.values) == 1 and self.metrics[0] == "euclidean"

    def order(self, step: int) -> np.ndarray:
        """All rows, strips of near ones beside each other: halves of the widest coordinate, again and again."""
        out = np.arange(len(self.values[0]))
        todo = [(0, len(out))] if self.boxed and np.isfinite(self.values[0]).all() else []
        while todo:
            first, last = todo.pop()
            own = out[first:last]
            half = -(-len(own) // step) // 2 * step
            if half:
                v = self.values[0][own]
                out[first:last] = own[np.argpartition(v[:, np.ptp(v, axis=0).argmax()], half)]
                todo += [(first, first + half), (first + half, last)]
        return out

    def gaps(self, rows: np.ndarray) -> np.ndarray:
        """Of all columns, a square that none of these rows' distances is below."""
        v, own = self.values[0], self.values[0][rows]
        return sum(np.maximum(np.maximum(low - x, x - high), 0.0) ** 2 for low, high, x in zip(own.min(axis=0), own.max(axis=0), v.T, strict=True))

    def combined(self, each: list[np.ndarray], sigma2: list[np.ndarray]) -> np.ndarray:
        scaled = [sq / s[:, None] for sq, s in zip(each, sigma2, strict=True)]
        whole = np.exp(-0.5 * sum(scaled))
        return whole if self.combination == "intersection" else sum(np.exp(-0.5 * s) for s in scaled) - whole

    def fit_near(self, rows: np.ndarray, perplexity: float) -> list[np.ndarray] | None:
        """fit() from the rows' nearest flows, on all flows where those aren't sure to do; None if there are few flows."""
        n, nearest, at = len(self.values[0]), math.ceil(FIT_NEAREST * perplexity), np.arange(len(rows))
        if nearest >= n // 2:
            return None
        columns, bound, own = slice(None), np.inf, rows
        among = FIT_AMONG * nearest + len(rows)
        if self.boxed and among < n:
            gaps = self.gaps(rows)
            by_gap = np.argpartition(gaps, among)
            place = np.full(n, -1)
            place[by_gap[:among]] = np.arange(among)
            if (place[rows] >= 0).all():
                columns, bound, own = by_gap[:among], gaps[by_gap[among]], place[rows]
        sq = self.squares(rows, columns)[0]
        sq[at, own] = np.inf
        near = np.concatenate([np.zeros((len(rows), 1)), np.partition(sq, nearest - 1, axis=1)[:, :nearest]], axis=1)
        *fits, sure = fit_rows(near, np.zeros(len(rows), dtype=int), perplexity, left_out=n - 1 - nearest)[2:]
        sure &= near.max(axis=1) <= bound
        if not sure.all():
            for f, whole in zip(fits, fit_rows(self.squares(rows[~sure], slice(None))[0], rows[~sure], perplexity)[2:5], strict=True):
                f[~sure] = whole
        return [*fits, np.full(len(rows), np.inf)]

    def fit(self, rows: np.ndarray, perplexity: float, neighbours: int | None) -> list[np.ndarray]:
        if self.joined and (neighbours is None or neighbours >= len(self.values[0]) - 1) and (near := self.fit_near(rows, perplexity)):
            return near
        each, at = self.squares(rows, slice(None)), np.arange(len(rows))
        if self.joined:
            sq, edge = each[0], np.full(len(rows), np.inf)
            if neighbours is not None and neighbours < sq.shape[1] - 1:
                held = sq.copy()
                held[at, rows] = np.inf
                edge = np.partition(held, neighbours - 1, axis=1)[:, neighbours - 1]
                sq = np.where(held <= edge[:, None], sq, 1e300)
            return [*fit_rows(sq, rows, perplexity)[2:5], edge]
        sigma2 = [fit_rows(sq, rows, perplexity)[1] for sq in each]
        p = self.combined(each, sigma2)
        p[at, rows] = 0.0
        return [*sigma2, np.maximum(p.sum(axis=1), EPS)]

    def conditional(self, each: list[np.ndarray], rows: slice) -> np.ndarray:
        """Conditional probabilities of fitted rows from their distances to any columns; not those of a row to itself."""
        own = [f[rows] for f in self.fits]
        if not self.joined:
            return self.combined(each, own[:-1]) / own[-1][:, None]
        beta, shift, total, edge = (f[:, None] for f in own)
        return np.where(each[0] <= edge, np.exp(-(each[0] - shift) * beta), 0.0) / total

    def joint(self, bi: int, bj: int, eps: float) -> np.ndarray:
        """max((P + P^T) / 2n, eps) of two blocks, with a zero diagonal."""
        n, a, b = len(self.values[0]), slice(bi * TILE, (bi + 1) * TILE), slice(bj * TILE, (bj + 1) * TILE)
        each = self.squares(a, b)
        with np.errstate(over="ignore"):  # a row's own column lies below its shift and is set to zero
            both = self.conditional(each, a) + self.conditional([sq.T for sq in each], b).T
        out = np.maximum(both / (2 * n), eps)
        if bi == bj:
            np.fill_diagonal(out, 0.0)
        return out

    def above(self, rows: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (of rows), column and value of the joint matrix's elements above its floor eps, if there is one distance."""
        n, (beta, shift, total, edge) = len(self.values[0]), self.fits
        # Beyond this square a row gives less than eps / 2 to the mean of both rows' probabilities.
        with np.errstate(divide="ignore"):
            reach = np.minimum(edge, (shift - np.log(n * eps * total) / beta) * (1 + 1e-9) + 1e-300)
        columns = np.arange(n)
        if self.boxed:
            columns = np.flatnonzero(~(self.gaps(rows) > np.maximum(reach[rows].max(), reach)))
        sq = self.squares(rows, columns)[0]
        a, j = np.nonzero(sq <= np.maximum(reach[rows, None], reach[None, columns]))
        i, j, sq = rows[a], columns[j], sq[a, j]
        a, i, j, sq = (x[i != j] for x in (a, i, j, sq))
        p = sum(np.where(sq <= edge[k], np.exp(-(sq - shift[k]) * beta[k]), 0.0) / total[k] for k in (i, j)) / (2 * n)
        return a[p > eps], j[p > eps], p[p > eps]


def fitted(spark, rows: Rows, perplexity: float, neighbours: int | None) -> Rows:
    """The same with its rows' fits, a few doubles each. Rows are fitted in strips of bounded size."""
    n = len(rows.values[0])
    step = max(1, min(TILE, STRIP_CELLS // n))
    strips = -(-n // step)
    order = rows.order(step)
    shared = spark.sparkContext.broadcast((rows, order))  # n rows of a few doubles, n checked by the caller

    def run(batches):
        import pandas as pd

        rows, order = shared.value
        for pdf in batches:
            for k in pdf["id"]:
                fits = rows.fit(order[k * step : (k + 1) * step], perplexity, neighbours)
                yield pd.DataFrame({"k": [k], "fits": [np.stack(fits).tobytes()]})

    got = spark.range(0, strips, 1, min(strips, max(2, spark.sparkContext.defaultParallelism))).mapInPandas(run, "k long, fits binary").collect()
    shared.unpersist()
    each = [np.frombuffer(r["fits"]).reshape(-1, min(n, (r["k"] + 1) * step) - r["k"] * step) for r in sorted(got, key=lambda r: r["k"])]
    fits = np.concatenate(each, axis=1)
    fits[:, order] = fits.copy()
    return Rows(rows.values, rows.metrics, rows.relation, rows.combination, list(fits))


def joint_tiles(spark, rows: Rows, eps: float = 1e-10) -> DataFrame:
    """(bi, bj, p): the joint matrix, each tile computed by the task that reads it."""
    blocks = -(-len(rows.values[0]) // TILE)
    shared = spark.sparkContext.broadcast(rows)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in pdf["id"]:
                bi, bj = divmod(int(at), blocks)
                yield pd.DataFrame({"bi": [bi], "bj": [bj], "p": [np.ascontiguousarray(shared.value.joint(bi, bj, eps)).tobytes()]})

    return spark.range(0, blocks * blocks, 1, min(blocks * blocks, max(2, spark.sparkContext.defaultParallelism))).mapInPandas(run, TILES)


def near_table(spark, mappings: list[Rows], eps: float = 1e-10) -> DataFrame:
    """(m, rows, counts, columns, p): what joint matrices have above their floor, in strips of rows, written once."""
    n = len(mappings[0].values[0])
    step = max(1, min(TILE, STRIP_CELLS // n))
    strips = -(-n // step)
    shared = spark.sparkContext.broadcast([(r, r.order(step)) for r in mappings])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for m, k in (divmod(int(x), strips) for x in pdf["id"]):
                mapping, order = shared.value[m]
                rows = order[k * step : (k + 1) * step]
                a, j, p = mapping.above(rows, eps)
                counts = np.bincount(a, minlength=len(rows))
                yield pd.DataFrame({"m": [m], "rows": [rows.astype(np.int32).tobytes()], "counts": [counts.astype(np.int64).tobytes()], "columns": [j.astype(np.int32).tobytes()], "p": [p.tobytes()]})

    tasks = min(len(mappings) * strips, max(2, 2 * spark.sparkContext.defaultParallelism))
    return cut(spark.range(0, len(mappings) * strips, 1, tasks).mapInPandas(run, "m int, rows binary, counts binary, columns binary, p binary"))


def line_sums(y: np.ndarray, kernels: list) -> list[np.ndarray] | None:
    """Each kernel's sum over the differences of a point to all, itself included; None if the line is too long.

    Kernels are smooth functions of a difference with poles at 1 from the real axis. Points
    give their weight to Chebyshev nodes of boxes of at most width 1; nodes meet by Fourier
    transforms over boxes. The error falls by 4.2 a node.
    """
    low, span = float(y.min()), float(np.ptp(y))
    if not span <= MOST_BOXES:
        return None
    boxes = max(1, math.ceil(span))
    width = span / boxes or 1.0
    at = (y - low) / width
    box = np.minimum(at.astype(int), boxes - 1)
    angles = (np.arange(NODES) + 0.5) * math.pi / NODES
    order = np.arange(NODES)
    weights = np.where(order > 0, 2.0, 1.0)[:, None] / NODES * np.cos(order[:, None] * angles[None, :])
    basis = np.cos(order[None, :] * np.arccos(np.clip(2 * (at - box) - 1, -1, 1))[:, None]) @ weights
    charges = np.stack([np.bincount(box, basis[:, k], boxes) for k in range(NODES)], axis=1)
    nodes = np.cos(angles) / 2
    steps = np.concatenate([np.arange(boxes), [0], np.arange(1 - boxes, 0)])  # around; the one between is not used
    differences = width * (steps[:, None, None] + nodes[None, :, None] - nodes[None, None, :])
    out = []
    for kernel in kernels:
        if boxes == 1:
            met = (kernel(differences[0]) @ charges[0])[None, :]
        else:
            spectrum = np.fft.rfft(kernel(differences), axis=0)
            met = np.fft.irfft(np.einsum("fab,fb->fa", spectrum, np.fft.rfft(charges, n=2 * boxes, axis=0)), n=2 * boxes, axis=0)[:boxes]
        out.append((basis * met[box]).sum(axis=1))
    return out


#: Of a difference: the weight, the pull of the floor, the push, the weight's logarithm.
KERNELS = [lambda d: 1 / (1 + d * d), lambda d: d / (1 + d * d), lambda d: d / (1 + d * d) ** 2, lambda d: -np.log1p(d * d)]


def line_gradients(near: DataFrame, ys: list[np.ndarray], exaggeration: float = 1.0, eps: float = 1e-10) -> list[tuple[np.ndarray, float]] | None:
    """gradient() with the kl loss of mappings to one dimension each, from near_table and the sums along their lines; None if a line is too long for those."""
    sums = [line_sums(y, KERNELS) for y in ys]
    if any(s is None for s in sums):
        return None
    n, floor = len(ys[0]), eps * exaggeration
    shared = near.sparkSession.sparkContext.broadcast(ys)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for m, rows, counts, columns, p in zip(pdf["m"], pdf["rows"], pdf["counts"], pdf["columns"], pdf["p"], strict=True):
                counts, y = np.frombuffer(counts, dtype=np.int64), shared.value[m]
                a = np.repeat(np.arange(len(counts)), counts)
                d, p = y[np.frombuffer(rows, dtype=np.int32)[a]] - y[np.frombuffer(columns, dtype=np.int32)], np.frombuffer(p) * exaggeration
                square = 1 + d * d
                pull = np.bincount(a, (p - floor) * d / square, len(counts))
                out.append((m, rows, pull.tobytes(), float((p * np.log(p)).sum() - len(p) * floor * math.log(floor) + ((p - floor) * np.log(square)).sum())))
            yield pd.DataFrame(out, columns=["m", "rows", "pull", "kl"])

    pulls, kls = [floor * s[1] for s in sums], [0.0] * len(ys)
    for row in near.mapInPandas(run, "m int, rows binary, pull binary, kl double").collect():  # n doubles a mapping
        pulls[row["m"]][np.frombuffer(row["rows"], dtype=np.int32)] += np.frombuffer(row["pull"])
        kls[row["m"]] += row["kl"]
    shared.unpersist()
    out = []
    for (weight, _, push, logs), pull, kl in zip(sums, pulls, kls, strict=True):
        z = float((weight - 1).sum())
        kl += n * (n - 1) * floor * math.log(floor) - floor * float(logs.sum())
        out.append((GRADIENT_FACTOR * (pull - exaggeration * push / z), kl + exaggeration * math.log(z)))
    return out


def tiles_to_pairs(tiles: DataFrame, ids: list[int]) -> DataFrame:
    """(i, j, p) of a tiled matrix."""
    n = len(ids)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for bi, bj, p in zip(pdf["bi"], pdf["bj"], pdf["p"], strict=True):
                a, b = ids[bi * TILE : (bi + 1) * TILE], ids[bj * TILE : (bj + 1) * TILE]
                yield pd.DataFrame({"i": np.repeat(a, len(b)), "j": np.tile(b, len(a)), "p": np.frombuffer(p)})

    assert n
    return tiles.mapInPandas(run, "i long, j long, p double")


def gradient(tiles: DataFrame, y: np.ndarray, exaggeration: float = 1.0, loss: str = "kl") -> tuple[np.ndarray, float]:
    """Gradient and loss of one mapping at an embedding; tasks sum over their tiles' columns."""
    n, d = y.shape
    shared = tiles.sparkSession.sparkContext.broadcast(y)

    def run(batches):
        import pandas as pd

        sums: dict[int, np.ndarray] = {}
        z = t = kl = 0.0
        for pdf in batches:
            y = shared.value
            for bi, bj, p in zip(pdf["bi"], pdf["bj"], pdf["p"], strict=True):
                a, b = y[bi * TILE : (bi + 1) * TILE], y[bj * TILE : (bj + 1) * TILE]
                p = np.frombuffer(p).reshape(len(a), len(b)) * exaggeration
                w = inv_sd(a, b)
                if bi == bj:
                    w[np.arange(len(a)), np.arange(len(a))] = 0.0
                pull = p * w if loss == "kl" else np.sqrt(p * w) * w
                push = w * w
                part = np.concatenate([pull.sum(axis=1)[:, None] * a - pull @ b, push.sum(axis=1)[:, None] * a - push @ b], axis=1)
                sums[bi] = sums[bi] + part if bi in sums else part
                z += w.sum()
                t += np.sqrt(p * w).sum()
                on = (p > 0) & (w > 0)
                kl += (p[on] * np.log(p[on] / w[on])).sum()
        yield pd.DataFrame({"bi": list(sums), "g": [s.tobytes() for s in sums.values()], "z": [z] + [0.0] * (len(sums) - 1), "t": [t] + [0.0] * (len(sums) - 1), "kl": [kl] + [0.0] * (len(sums) - 1)} if sums else {"bi": [], "g": [], "z": [], "t": [], "kl": []})

    pull, push, z, t, kl = np.zeros((n, d)), np.zeros((n, d)), 0.0, 0.0, 0.0
    for row in tiles.mapInPandas(run, "bi int, g binary, z double, t double, kl double").collect():  # n x 2d doubles a task
        at = slice(row["bi"] * TILE, (row["bi"] + 1) * TILE)
        part = np.frombuffer(row["g"]).reshape(-1, 2 * d)
        pull[at] += part[:, :d]
        push[at] += part[:, d:]
        z, t, kl = z + row["z"], t + row["t"], kl + row["kl"]
    shared.unpersist()
    if loss == "kl":
        return GRADIENT_FACTOR * (pull - exaggeration * push / z), kl + exaggeration * math.log(z)
    share = t / math.sqrt(z)
    return GRADIENT_FACTOR * (pull / math.sqrt(z) - share * push / z), exaggeration + 1 - 2 * share


# ---------------------------------------------------------------- estimator


@dataclass
class FTSNE:
    """identity maps an attribute to a dimension (or a tuple of them); intersection and union map tuples of attributes.

    Attributes: o, d, length, angle, or a numeric column. Dimensions are 0, 1, ... without
    gaps. method 'barnes_hut' keeps the nearest neighbours' probabilities only, with exact
    repulsion in blocks; it takes identity mappings alone.
    """

    perplexity: float = 30.0
    learning_rate: float | str = 0.1
    max_iter: int = 100
    early_exaggeration: float = 12.0
    early_exaggeration_iter: int | str = "auto"
    init: str | np.ndarray = "pca"
    method: str = "exact"
    random_state: int | None = None
    loss_func: str = "kl"
    metric: str = "euclidean"
    angle: float = 0.5
    max_flows: int = 200_000
    losses_: list[float] = field(default_factory=list)

    def _mappings(self, frame: FlowFrame, identity, intersection, union, metrics) -> list[tuple[str, tuple[str, ...], tuple[int, ...]]]:
        out = []
        for kind, given in (("identity", identity), ("intersection", intersection), ("union", union)):
            for attrs, dims in (given or {}).items():
                if kind != "identity" and not isinstance(attrs, tuple):
                    raise ValueError(f"{kind} maps tuples of attributes")
                out.append((kind, attrs if isinstance(attrs, tuple) else (attrs,), (dims,) if isinstance(dims, int) else tuple(dims)))
        if not out:
            raise ValueError("no mapping is given")
        known = {*frame.columns, "o", "d", "length", "angle"}
        unknown = {a for _, attrs, _ in out for a in attrs} - known
        if unknown:
            raise ValueError(f"no such attributes: {sorted(unknown)}")
        used = {d for _, _, dims in out for d in dims}
        if used != set(range(max(used) + 1)):
            raise ValueError(f"dimensions must be 0 to n without gaps, not {sorted(used)}")
        for a, m in (metrics or {}).items():
            if m not in ("euclidean", "sqeuclidean", "cityblock", "cosine", "haversine"):
                raise ValueError(f"unknown metric {m!r}")
            if m == "haversine" and (a not in ("o", "d") or not crs_functions.is_geographic(frame.crs)):
                raise ValueError("haversine needs geographic points")
        return out

    def _values(self, frame: FlowFrame, attrs: set[str]) -> tuple[list[int], dict[str, np.ndarray]]:
        exprs = {"o": ["ox", "oy"], "d": ["dx", "dy"], "length": [length()], "angle": [angle()]}
        columns = [(a, i, F.col(e) if isinstance(e, str) else e) for a in sorted(attrs) for i, e in enumerate(exprs.get(a, [a]))]
        pdf = frame.df.select(ID, *[e.cast("double").alias(f"{a}__{i}") for a, i, e in columns]).toPandas().sort_values(ID)
        return pdf[ID].tolist(), {a: pdf[[f"{b}__{i}" for b, i, _ in columns if b == a]].to_numpy() for a in attrs}

    def fit_transform(self, frame: FlowFrame, identity=None, intersection=None, union=None, metrics=None, relation: str = "probability") -> DataFrame:
        """(flow_id, e0, e1, ...)."""
        mappings = self._mappings(frame, identity, intersection, union, metrics)
        if relation not in ("probability", "distance"):
            raise ValueError("relation must be probability or distance")
        if self.method not in ("exact", "barnes_hut") or self.loss_func not in ("kl", "hd"):
            raise ValueError("unknown method or loss")
        if self.method == "barnes_hut" and any(k != "identity" for k, _, _ in mappings):
            raise NotImplementedError("barnes_hut takes identity mappings alone")
        loss = self.loss_func
        if self.method == "barnes_hut" and loss == "hd":
            warnings.warn("barnes_hut uses the kl loss", UserWarning, stacklevel=2)
            loss = "kl"
        n = frame.df.count()
        if n > self.max_flows:
            raise ValueError(f"{n} flows are more than max_flows={self.max_flows}")
        if not 1 <= self.perplexity < n:
            raise ValueError("perplexity must be at least 1 and less than the number of flows")
        ids, values = self._values(frame, {a for _, attrs, _ in mappings for a in attrs})
        rows = [self._rows(frame.spark, values, m, metrics or {}, relation, n) for m in mappings]
        tiles = [joint_tiles(frame.spark, r) for r in rows]
        lines = [k for k, (r, m) in enumerate(zip(rows, mappings, strict=True)) if loss == "kl" and r.joined and len(m[2]) == 1]
        near = near_table(frame.spark, [rows[k] for k in lines]) if lines else None
        dims = [list(m[2]) for m in mappings]
        y = self._start(values, mappings, n)
        self.losses_ = []
        lr = max(n / self.early_exaggeration / 4, 50.0) if self.learning_rate == "auto" else float(self.learning_rate)
        early = self.max_iter // 4 if self.early_exaggeration_iter == "auto" else int(self.early_exaggeration_iter)
        for steps, exaggeration, momentum in ((early, self.early_exaggeration, 0.5), (self.max_iter - early, 1.0, 0.8)):
            optimizer = GDOptimizer(lr, momentum)
            for at in range(steps):
                parts, total = [], 0.0
                along = line_gradients(near, [y[:, dims[k][0]] for k in lines], exaggeration) if lines else None
                known = {k: (g[:, None], value) for k, (g, value) in zip(lines, along, strict=True)} if along else {}
                for k, (t, d) in enumerate(zip(tiles, dims, strict=True)):
                    g, value = known[k] if k in known else gradient(t, y[:, d], exaggeration, loss)
                    full = np.zeros_like(y)
                    full[:, d] = g
                    parts.append(full)
                    total += value
                self.losses_.append(total)
                y = optimizer.step(y, parts, at)
        self.embedding_ = y
        rows = [(i, *map(float, v)) for i, v in zip(ids, y, strict=True)]
        return frame.spark.createDataFrame(rows, ", ".join([f"{ID} long", *(f"e{k} double" for k in range(y.shape[1]))]))

    def _tiles(self, spark, values, mapping, metrics, relation: str, n: int) -> DataFrame:
        return joint_tiles(spark, self._rows(spark, values, mapping, metrics, relation, n))

    def _rows(self, spark, values, mapping, metrics, relation: str, n: int) -> Rows:
        kind, attrs, _ = mapping
        own, names = [], []
        for a in attrs:
            v, m = values[a], metrics.get(a, self.metric)
            if m == "cosine" and v.shape[1] == 1:
                v, m = np.concatenate([np.cos(v), np.sin(v)], axis=1), "euclidean"
            own.append(v)
            names.append(m)
        if kind == "identity" and len(own) > 1:
            own, names = [np.concatenate(own, axis=1)], [self.metric]
        neighbours = min(n - 1, int(3 * self.perplexity + 1)) if self.method == "barnes_hut" else None
        return fitted(spark, Rows(own, names, relation, kind), self.perplexity, neighbours)

    def _start(self, values, mappings, n: int) -> np.ndarray:
        width = max(d for _, _, dims in mappings for d in dims) + 1
        rng = np.random.RandomState(self.random_state)
        y = 1e-4 * rng.randn(n, width)
        if isinstance(self.init, np.ndarray):
            if self.init.shape != y.shape:
                raise ValueError(f"init must have shape {y.shape}")
            return self.init.astype(float)
        if self.init == "pca":
            done: set[int] = set()
            for kind in ("identity", "intersection", "union"):
                for _, attrs, dims in (m for m in mappings if m[0] == kind):
                    x = np.concatenate([values[a] for a in attrs], axis=1)
                    spread = np.ptp(x, axis=0)
                    x = (x - x.min(axis=0)) / np.where(spread > 0, spread, 1.0)
                    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
                    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
                    for k, d in enumerate(d for d in dims if d not in done):
                        if k < len(s):
                            y[:, d] = 1e-4 * (u[:, k] * s[k] * sign[k]) / max(1e-12, (u[:, k] * s[k]).std())
                        done.add(d)
        elif self.init != "random":
            raise ValueError("init must be pca, random or an array")
        return y


# ---------------------------------------------------------------- probabilities for given sigmas


def multivariate_p(frame: FlowFrame, attributes: tuple[str, ...], sq_sigmas: tuple[float, ...], combination: str, eps: float = 1e-10) -> DataFrame:
    """(i, j, p) of all pairs, in DataFrame functions: joint probabilities of attributes with known sigma^2.

    intersection: exp(-sum D / 2 sigma^2); union: the sum of each, less the intersection.
    Rows are normalised, then made symmetric: max((P + P^T) / 2n, eps), zero from a flow to itself.
    """
    from .pairs import all_pairs

    if combination not in ("intersection", "union"):
        raise ValueError("combination must be intersection or union")
    sq = {
        "o": lambda: (F.col("a_ox") - F.col("b_ox")) ** 2 + (F.col("a_oy") - F.col("b_oy")) ** 2,
        "d": lambda: (F.col("a_dx") - F.col("b_dx")) ** 2 + (F.col("a_dy") - F.col("b_dy")) ** 2,
        "length": lambda: (length("a_") - length("b_")) ** 2,
        "angle": lambda: (angle("a_") - angle("b_")) ** 2,
    }
    n = frame.df.count()
    scaled = [sq[a]() / (2 * s) for a, s in zip(attributes, sq_sigmas, strict=True)]
    whole = F.exp(-sum(scaled[1:], scaled[0]))
    each = [F.exp(-s) for s in scaled]
    kernel = whole if combination == "intersection" else sum(each[1:], each[0]) - whole
    met = all_pairs(frame.df, n).filter("i <> j")
    sums = cut(met.select("i", kernel.alias("k")).groupBy("i").agg(F.sum("k").alias("s")))
    # The kernel is symmetric, so a pair needs the sums of both its flows only, and is not joined with its mirror.
    summed = frame.df.join(sums.select(F.col("i").alias(ID), F.col("s").alias("__sum")), ID)
    joint = all_pairs(summed, n, ("__sum",)).filter("i <> j").select("i", "j", F.greatest((kernel / F.col("a___sum") + kernel / F.col("b___sum")) / (2 * n), F.lit(eps)).alias("p"))
    return joint.unionByName(frame.df.select(F.col(ID).alias("i"), F.col(ID).alias("j"), F.lit(0.0).alias("p")))
