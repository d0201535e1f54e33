"""Statistics of all flows: entropy, direction, density, K and L functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ID, FlowFrame
from ..functions.flow import angle, guarded_division
from .pairs import COUNT_BLOCK_FLOWS, all_pairs, blocks_for, eps_pairs, k_neighbor_distances, meet, pair_distance, sides, tile_distances, tileable, tiles

TINY = 1e-10


def flow_entropy(frame: FlowFrame, cell_area: DataFrame | None = None) -> DataFrame:
    """One row (entropy) of n flows of equal probability 1/n.

    cell_area: a table (i, j, a) of all n x n areas gives Batty's spatial entropy.
    """
    n = frame.df.agg(F.count("*").cast("double").alias("n"))
    p = F.when(F.col("n") > 0, 1 / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    if cell_area is None:
        return n.select((-F.col("n") * p * F.log2(p + TINY)).alias("entropy"))
    total = cell_area.agg(F.sum("a").alias("total"))
    p = 1 / F.lit(float(max(1, n.first()["n"])))
    share = F.col("a") / (F.lit(float(total.first()["total"] or 0.0)) + TINY)
    return cell_area.agg((-F.sum(p * F.log2(p / (share + TINY) + TINY))).alias("entropy"))


def flow_divergence(frame: FlowFrame, n_directions: int = 6) -> DataFrame:
    """One row (divergence): entropy of directions in n_directions equal sectors; 0 without flows."""
    if n_directions < 2:
        raise ValueError("n_directions must be at least 2")
    frame.check_geographic("the direction")
    turned = F.pmod(angle(), F.lit(2 * math.pi))
    sector = F.floor(turned / F.lit(2 * math.pi / n_directions)) % n_directions
    counts = frame.df.groupBy(sector.alias("sector")).agg(F.count("*").alias("c"))
    share = F.transform(F.collect_list("c"), lambda c: c / F.sum("c"))  # at most n_directions counts
    return counts.agg(F.coalesce(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p + TINY)), F.lit(0.0)).alias("divergence"))


def second_order_density(frame: FlowFrame, distance: str = "max", k: int = 1, mask=None, pairs: DataFrame | None = None) -> DataFrame:
    """One row (density): m / (pi^2 * sum of the k-th nearest distances to the fourth power), over the m flows in the mask."""
    if distance != "max":
        raise NotImplementedError("the volume is known for distance='max' alone")
    near = k_neighbor_distances(frame, k, distance, pairs)
    if mask is not None:
        near = near.join(frame.clip(mask).df.select(ID), ID, "left_semi")
    volume = F.lit(math.pi**2) * F.sum(F.pow("dist", F.lit(4.0)))
    out = near.agg(F.count("*").cast("double").alias("m"), volume.alias("v"))
    return out.select(guarded_division(F.col("m"), F.coalesce("v", F.lit(0.0))).alias("density"))


def radius_steps(frame: FlowFrame, dr: float) -> int:
    """Steps of size dr up to the diagonal of the bounding box."""
    if dr <= 0:
        raise ValueError("dr must be positive")
    b = frame.total_bounds().first()
    return 0 if b["minx"] is None else int(math.hypot(b["maxx"] - b["minx"], b["maxy"] - b["miny"]) // dr)


def step_of(dist: Column, dr: float) -> Column:
    """The first step whose radius dr * step reaches a distance, by the exact comparison."""
    near = F.ceil(dist / dr).cast("long")
    below, own = dist <= F.lit(float(dr)) * (near - 1), dist <= F.lit(float(dr)) * near
    return F.greatest(F.when(below, near - 1).when(own, near).otherwise(near + 1), F.lit(1))


def tile_steps(left: DataFrame, right: DataFrame, n: int, dr: float, m: int, distance: str) -> DataFrame:
    """(step, c): all pairs counted by step_of, up to step m, a row for each tile and step at most."""
    dr = float(dr)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts = np.zeros(m + 2, np.int64)
            for _, _, d in tile_distances(batch, distance):
                near = np.ceil(d / dr)
                at = near - (d <= dr * (near - 1)) + (d > dr * near)
                at = np.fmin(np.maximum(at, 1, out=at), m + 1, out=at)  # NaN counts as beyond
                counts += np.bincount(at.astype(np.int64).reshape(-1), minlength=m + 2)
            steps = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(counts[steps])], names=["step", "c"])

    return tiles(left, right, n).mapInArrow(run, "step long, c long").filter(F.col("step") <= m)


def _curve(frame: FlowFrame, dr: float, k: int, distance: str, mask, pairs: DataFrame | None, r_max: float | None) -> tuple[DataFrame, float, int]:
    """(step, r, inside): pairs of a masked flow and any flow within r, each flow with itself included; density; masked flows.

    Pairs are counted by step in each task; at most one row per step moves. r_max allows
    grid cells instead of all pairs.
    """
    m = radius_steps(frame, dr) if r_max is None else int(r_max // dr)
    own = frame.clip(mask).df if mask is not None else frame.df
    n = own.count()
    if not n:
        raise ValueError("no flow lies within the mask")
    met = None
    if pairs is None and r_max is None and tileable(frame, distance):
        counts = tile_steps(own, frame.df, frame.df.count(), dr, m, distance).groupBy("step").agg(F.sum("c").alias("c"))
    elif pairs is None and r_max is not None:
        met = eps_pairs(frame, dr * m, distance).select("i", "dist")
        met = met.unionByName(frame.df.select(F.col(ID).alias("i"), F.lit(0.0).alias("dist")))
    elif pairs is None:
        left = own.select(F.col(ID).alias("i"), *(F.col(c).alias("a_" + c) for c in ("ox", "oy", "dx", "dy")))
        met = meet(left, sides(frame.df)[1], blocks_for(frame.df.count(), COUNT_BLOCK_FLOWS)).select("i", pair_distance(frame, distance).alias("dist"))
    else:
        met = pairs.select("i", "dist")
    if mask is not None and (pairs is not None or r_max is not None):
        met = met.join(own.select(F.col(ID).alias("i")), "i", "left_semi")
    if met is not None:
        counts = met.select(step_of(F.col("dist"), dr).alias("step")).filter(F.col("step") <= m).groupBy("step").agg(F.count("*").alias("c"))
    steps = frame.spark.range(1, m + 1).select(F.col("id").alias("step"))
    full = steps.join(counts, "step", "left")
    run = full.select("step", (F.lit(float(dr)) * F.col("step")).alias("r"), F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("step")).alias("inside"))
    density = second_order_density(frame, "max", k, mask, pairs).first()["density"]
    return run, density, n


def k_func(frame: FlowFrame, dr: float, k: int = 1, distance: str = "max", mask=None, pairs: DataFrame | None = None, r_max: float | None = None) -> DataFrame:
    """(step, r, k): pairs within r, none of a flow with itself, by flow and density."""
    run, density, n = _curve(frame, dr, k, distance, mask, pairs, r_max)
    return run.select("step", "r", ((F.col("inside") - n) / F.lit(n * density)).alias("k"))


def l_func(frame: FlowFrame, dr: float, k: int = 1, distance: str = "max", mask=None, pairs: DataFrame | None = None, r_max: float | None = None) -> DataFrame:
    """(step, r, l): (K' / pi^2)^(1/4) - r, where K' counts each flow with itself too."""
    run, density, n = _curve(frame, dr, k, distance, mask, pairs, r_max)
    return run.select("step", "r", (F.pow(F.col("inside") / F.lit(n * density) / F.lit(math.pi**2), F.lit(0.25)) - F.col("r")).alias("l"))


def local_l_func(frame: FlowFrame, r: float, distance: str = "max", pairs: DataFrame | None = None) -> DataFrame:
    """(flow_id, l) at one radius, each flow counting itself."""
    density = second_order_density(frame, "max", 1, None, pairs).first()["density"]
    met = eps_pairs(frame, r, distance).select("i") if pairs is None else pairs.filter((F.col("dist") <= r) & (F.col("i") != F.col("j"))).select("i")
    counts = met.groupBy("i").agg(F.count("*").alias("c"))
    ids = frame.df.select(ID)
    inside = F.coalesce(F.col("c"), F.lit(0)) + 1
    return ids.join(counts.withColumnRenamed("i", ID), ID, "left").select(ID, (F.pow(inside / F.lit(density * math.pi**2), F.lit(0.25)) - F.lit(float(r))).alias("l"))


def nth_largest(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, value) of the n-th largest value of each group; groups of fewer rows raise."""
    if n < 1:
        raise ValueError("n must be at least 1")
    short = df.groupBy(group).count().filter(F.col("count") < n).limit(1).count()
    if short:
        raise ValueError(f"a group has fewer than {n} values")
    order = Window.partitionBy(group).orderBy(F.col(value).desc())
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") == n).select(group, value)


__all__ = ["all_pairs", "flow_divergence", "flow_entropy", "k_func", "l_func", "local_l_func", "nth_largest", "radius_steps", "second_order_density", "step_of"]
