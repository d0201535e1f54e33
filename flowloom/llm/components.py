"""Connected components of a link table, by alternating large and small stars.

Every round is a handful of joins and partial aggregates; nothing is gathered on
the driver but the counts that tell when a round has changed nothing. The small side
of each join is written first, so that Spark can split the star of a hot hub. Links that
are known to be few (SMALL_LINKS, 16 MB) are joined in one task instead, with the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links up to which one task joins them.
SMALL_LINKS = 1_000_000


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of links (a, b), component being its smallest node.

    Nulls and self-links are left out. An empty table gives an empty table.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    stars = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(stars)
    if 0 < state[0] <= SMALL_LINKS:
        return scratch.table(stars.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
    while state[0]:
        large = scratch.table(_large_star(stars, scratch))
        small = scratch.table(_small_star(large, scratch))
        scratch.drop(stars, large)
        stars, before, state = small, state, _state(small)
        if state == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _in_one_task(batches):
    import pyarrow as pa

    table = pa.Table.from_batches(list(batches))
    links = np.stack([table.column(c).to_numpy() for c in ("u", "v")])
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, side, least)
            np.minimum.at(label, before[side], least)  # the node that a side was labelled by
        label = label[label]
        if (label == before).all():
            break
    for at in range(0, len(nodes), 65536):
        part = slice(at, at + 65536)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["node", "component"])


def _state(stars: DataFrame) -> tuple[int, int | None]:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them."""
    least = scratch.table(stars.groupBy("u").agg(F.min("v").alias("m")))
    moved = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()
