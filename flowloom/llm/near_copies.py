"""Groups of texts whose five-word shingle sets have a Jaccard coefficient of 0.8 or more.

SimHash groups and shared shingles give candidates; every link is confirmed on the
whole sets. No pair over the threshold is missed: in any common order of shingles
the first size - ceil(0.8 * size) + 1 of both sets have one in common, so texts meet
at each of these. Shingles that are common in a sample come last in the order, which
costs no pair. Texts are first compared with one hub of each meeting; then, at some of
the meetings, enough pairs are taken to span what may be alike; then all texts that meet
and still aren't in one component are compared, in blocks, inside the tasks that hold
them. The last step makes the result whole, the ones before leave it little to do.

Before whole texts move, a pair is tried on sketches: whether the number of a set's
shingles is odd, for each of 4096 classes of their hashes. The classes in which two
sketches differ are at most as many as the shingles that the sets don't share, so a
pair that fails is not alike, and no pair is lost.

Defined results: a text is its xxHash64, so equal texts are one node. A text of fewer
than five words is one shingle; texts without words are one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import KeyFilter, Scratch, split_columns, text_or_empty
from .components import connected_components

SHINGLE_WORDS = 5
#: Texts that the order of shingles is taken from, and the rows and the number of shingles that come last.
SAMPLE_ROWS = 10_000
COMMON_ROWS = 2
MAX_COMMON = 200_000
#: Logarithm of the classes of a sketch.
SKETCH_BITS = 12
#: Texts of one block at a crowded meeting.
BLOCK_ROWS = 2048
#: One of so many meetings takes part in the spanning step.
SPANNING_SHARE = 8
#: Nodes that a task remembers, so that a text of many rows is entered once by each task.
SEEN_NODES = 1_000_000


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    runs = (b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1))
    return np.unique(np.fromiter(map(xxh64_intdigest, runs), np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard coefficient of 0.8 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    """For each class of hashes, whether an odd number of shingles is in it."""
    return np.packbits(np.bincount((own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS) & 1).tobytes()


def maybe_alike(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False only where sizes and sketches (rows of a and b) rule 0.8 out: alike sets differ in (n_a + n_b) / 9 shingles at most."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)) & (9 * apart <= n_a + n_b)


def sketches(column) -> np.ndarray:
    """Matrix of an Arrow column of sketches, 64 classes a word."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 1 << SKETCH_BITS - 6)


def node_of(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that many sampled texts hold, the most common last."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for (part,) in split_columns(batch, ["t"]):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in part]).view(np.int64))], names=["s"])

    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    counts = texts.select("t").sample(share, 42).mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= COMMON_ROWS)
    top = counts.orderBy(F.desc("count"), "s").limit(MAX_COMMON).collect()
    return np.array([r["s"] for r in reversed(top)], np.int64).view(np.uint64)


def entries(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(s, node): the shingles that a text is met by; and one row (null, node, n, sketch) with its number of shingles."""
    order = np.argsort(common)
    known = common[order]

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for ids, part in split_columns(batch, ["node", "t"]):
                if len(seen) > SEEN_NODES:
                    seen.clear()
                met, whole = [], []
                for node, t in zip(ids, part, strict=True):
                    if node in seen:
                        continue
                    seen.add(node)
                    own = shingles(t)
                    n = len(own)
                    if not n:
                        continue
                    whole.append((node, n, sketch(own)))
                    if len(known):
                        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        rank = np.where(known[place] == own, order[place] + 1, 0)
                        own = own[np.argsort(rank, kind="stable")]
                    met.append(own[: n - -(-4 * n // 5) + 1].view(np.int64))
                if not whole:
                    continue
                nodes, sizes, marks = zip(*whole, strict=True)
                s = np.concatenate(met)
                at = np.repeat(np.array(nodes, np.int64), [len(m) for m in met])
                k, m = len(nodes), len(s)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["s", "node", "n", "sketch"]
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(at), *(pa.nulls(m, kind) for kind in kinds[2:])], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, kinds[0]), *(pa.array(x, kind) for x, kind in zip((nodes, sizes, marks), kinds[1:], strict=True))], names=names)

    return texts.mapInArrow(run, "s long, node long, n long, sketch binary")


def meetings(met: DataFrame) -> DataFrame:
    """(s, node, hub) where two texts or more meet, each text once; the hub is the smallest node.

    Tasks read rows in the order of (s, node) and remember the last one only.
    """

    def run(batches):
        import pyarrow as pa

        last_s = last_node = hub = None
        told = False  # whether the hub's own row is out
        for batch in batches:
            s, node = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(s):
                continue
            fresh = np.r_[last_s is None or s[0] != last_s, s[1:] != s[:-1]]
            again = ~fresh & np.r_[node[0] == last_node, node[1:] == node[:-1]]
            s, node, fresh = s[~again], node[~again], fresh[~again]
            last_s, last_node = (int(s[-1]), int(node[-1])) if len(s) else (last_s, last_node)
            if not len(s):
                continue
            begins = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            hubs = np.where(group >= 0, node[begins[np.maximum(group, 0)]] if len(begins) else 0, hub or 0)
            keep = ~fresh
            keep[begins] = np.r_[fresh, True][begins + 1] == 0  # a hub that the next row joins
            out = [s[keep], node[keep], hubs[keep]]
            if not told and not fresh[0]:
                out = [np.r_[first, x] for first, x in zip((s[0], hub, hub), out, strict=True)]
            if len(begins):
                hub, told = int(node[begins[-1]]), bool(begins[-1] < len(s) - 1)
            else:
                told = True
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["s", "node", "hub"])

    return met.select("s", "node").repartition("s").sortWithinPartitions("s", "node").mapInArrow(run, "s long, node long, hub long")


def tried(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), each once, that sizes and sketches don't rule out. Texts without words have no sketch; they stay."""
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}")), x)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_a", "n_b"))
                k_a, k_b = (sketches(batch.column(batch.schema.get_field_index(c))) for c in ("k_a", "k_b"))
                yield batch.select(["a", "b"]).filter(pa.array(maybe_alike(n_a, k_a, n_b, k_b)))

    return pairs.mapInArrow(run, "a long, b long")


def crossing(met: DataFrame, groups: DataFrame, nodes: DataFrame, scratch: Scratch, spanning: bool = False) -> DataFrame:
    """Pairs (a, b) that meet and aren't in one component, but for those that sizes and sketches rule out.

    Meetings of many texts are split into pairs of blocks; a task compares what one block pair holds.
    spanning: of each block pair only a forest that connects what all its pairs would.
    """
    named = scratch.table(met.select("s", "node").join(groups, "node", "left").select("s", "node", F.coalesce("component", "node").alias("c")))
    apart = scratch.table(named.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("s", "size"))
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    rows = named.join(apart, "s").join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = rows.select("s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c", "n", "sketch")

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            keys = [table.column(c).to_numpy() for c in ("s", "i", "j")]
            border = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            yield from _crossing(table, border, spanning)
            held = table.slice(border[-1])
        if held is not None:
            yield from _crossing(held, np.array([0, held.num_rows]), spanning)

    dealt = cells.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _crossing(table, border: np.ndarray, spanning: bool):
    """Pairs of the cells between the borders."""
    import pyarrow as pa

    if len(border) < 2:
        return
    node, c, n, i, j, block = (table.column(x).to_numpy() for x in ("node", "c", "n", "i", "j", "block"))
    marks = sketches(table.column("sketch"))
    c = c.copy()
    found: list[np.ndarray] = []
    for begin, end in zip(border[:-1], border[1:], strict=True):
        within = i[begin] == j[begin]
        for row in range(begin, end - 1):
            rest = np.arange(row + 1, end)
            rest = rest[(c[rest] != c[row]) & (within | (block[rest] != block[row]))]
            rest = rest[maybe_alike(n[row], marks[row], n[rest], marks[rest])]
            if spanning and len(rest):
                rest = rest[np.unique(c[rest], return_index=True)[1]]
                c[begin:end][np.isin(c[begin:end], c[rest])] = c[row]
            if len(rest):
                found.append(np.stack([np.full(len(rest), node[row]), node[rest]]))
    if found:
        a, b = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are alike. Only texts of the pairs are shuffled."""
    pairs = scratch.table(pairs)
    needed = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    keys = KeyFilter.of(needed, "node")

    def wanted(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(keys.test(batch.column(0).to_numpy())))

    found = texts.select("node", "t").mapInArrow(wanted, "node long, t string").join(needed, "node", "left_semi")
    own = scratch.table(found.groupBy("node").agg(F.first("t").alias("t")))
    met = pairs.join(own.select(F.col("node").alias("a"), F.col("t").alias("t_a")), "a").join(own.select(F.col("node").alias("b"), F.col("t").alias("t_b")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, t_a, t_b in split_columns(batch, ["a", "b", "t_a", "t_b"]):
                sets: dict[int, np.ndarray] = {}
                for node, t in zip((*a, *b), (*t_a, *t_b), strict=True):
                    if node not in sets:
                        sets[node] = shingles(t)
                keep = [alike(sets[x], sets[y]) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    return scratch.table(met.mapInArrow(run, "a long, b long"))


def near_copies(df: DataFrame, text: str = "text") -> DataFrame:
    """(node, component) for every node with near copies; see node_of() for a row's node."""
    scratch = Scratch(df.sparkSession, "near-copies")
    texts = df.select(node_of(text).alias("node"), text_or_empty(text).alias("t"))
    close = simhash.near_duplicates(texts, key="node", text="t").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    entered = scratch.table(entries(texts, common_shingles(texts)))
    nodes = scratch.table(entered.filter("s is null").groupBy("node").agg(F.max(F.struct("n", "sketch")).alias("x")).select("node", "x.*"))
    met = scratch.table(meetings(entered.filter("s is not null")))
    scratch.drop(entered)
    first = met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = confirmed(tried(close.unionByName(first), nodes), texts, scratch)
    groups = scratch.table(connected_components(links, scratch))
    for part, spanning in ((met.filter(F.pmod(F.xxhash64("s"), F.lit(SPANNING_SHARE)) == 0), True), (met, False)):
        more = confirmed(crossing(part, groups, nodes, scratch, spanning).distinct(), texts, scratch)
        if not more.isEmpty():
            links = scratch.table(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
            groups = scratch.table(connected_components(links, scratch))
    scratch.drop(met, nodes)
    return groups
