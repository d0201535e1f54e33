"""SimHash near-duplicates by anchor-point covering.

The 64 fingerprint bits form two halves; two fingerprints that differ in at most
three bits differ in at most one bit of some half. Anchors of a half are the
codewords of the perfect [31, 26] Hamming code on 31 of its bits: its covering
radius is 1, so each fingerprint has a home anchor within distance 1, and every
fingerprint within one bit of it lies within distance 1 + 1 of that anchor. Each
fingerprint is replicated to all anchors of each half within distance 2 (1 or 16
of them), and at each anchor those at home are compared with all.

Comparisons at one anchor return the links of a spanning forest, not all pairs:
components are whole and a group of n near copies gives no n^2 rows. Anchors
that hold many fingerprints are split into pairs of blocks.

Defined results: null and empty texts have fingerprint zero, linked like any
other. Rows with equal texts share a fingerprint, a row with a null id gets its
fingerprint's component. Repeated rows give repeated equal rows; extra input
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, split_columns, text_or_empty
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints of one block at a crowded anchor.
BLOCK_ROWS = 2048
#: Hashes whose bits are counted at once.
COUNT_AT_ONCE = 1 << 16
CODE_BITS = 31


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the XXH64 values of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - words_per_shingle + 1
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[words_per_shingle - 1 :], strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, COUNT_AT_ONCE):
        part = hashes[at : at + COUNT_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words_per_shingle: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp as a signed long of the same 64 bits."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, texts in split_columns(batch, [key, text]):
                fp = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return df.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(run, f"`{key}` {key_type}, fp long")


# Flips that take a word with a given syndrome to each codeword within distance 2 (the first: the home anchor).
def _flips() -> np.ndarray:
    """(32, 16) masks. Bit i has syndrome i + 1; for syndrome 0 all flips are 0."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        out[s, 0] = 1 << (s - 1)
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        out[s, 1:] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return out


FLIPS = _flips()


def syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for i in range(CODE_BITS):
        out ^= (words >> np.uint64(i) & np.uint64(1)) * np.uint64(i + 1)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every fingerprint at every anchor near it."""
    rows, keys, home = [], [], []
    for half in range(2):
        word = fp >> np.uint64(32 * half) & np.uint64((1 << CODE_BITS) - 1)
        syndrome = syndromes(word)
        near = word[:, None] ^ FLIPS[syndrome]
        keep = np.ones(near.shape, bool)
        keep[syndrome == 0, 1:] = False
        r, c = np.nonzero(keep)
        rows.append(r)
        keys.append(near[r, c] | np.uint64(half << CODE_BITS))
        home.append(c == 0)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(home)


def replicate(distinct: DataFrame) -> DataFrame:
    """(anchor, home, fp, rep) for each distinct fingerprint (fp, rep)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp, rep = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                row, anchor, home = anchors(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(fp[row]), pa.array(rep[row])], names=["anchor", "home", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "anchor long, home boolean, fp long, rep long")


def spanning_links(fp: np.ndarray, home: np.ndarray, rep: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a forest that spans what the comparisons of home rows with all rows connect."""
    label = np.arange(len(fp))
    out = []
    for i in np.flatnonzero(home):
        near = label[np.bitwise_count(fp ^ fp[i]) <= max_bits]
        for other in np.unique(near[near != label[i]]):
            out.append((int(rep[label[i]]), int(rep[other])))
            label[label == other] = label[i]
    return out


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): representatives linked so that the components are those of all pairs within max_bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with covering radius 1 reach 3 bits")
    copies = replicate(distinct)
    crowds = copies.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).filter("n > 1 and n_home > 0")
    crowds = Scratch(distinct.sparkSession, "simhash-crowds").table(crowds)  # so that the join can split hot anchors
    met = copies.join(crowds, "anchor")
    wide, high = (F.ceil(F.col(c) / BLOCK_ROWS).cast("int") for c in ("n_home", "n"))
    mixed = F.xxhash64("fp")
    # A home row meets every block of visitors, a visitor every block of home rows.
    as_home = met.filter("home").select("anchor", "fp", "rep", F.lit(True).alias("home"), F.pmod(mixed, wide).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), high - 1)).alias("j"))
    as_guest = met.select("anchor", "fp", "rep", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("i"), F.pmod(mixed, high).cast("int").alias("j"))
    cells = as_home.unionByName(as_guest).select(F.xxhash64("anchor", "i", "j").alias("cell"), "anchor", "i", "j", "fp", "rep", "home")

    def compare(batches):
        import pyarrow as pa

        held = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            cell = table.column("cell").to_numpy()
            border = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            yield from _compared(table, border[:-1], border[1:], max_bits)
            held = [table.slice(border[-1])]
        if held and held[0].num_rows:
            yield from _compared(held[0], np.array([0]), np.array([held[0].num_rows]), max_bits)

    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell", "anchor", "i", "j")
    return sorted_cells.mapInArrow(compare, "a long, b long")


def _compared(table, begins: np.ndarray, ends: np.ndarray, max_bits: int):
    import pyarrow as pa

    if not len(begins):
        return
    columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j", "fp", "rep", "home")}
    out = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b < 2:
            continue
        # cells whose hashes agree stay apart
        inner = np.flatnonzero(np.r_[True, np.any([columns[c][b + 1 : e] != columns[c][b : e - 1] for c in ("anchor", "i", "j")], axis=0), True]) + b
        for x, y in zip(inner[:-1], inner[1:], strict=True):
            home = columns["home"][x:y]
            if home.any() and not home.all():
                out += spanning_links(columns["fp"][x:y].view(np.uint64), home, columns["rep"][x:y], max_bits)
    if out:
        a, b = np.array(out, np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(df: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row; component_id is the smallest key reachable over links."""
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.table(fingerprints(df.withColumn(key, F.col(key).cast("long")), words_per_shingle, key, text))
    distinct = scratch.table(prints.groupBy("fp").agg(F.min(key).alias("rep")))
    found = scratch.table(links(distinct.filter("rep is not null"), max_bits).distinct())
    scratch.drop()
    groups = connected_components(found, scratch)
    named = distinct.join(groups, distinct["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(key, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
