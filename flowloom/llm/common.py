"""Shared plumbing of the training-data operators.

Nothing here is an operator: it holds the tables that cut lineage, the fixed
size filter that keeps unaffected rows out of a shuffle, and the word splitter.
"""

from __future__ import annotations

import atexit
import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_folder

#: Rows that a Python worker handles at once inside an Arrow batch.
SLICE_ROWS = 512
#: Environment of Python workers: few allocator arenas, the system's pool for Arrow, and freed memory returned.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Bytes of text that it handles at once where work is by distinct words.
SLICE_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES at most: ten thousand long texts at once would fill an executor.

    Its Python workers give freed memory back instead of keeping it for later.
    """
    for k, v in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(k, v)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only on a local master where none is set."""
    return shared_folder(spark).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written between the steps of one operator, in the shared folder.

    A written table survives lost executors and ends the lineage before it.
    ``drop`` deletes tables that no later step reads; tables which the returned
    DataFrame still reads stay until the session's end.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded_batches(spark)
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/flowloom/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._forget)

    def _forget(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # the session may be gone at interpreter exit
            return

    def table(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables and let the driver free the shuffle files behind them."""
        for t in tables:
            _delete(self.spark, t._scratch_path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class KeyFilter:
    """A Bloom filter over longs with a fixed number of bits.

    It never misses a key. It only decides which rows may skip a shuffle join,
    so a saturated filter costs time, never rows. Its size (2 MB) doesn't grow.
    """

    BITS = 24
    SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def positions(cls, keys: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            k = keys.astype(np.int64).view(np.uint64)
            return [mix64(k * np.uint64(s) + np.uint64(s)) >> np.uint64(64 - cls.BITS) for s in cls.SEEDS]

    @classmethod
    def of(cls, df: DataFrame, key: str) -> KeyFilter:
        """Each task marks its keys; the words of the filter are OR-ed before they reach the driver."""

        def mark(batches):
            import pyarrow as pa

            own = np.zeros(1 << (cls.BITS - 6), np.uint64)
            for batch in batches:
                keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                for p in cls.positions(keys):
                    np.bitwise_or.at(own, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
            at = np.flatnonzero(own)
            for i in range(0, len(at), 65536):
                part = at[i : i + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(own[part].view(np.int64))], names=["word", "bits"])

        found = df.select(F.col(key).cast("long").alias("key")).mapInArrow(mark, "word long, bits long")
        got = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        bits = np.zeros(1 << (cls.BITS - 6), np.uint64)
        bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(bits)

    def test(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for p in self.positions(keys):
            hit &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return hit


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public MurmurHash3 constants)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def slices_by_bytes(batch, column: str, limit: int = SLICE_BYTES):
    """Slices of an Arrow batch that hold about limit bytes of a text column; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def split_columns(batch, columns: list[str], step: int = SLICE_ROWS):
    """Slices of an Arrow batch as Python lists, text columns as bytes."""
    import pyarrow as pa

    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        out = []
        for c in columns:
            col = part.column(part.schema.get_field_index(c))
            out.append(col.cast(pa.binary()).to_pylist() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.to_pylist())
        yield out
