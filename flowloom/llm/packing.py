"""Packing of tokenised documents by concatenating and cutting.

Every document is tokenised once and written with its place in its partition.
The partitions' token totals are summed in two passes (inside each partition,
then over the short list of partitions), which gives every document its offset
in the one long row of tokens. Windows of fixed length cut that row; the pieces
on both sides of a cut are its boundary records.

Defined results: a null or empty text is the end id alone. Repeated rows are
packed as often as they occur; extra input columns are ignored; an empty table
gives an empty table. Only the last sequence of all needs padding.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices_by_bytes, split_columns, text_or_empty
from .tokens import word_ids

SEQUENCE_TOKENS = 2048
END_ID = 1


def tokenise(df: DataFrame, tokenizer_path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, part_start, key, doc_tokens, ids): ids as uint32 with the end id; part_start counts the ids before it in its partition."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, part, start = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for own in slices_by_bytes(batch, text):
                ids, sizes = words.encode(own.column(text), end_id)
                ends = np.cumsum(sizes)
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * np.r_[0, ends]), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(start + ends - sizes), own.column(key), pa.array(sizes), data.cast(pa.binary())],
                    names=["part", "part_start", key, "doc_tokens", "ids"],
                )
                start += int(sizes.sum())

    return df.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(run, f"part int, part_start long, `{key}` {key_type}, doc_tokens long, ids binary")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Add global_start. The list of partition totals has one short row per written partition, whatever the documents are."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    base, starts = 0, []
    for row in totals:
        starts.append((row["part"], base))
        base += row["n"]
    bases = tokens.sparkSession.createDataFrame(starts, "part int, base long")
    return tokens.join(F.broadcast(bases), "part").withColumn("global_start", F.col("base") + F.col("part_start")).drop("base", "part", "part_start")


def cut(tokens: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence."""
    key_type = tokens.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind = batch.schema.field(key).type
            for keys, sizes, ids, begins in split_columns(batch, [key, "doc_tokens", "ids", "global_start"], 4096):
                out = [[] for _ in range(8)]
                for k, n, data, g in zip(keys, sizes, ids, begins, strict=True):
                    at = 0
                    while at < n:
                        sequence, offset = divmod(g + at, sequence_tokens)
                        length = min(n - at, sequence_tokens - offset)
                        piece = data[4 * at : 4 * (at + length)]
                        for column, v in zip(out, (k, at, length, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                            column.append(v)
                        at += length
                arrays = [pa.array(out[0], kind), *(pa.array(x, pa.int64()) for x in out[1:7])]
                if with_ids:
                    arrays.append(pa.array(out[7], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    schema = f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return tokens.select(key, "doc_tokens", "ids", "global_start").mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of sequence_tokens ids (with_ids: with the ids of each)."""
    tokens = Scratch(df.sparkSession, "packing").table(tokenise(df, tokenizer_path, end_id, key, text))
    return cut(with_offsets(tokens), sequence_tokens, key, with_ids)


def sequences(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, pad_id: int = 0) -> DataFrame:
    """Whole sequences (sequence_id, n_tokens, ids) from pieces with ids.

    A sequence has at most sequence_tokens ids, so each group is bounded. A short
    one is padded to the full length, unless its length is a power of two.
    """

    def join(key, pdf):
        import pandas as pd

        ids = b"".join(pdf.sort_values("offset")["ids"])
        n = len(ids) // 4
        if n & (n - 1):
            ids += np.full(sequence_tokens - n, pad_id, "<u4").tobytes()
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [n], "ids": [ids]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, ids binary")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
