"""A corpus pipeline over ``documents``, one operator of flowloom.llm a stage.

Each stage works on all that the one before kept. Documents that the quality
classifier rejects go; of each group of near duplicates one row stays, the one of the
smallest id (rows without an id come last, equal rows count once); repeated passages
are cut out of the texts, a document being kept even if nothing of its text is left;
what remains is packed into sequences. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm import near_copies, packing, quality, substring_dedup
from flowloom.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = tuple(docs.columns)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    key, text = (f"c{columns.index(c)}" for c in ("doc_id", "text"))
    kept = quality.scored(plain, model, key, text, tuple(plain.columns)).filter("predicted = 1")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word Jaccard 0.8: the one of the smallest id, rows without an id last."""
    own = docs.withColumn("__node", near_copies.node_of())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__node")
    groups = near_copies.near_copies(docs).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    named = own.select("doc_id", "__node").join(groups, "__node", "left")
    stays = named.groupBy(F.coalesce("__component", "__node")).agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("kept_id"), F.col("w.__node").alias("kept_node"))
    kept = own.join(stays, (F.col("__node") == F.col("kept_node")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    equal = Window.partitionBy("__node", "doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn("__row", F.row_number().over(equal)).filter("__row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat; n_chars follows."""
    columns = tuple(docs.columns)
    carried = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    cut = substring_dedup.remove_repeats(carried, key=at["doc_id"], text=at["text"], carry=tuple(carried.columns))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col(at["text"]))
    size = {"n_chars": F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))} if "n_chars" in at else {}
    made = {"text": text} | size
    return cut.select(*[made.get(c, F.col(at[c])).alias(c) for c in columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: No SQL: the stages hash shingles, fit a model and tokenise. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written, and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
