"""Flows derived from the star-schema tables, by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import FlowFrame

ORIGIN = "cast({0} * 7919 % 10007 as double) / 10.0e0 as {2}x, cast({0} * 104729 % 10009 as double) / 10.0e0 as {2}y"
ORDERS_SQL = "select o_orderkey as flow_id, " + ORIGIN.format("o_custkey", "", "o") + ", " + ORIGIN.format("o_orderkey", "", "d") + ", o_totalprice from orders"
ITEMS_SQL = "select " + ORIGIN.format("l_suppkey", "", "o") + ", " + ORIGIN.format("o_custkey", "", "d") + ", l_extendedprice as w from lineitem join orders on l_orderkey = o_orderkey"
EMBEDDING_SQL = "select vec_id as flow_id, " + ", ".join(f"cast(embedding[{i}] as double) as {c}" for i, c in enumerate(("ox", "oy", "dx", "dy"), 1)) + ", label from embeddings"
ZONES_SQL = "select cast(k as bigint) as zone_id, cast(k % 10 as double) * 100 as minx, floor(k / 10) * 100 as miny, cast(k % 10 + 1 as double) * 100 as maxx, (floor(k / 10) + 1) * 100 as maxy from range(0, 100) t(k)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _point(key: str, p: str) -> list:
    k = F.col(key)
    return [((k * 7919 % 10007).cast("double") / 10).alias(p + "x"), ((k * 104729 % 10009).cast("double") / 10).alias(p + "y")]


def flows_ord(spark: SparkSession, sf_dir: str) -> FlowFrame:
    orders = table(spark, sf_dir, "orders")
    return FlowFrame(orders.select(F.col("o_orderkey").alias("flow_id"), *_point("o_custkey", "o"), *_point("o_orderkey", "d"), "o_totalprice"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of line items, without an id of their own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return both.select(*_point("l_suppkey", "o"), *_point("o_custkey", "d"), F.col("l_extendedprice").alias("w"))


def flows_li(spark: SparkSession, sf_dir: str) -> FlowFrame:
    """Line items with an id that their rows' place gives; only for operators that don't look at ids."""
    return FlowFrame(items(spark, sf_dir).withColumn("flow_id", F.monotonically_increasing_id()))


def flows_emb(spark: SparkSession, sf_dir: str) -> FlowFrame:
    e = table(spark, sf_dir, "embeddings")
    return FlowFrame(e.select(F.col("vec_id").alias("flow_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("ox", "oy", "dx", "dy"))], "label"))


def zones(spark: SparkSession) -> DataFrame:
    """10 x 10 boxes of side 100."""
    k = F.col("id")
    x, y = (k % 10).cast("double"), F.floor(k / 10).cast("double")
    return spark.range(100).select(k.alias("zone_id"), (x * 100).alias("minx"), (y * 100).alias("miny"), ((x + 1) * 100).alias("maxx"), ((y + 1) * 100).alias("maxy"))
