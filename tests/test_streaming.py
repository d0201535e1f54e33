"""Streams give what the batch gives, and late rows go."""

import datetime as dt

from pyspark.sql import functions as F

from flowloom.streaming.flows import clip, windowed_directions, windowed_grid_counts, with_measures

SCHEMA = "ts timestamp, ox double, oy double, dx double, dy double"


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stateless(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(dt.datetime(2024, 1, 1), 0.0, 0.0, 3.0, 4.0), (dt.datetime(2024, 1, 1), 9.0, 9.0, 9.0, 9.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    out = run(spark, with_measures(clip(stream, (-1, -1, 5, 5))), "stateless").collect()
    assert [r["length"] for r in out] == [5.0]


def test_windows_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    write([(at(1), 0.5, 0.5, 1.5, 0.5), (at(1, 30), 0.2, 0.2, 1.2, 0.2), (at(5), 0.0, 0.0, 0.0, 1.0)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = windowed_grid_counts(stream, "ts", 1.0).writeStream.outputMode("append").format("memory").queryName("grid").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    write([(at(1, 10), 0.5, 0.5, 1.5, 0.5), (at(9), 0.0, 0.0, 0.0, 1.0)])
    q.processAllAvailable()
    q.stop()
    rows = {(r["start"].hour, r["flow_count"]) for r in spark.table("grid").collect()}
    assert rows == {(1, 2), (5, 1)}


def test_directions(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(dt.datetime(2024, 1, 1), 0.0, 0.0, 1.0, 0.1), (dt.datetime(2024, 1, 1), 0.0, 0.0, -1.0, 0.1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    out = run(spark, windowed_directions(spark.readStream.schema(SCHEMA).parquet(path), "ts", 4), "dirs", "complete")
    assert {(r["sector"], r["flow_count"]) for r in out.select("sector", "flow_count").collect()} == {(0, 1), (1, 1)}
    assert out.filter(F.col("start").isNull()).count() == 0
