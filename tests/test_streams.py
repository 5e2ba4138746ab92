"""Streams with state, bucketed tables and joins that fail."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from pixelframe import streaming
from pixelframe.operators import tiling
from pixelframe.sources import store


def test_accumulate_updates_resets_closes_and_goes_on(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    schema = "k string, ts timestamp, tp long, again boolean"
    runs = [
        [("a", day, 1, False), ("a", day + hour, 10, True), ("a", day + 2 * hour, 100, False), ("b", day, None, None)],
        [("a", day + 3 * hour, 1000, False)],  # goes on from the checkpoint
        [("c", day + 40 * hour, 5, False)],  # the watermark passes a and b
        [("a", day, 7, False), ("c", day + 41 * hour, 6, False)],  # too late for a
    ]
    got = []
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen = []
        streaming.accumulate(stream, ["k"], ["tp"], lambda b, n, seen=seen: seen.extend(map(tuple, b.collect())), str(tmp_path / "state"), reset="again").awaitTermination()
        got.append(sorted(seen))
    assert got[0] == [("a", 100, 1, False), ("b", 0, 1, False)]
    assert got[1] == [("a", 1100, 2, False), ("b", 0, 1, True)]
    assert got[2] == [("a", 1100, 2, True), ("c", 5, 1, False)]
    assert got[3] == [("c", 11, 2, False)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    k = ["scene_id", "row", "col"]
    base = spark.range(500).select((F.col("id") % 7).alias("scene_id"), (F.col("id") % 11).alias("row"), F.col("id").alias("col"))
    names = [f"b_{uuid.uuid4().hex}" for _ in range(3)]
    for i, n in enumerate(names):
        store.write_bucketed(base.withColumn("v", F.array(F.col("col") * i)), n, k, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tiling.join_sources(spark.table(names[0]), {"a": spark.table(names[1]), "b": spark.table(names[2])})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and out.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for n in names:
        spark.sql(f"drop table {n}")


def test_a_missing_source_fails(spark):
    tiles = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 0, 1, [2.0])], "scene_id int, row int, col int, img array<double>")
    aux = tiles.where("col = 0").select("scene_id", "row", "col", "img")
    with pytest.raises(Exception, match="tile without slope"):
        tiling.join_sources(tiles, {"slope": aux}).collect()
