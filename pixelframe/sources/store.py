"""Tile store, versioned detections, products and metric logs, all on Spark's own formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.bands import SOURCES
from ..operators.chunks import band_runs
from ..operators.rings import polygons, to_wkb
from ..operators.runs import components

METRICS_LOG = ("accuracy", "precision", "recall", "f1", "iou", "loss")


def write_tiles(tiles: DataFrame, path: str, mode: str = "error") -> None:
    """One column per source and a mask, partitioned by scene; mode: overwrite, skip (leave what is there) or error."""
    w = tiles.write.partitionBy("scene_id").option("compression", "zstd")
    w.mode("ignore" if mode == "skip" else mode).parquet(path)


def read_tiles(spark: SparkSession, path: str, sources: list[str], scenes: list | None = None) -> DataFrame:
    """scene_id, tile_idx, x (the sources' arrays one after the other, in order of name), mask; only their columns are
    read, only the scenes' folders are opened."""
    df = spark.read.parquet(path)
    df = df if scenes is None else df.where(F.col("scene_id").isin(scenes))
    return df.select("scene_id", "tile_idx", F.concat(*sorted(sources)).alias("x"), "mask")


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table whose rows are dealt and sorted by keys: tables of as many buckets are joined on these without a shuffle.
    One task for each bucket, so that a bucket is one file."""
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("overwrite").saveAsTable(name)


def normalised(array: Column, source: str) -> Column:
    return F.transform(array, lambda v: v / F.lit(SOURCES[source][1]))


def write_versioned(df: DataFrame, path: str, version: str, fmt: str = "parquet") -> None:
    """A new version beside the old ones, which stay as backups. The version is complete when its _SUCCESS is there."""
    df.write.format(fmt).mode("error").save(f"{path}/version={version}")


def read_latest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df.join(F.broadcast(df.agg(F.max("version").alias("version"))), "version").drop("version")  # one row


def write_products(df: DataFrame, path: str) -> None:
    """Rasters or runs of an ensemble, one folder per threshold label."""
    df.write.partitionBy("threshold_label").mode("overwrite").parquet(path)


def write_scene_products(scored: DataFrame, keys: list[str], path: str, width: int, x0: float = 0.0, y0: float = 0.0, res: tuple[float, float] = (1.0, 1.0)) -> None:
    """The three products of scored chunks (bands p and b): probability (NaN for nodata), binarized (0, 1, 255), and the
    outlines of what is 1, as WKB."""
    scored.drop("b").write.mode("overwrite").parquet(f"{path}/probability")
    scored.select(*[c for c in scored.columns if c not in ("p", "b")], F.transform("b", lambda v: v.cast("smallint")).alias("b")).write.mode("overwrite").parquet(f"{path}/binarized")
    ones = scored.withColumn("_one", F.transform("b", lambda v: (v == 1).cast("double")))
    labelled = components(band_runs(ones, keys, "_one", 1.0), keys, width, 4)
    write_outlines(polygons(labelled, keys, x0, y0, res), f"{path}/polygons")


def write_outlines(outlines: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Outlines with their rings as WKB, one folder for each value of by (threshold labels)."""
    w = outlines.withColumn("geometry", to_wkb(F.col("rings"))).drop("rings").write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def parse_metrics_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """epoch, val_type and the metrics of lines 'Epoch N - Train: k:v, ...'; other lines are left out."""
    c = F.col(line)
    body = F.str_to_map(F.replace(F.regexp_extract(c, r"^Epoch \d+ - \w+: (.*)$", 1), F.lit(" "), F.lit("")), F.lit(","), F.lit(":"))
    df = lines.where(c.rlike(r"^Epoch \d+ - \w+: ") & ~c.startswith("Phase"))
    return df.select(F.regexp_extract(c, r"^Epoch (\d+)", 1).cast("int").alias("epoch"), F.regexp_extract(c, r"- (\w+):", 1).alias("val_type"), *[F.element_at(body, m).cast("double").alias(m) for m in METRICS_LOG])


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_metrics_log(spark.read.text(path).withColumnRenamed("value", "line"))


def metric_names(rows: DataFrame, names: str, dropped: list[str]) -> DataFrame:
    """The union of all names less the dropped ones, as one sorted array."""
    return rows.agg(F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(names))), F.array(*map(F.lit, dropped)))).alias("metric_names"))
