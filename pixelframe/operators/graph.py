"""Cutting lineage, and connected components of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a local session gets a temporary one
    and a cluster an error: its machines share no temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Rows of a file, where a cut knows how many rows it has at most.
PER_FILE = 20_000


def cut(df: DataFrame, *done: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: the lineage ends there, and a lost executor costs no
    recomputation. The write's shuffle files go when it ends; so do the files of done, earlier cuts that nothing but
    df still needed. rows: how many there are at most, so that few rows make few files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PER_FILE)))
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    for old in done:
        drop(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a cut."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id in the links a-b the smallest id that it reaches.

    Alternates the large-star and small-star steps until no link changes. Each step is one aggregated
    minimum per id (combined before the shuffle) and one join, which splits hot ids when adaptive
    execution finds them; nothing but two numbers per round reaches the driver. Empty links: no rows.
    """

    def stats(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now = stats(e)
    if not now[0]:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(60):
        old = e
        # large star: every larger neighbour of u is linked with u's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours are linked with the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        near = e.join(low, F.col("u") == F.col("k"))
        e = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), old, rows=2 * now[0])
        was, now = now, stats(e)
        if was == now:
            break
    else:
        raise RuntimeError("links did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return roots.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
