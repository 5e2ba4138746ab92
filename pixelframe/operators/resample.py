"""Rasters on another grid: nearest neighbour, and cubic convolution over 4 x 4 neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def grid_step(src: Column, target: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Scale and offset (y, x) of a target grid in pixels of the source's, from geo structs x0, y0, xres, yres of one
    coordinate system."""
    scale = (target["yres"] / src["yres"], target["xres"] / src["xres"])
    return scale, ((target["y0"] - src["y0"]) / src["yres"], (target["x0"] - src["x0"]) / src["xres"])


def target_grid(scenes: DataFrame, keys: list[str], scale: tuple[float, float]) -> DataFrame:
    """keys, y, x of the whole pixels of each scene (height, width) at another scale."""
    rows = lambda c, s: F.explode(F.expr(f"sequence(0, cast(floor({c} / {s}) as int) - 1)"))
    fit = scenes.where((F.floor(F.col("height") / scale[0]) > 0) & (F.floor(F.col("width") / scale[1]) > 0))
    return fit.select(*keys, "width", rows("height", scale[0]).alias("y")).select(*keys, "y", rows("width", scale[1]).alias("x"))


def _source(t: Column, scale, offset) -> Column:
    """Centre of target pixel t in source pixels."""
    return (t + 0.5) * scale - 0.5 + offset


def align_nearest(src: DataFrame, target: DataFrame, keys: list[str], col: str, scale: tuple, offset: tuple = (0.0, 0.0)) -> DataFrame:
    """target (keys, y, x) with col of the source pixel that holds its centre; scale = target / source pixel size, offset = the
    target's origin in source pixels (y, x), numbers or columns of target."""
    at = lambda c, i: F.floor((F.col(c) + 0.5) * scale[i] + offset[i]).cast("int")
    t = target.select(*keys, "y", "x", at("y", 0).alias("_sy"), at("x", 1).alias("_sx"))
    return t.join(src.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), col), [*keys, "_sy", "_sx"], "left").drop("_sy", "_sx")


def cubic(d: Column, a: float = -0.5) -> Column:
    d = F.abs(d)
    return F.when(d <= 1, (a + 2) * d * d * d - (a + 3) * d * d + 1).when(d < 2, a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a).otherwise(0.0)


def align_cubic(src: DataFrame, target: DataFrame, keys: list[str], col: str, scale: tuple, offset: tuple = (0.0, 0.0)) -> DataFrame:
    """sum(w * v) / sum(w) over the neighbours that are there. w is a row's weight times a column's, so rows are summed up
    first. The joins are merged: Spark takes a grid for as small as the scenes that it is made of, and would broadcast it."""
    t = target.select(*keys, "y", "x", _source(F.col("y"), scale[0], offset[0]).alias("_fy"), _source(F.col("x"), scale[1], offset[1]).alias("_fx"))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c)).cast("int") - 1, F.floor(F.col(c)).cast("int") + 2))
    rows = t.select(*keys, "_fy").distinct().withColumn("_sy", around("_fy")).withColumn("_w", cubic(F.col("_fy") - F.col("_sy")))
    met = rows.hint("merge").join(src.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(col).alias("_v")), [*keys, "_sy"])
    sums = met.groupBy(*keys, "_fy", "_sx").agg(F.sum(F.col("_w") * F.col("_v")).alias("_v"), F.sum("_w").alias("_w"))
    m = t.withColumn("_sx", around("_fx")).hint("merge").join(sums, [*keys, "_fy", "_sx"])
    w = cubic(F.col("_fx") - F.col("_sx"))
    return m.groupBy(*keys, "y", "x").agg((F.sum(w * F.col("_v")) / F.sum(w * F.col("_w"))).alias(col))
