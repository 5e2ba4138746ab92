"""Windows over rows and columns of pixels: erosion and slope. Every window works within one row or one column of a
scene. What looks further is in chunks.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def erode_square(pixels: DataFrame, col: str, keys: list[str], k: int, height: Column, width: Column, out: str = "eroded") -> DataFrame:
    """1 where all of the (2k + 1) x (2k + 1) square is 1; outside the image is 0. pixels must be dense."""
    inside = (F.col("x") >= k) & (F.col("x") < width - k) & (F.col("y") >= k) & (F.col("y") < height - k)
    along_x = W.partitionBy(*keys, "y").orderBy("x").rangeBetween(-k, k)
    along_y = W.partitionBy(*keys, "x").orderBy("y").rangeBetween(-k, k)
    df = pixels.withColumn("_r", F.min(col).over(along_x)).withColumn("_s", F.min("_r").over(along_y))
    return df.withColumn(out, F.when(inside, F.col("_s")).otherwise(0)).drop("_r", "_s")


def slope(pixels: DataFrame, col: str, keys: list[str], res: float = 1.0, out: str = "slope") -> DataFrame:
    """Degrees, from central differences (one-sided at the edge)."""

    def diff(w) -> Column:
        a, b = F.lag(col).over(w), F.lead(col).over(w)
        n = F.when(a.isNotNull() & b.isNotNull(), 2.0).otherwise(1.0)
        return F.coalesce((F.coalesce(b, F.col(col)) - F.coalesce(a, F.col(col))) / (n * res), F.lit(0.0))

    x, y = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")
    return pixels.withColumn("_gx", diff(x)).withColumn("_gy", diff(y)).withColumn(out, F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_gx", "_gy")
