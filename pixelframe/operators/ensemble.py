"""Ensembles of probability rasters: mean, thresholds, objects, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bands import above
from .runs import component_stats, components, dilate_disk, drop_edge, drop_touching, on_edge, remove_small, runs_to_pixels, to_runs


def ensemble_mean(probs: DataFrame, keys: list[str], models: list[str], model: str = "model", p: str = "p") -> DataFrame:
    """Long (keys, y, x, model, p) -> p; pixels that lack a model are left out, NaN in any model gives NaN."""
    m = probs.where(F.col(model).isin(models)).groupBy(*keys, "y", "x").agg(F.avg(p).alias("p"), F.count_distinct(model).alias("_n"))
    return m.where(F.col("_n") == len(models)).drop("_n")


def by_threshold(mean: DataFrame, thresholds: list[float]) -> DataFrame:
    """Rows with p >= threshold, once for each threshold; NaN passes none."""
    return mean.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(above(F.col("p"), F.col("threshold")))


def ensemble_clean(mean: DataFrame, keys: list[str], width: int, height: Column, scene_width: Column, thresholds=(0.5,), border: int = 10, min_size: int = 32, connectivity: int = 8, min_connectivity: int = 4, scenes: DataFrame | None = None, disk: int | None = None) -> DataFrame:
    """keys, threshold, y, x0, x1, label: objects of each threshold, without those that touch nodata (NaN, dilated by
    a disk of radius border) or the edge band, and without small ones (measured with min_connectivity; what is left of
    an object keeps the label of its part). scenes: keys and the columns that height and scene_width name; disk: the
    radius around nodata, if it is not the border's."""
    k = [*keys, "threshold"]
    objects = components(to_runs(by_threshold(mean, list(thresholds)), F.lit(True), k), k, width, connectivity)
    nodata = dilate_disk(to_runs(mean, F.isnan("p"), keys), keys, border if disk is None else disk)
    kept = drop_touching(objects, nodata, k)
    kept = drop_edge(kept if scenes is None else kept.join(scenes, keys), k, height, scene_width, border).select(*k, "y", "x0", "x1", "label")
    if min_size <= 1:
        return kept
    if min_connectivity != connectivity:
        kept = components(kept.drop("label"), k, width, min_connectivity)
    return remove_small(kept, k, min_size)


def object_table(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return component_stats(labelled, keys)


def erode_valid(pixels: DataFrame, col: str, keys: list[str], r: int, height: Column, width: Column, mask: str | None = None) -> DataFrame:
    """col is NaN within a disk of radius r around the NaN pixels of mask (else of col), and in the first and last r rows
    and columns."""
    hit = runs_to_pixels(dilate_disk(to_runs(pixels, F.isnan(mask or col), keys), keys, r)).withColumn("_hit", F.lit(True))
    out = pixels.join(hit, [*keys, "y", "x"], "left")
    gone = F.coalesce("_hit", F.lit(False)) | on_edge(F.col("y"), F.col("x"), height, width, r)
    return out.withColumn(col, F.when(gone, float("nan")).otherwise(F.col(col))).drop("_hit")


def ensemble_negative(probs: DataFrame, keys: list[str], negative: str | None = None, negative_t: float = 0.8, models=("p1", "p2"), erode: int = 0, height: Column | None = None, width: Column | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """Mean of two models; NaN stays NaN, and that of the first model is widened by erode pixels, as is the edge; 0 where the
    negative class reaches negative_t (or is NaN). thresholds: the pixels that pass each instead, with threshold."""
    out = probs.withColumn("p", (F.col(models[0]) + F.col(models[1])) / 2)
    if erode:
        out = erode_valid(out, "p", keys, erode, height, width, models[0])
    if negative is not None:
        low = F.when(F.isnan(negative), 0.0).otherwise((F.col(negative) < negative_t).cast("double"))
        out = out.withColumn("p", F.when(F.isnan("p"), F.col("p")).otherwise(F.col("p") * low))
    return out if thresholds is None else by_threshold(out, thresholds)
