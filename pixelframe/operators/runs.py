"""Binary masks as runs (y, x0, x1 inclusive): labelling, dilation and overlap are joins of short intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .graph import connected_components, cut

#: Rows of a scene that are labelled together.
BAND = 1024


def to_runs(pixels: DataFrame, cond: Column, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the pixels where cond holds. The window works within one row of one scene."""
    w = W.partitionBy(*keys, "y").orderBy("x")
    on = pixels.where(cond).select(*keys, "y", "x", (F.col("x") - F.row_number().over(w)).alias("_g"))
    return on.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def runs_to_pixels(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching runs of a row become one."""
    w = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("x0") > before + 1, F.lit(True)), 1).otherwise(0)
    g = runs.select(*keys, "y", "x0", "x1", new.alias("_n")).withColumn("_g", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def joined_up(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that it reaches by the links a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def neighbours(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in rows next to each other that meet; runs come sorted by y and x0 and are apart in their row."""
    wide = int(x1.max(initial=0)) + reach + 2 - min(0, int(x0.min(initial=0)) - reach)
    ends, starts = y * wide + x1, y * wide + x0
    first = np.searchsorted(ends, (y - 1) * wide + x0 - reach)
    stop = np.searchsorted(starts, (y - 1) * wide + x1 + reach, side="right")
    count = np.maximum(stop - first, 0)
    run = np.repeat(np.arange(len(y)), count)
    other = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return run, other


def components(runs: DataFrame, keys: list[str], width: int, connectivity: int = 8) -> DataFrame:
    """runs (apart in their row) with label: the smallest y * width + x of the component. Bands of BAND rows of a scene are
    labelled by themselves, one Arrow table each; labels that meet where two bands do are joined up as a graph,
    whose nodes are keys and label."""
    reach = 1 if connectivity == 8 else 0

    def label(t: pa.Table) -> pa.Table:
        y, x0, x1 = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        order = np.lexsort((x0, y))
        run, other = neighbours(y[order], x0[order], x1[order], reach)
        root = joined_up(len(order), run, other)
        # the first run of a component in this order holds its smallest pixel
        first = (y * width + x0)[order][root]
        return t.take(pa.array(order)).append_column("label", pa.array(first)).select(names)

    names = [*keys, "y", "x0", "x1", "label"]
    rows = runs.select(*names[:-1]).withColumn("_band", F.floor(F.col("y") / BAND))
    schema = T.StructType([f for f in rows.schema if f.name != "_band"]).add("label", "long")
    found = cut(rows.groupBy(*keys, "_band").applyInArrow(label, schema))
    low = found.where(F.pmod("y", F.lit(BAND)) == 0)
    high = found.where(F.pmod("y", F.lit(BAND)) == BAND - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("_p0"), F.col("x1").alias("_p1"), F.col("label").alias("_up"))
    seams = low.join(high, [*keys, "y"]).where((F.col("_p0") <= F.col("x1") + reach) & (F.col("x0") <= F.col("_p1") + reach))
    node = lambda c: F.struct(*keys, F.col(c).alias("label"))
    seams = cut(seams.select(node("label").alias("a"), node("_up").alias("b")).distinct())
    if seams.isEmpty():
        return found
    groups = connected_components(seams).select(F.col("id").alias("_id"), F.col("component.label").alias("_label"))
    out = found.withColumn("_node", node("label")).join(groups, F.col("_node") == F.col("_id"), "left")
    return out.select(*names[:-1], F.coalesce("_label", "label").alias("label"))


def component_stats(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, area, bounding box."""
    return labelled.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"))


def remove_small(labelled: DataFrame, keys: list[str], min_size: int) -> DataFrame:
    big = labelled.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_a")).where(F.col("_a") >= min_size)
    return labelled.join(big.drop("_a"), [*keys, "label"], "left_semi")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """keys, left label, right label, pixels in common: only pairs that meet. The join is merged, for runs are many more than
    Spark takes them for by their files."""
    o = b.select(*keys, "y", F.col("x0").alias("_q0"), F.col("x1").alias("_q1"), F.col("label").alias(right))
    m = a.select(*keys, "y", "x0", "x1", F.col("label").alias(left)).hint("merge").join(o, [*keys, "y"]).where("x0 <= _q1 and _q0 <= x1")
    return m.groupBy(*keys, left, right).agg(F.sum(F.least("x1", "_q1") - F.greatest("x0", "_q0") + 1).alias("common"))


def touching(labelled: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with a pixel in mask (runs whose keys may be fewer than labelled's)."""
    shared = [k for k in keys if k in mask.columns]
    m = mask.select(*shared, "y", F.col("x0").alias("_q0"), F.col("x1").alias("_q1"))
    return labelled.join(m, [*shared, "y"]).where("x0 <= _q1 and _q0 <= x1").select(*keys, "label").distinct()


def drop_touching(labelled: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.join(touching(labelled, mask, keys), [*keys, "label"], "left_anti")


def on_edge(y: Column, x: Column, height: Column, width: Column, size: int) -> Column:
    """Whether a pixel is in the first or last size rows or columns; size 0 is no band."""
    return F.lit(False) if size == 0 else (y < size) | (x < size) | (y >= height - size) | (x >= width - size)


def drop_edge(labelled: DataFrame, keys: list[str], height: Column, width: Column, size: int) -> DataFrame:
    """Without components that reach the edge band; runs tell it by their ends."""
    if size == 0:
        return labelled
    hit = (F.col("y") < size) | (F.col("y") >= height - size) | (F.col("x0") < size) | (F.col("x1") >= width - size)
    gone = labelled.where(hit).select(*keys, "label").distinct()
    return labelled.join(gone, [*keys, "label"], "left_anti")


def dilate_disk(runs: DataFrame, keys: list[str], r: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Runs of the dilation by dx*dx + dy*dy <= r*r: each run is widened in 2r + 1 rows, then merged."""
    dy = runs.withColumn("_d", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    half = F.floor(F.sqrt(F.lit(float(r * r)) - F.col("_d") * F.col("_d"))).cast("int")
    wide = dy.select(*keys, (F.col("y") + F.col("_d")).alias("y"), (F.col("x0") - half).alias("x0"), (F.col("x1") + half).alias("x1"))
    if height is not None:
        wide = wide.where((F.col("y") >= 0) & (F.col("y") < height)).select(*keys, "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(width - 1)).alias("x1"))
    return merge_runs(wide, keys)


def covered(ranges: DataFrame, keys: list[str], times: Column) -> DataFrame:
    """keys, y, x0, x1 of the stretches of a row that as many ranges cover as times says (a column that is equal for
    equal keys). A range adds one from x0 on and takes it away behind x1."""
    ends = ranges.select(*keys, "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"), times.alias("_n"))
    steps = ends.groupBy(*keys, "y", "e.x").agg(F.sum("e.d").alias("_d"), F.min("_n").alias("_n")).where("_d != 0")
    w = W.partitionBy(*keys, "y").orderBy("x")
    steps = steps.withColumn("_c", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_e", F.lead("x").over(w))
    return steps.where(F.col("_c") == F.col("_n")).select(*keys, "y", F.col("x").alias("x0"), (F.col("_e") - 1).alias("x1"))


def erode_runs(runs: DataFrame, keys: list[str], k: Column) -> DataFrame:
    """Runs (apart in their row) of the pixels whose (2k + 1) x (2k + 1) square is covered: each run shrinks by k at both
    ends and goes to 2k + 1 rows; what all of these cover stays. keys may have a label: then each object erodes within
    its own pixels."""
    thin = runs.select(*keys, "y", (F.col("x0") + k).alias("x0"), (F.col("x1") - k).alias("x1"), k.alias("_k")).where("x0 <= x1")
    spread = thin.withColumn("_d", F.explode(F.sequence(-F.col("_k"), F.col("_k")))).withColumn("y", F.col("y") + F.col("_d"))
    return covered(spread, keys, 2 * F.col("_k") + 1)


def boundary_runs(runs: DataFrame, keys: list[str], k: Column) -> DataFrame:
    """Runs less their erosion by k."""
    both = runs.select(*keys, "y", "x0", "x1").unionByName(erode_runs(runs, keys, k))
    return covered(both, keys, F.lit(1))


def boundary_width(d: int | float, height: Column, width: Column) -> Column:
    """A width in pixels, or as a share of the diagonal, at least one pixel."""
    return F.lit(d) if isinstance(d, int) else F.greatest(F.lit(1), F.bround(F.lit(d) * F.sqrt(height * height + width * width)).cast("int"))
