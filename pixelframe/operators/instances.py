"""Object metrics: components of target and prediction matched by intersection over union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .bands import above
from .chunks import SIZE, band_runs
from .metrics import _div
from .graph import cut
from .runs import boundary_runs, boundary_width, components, overlaps, to_runs
from .tree import component_curves


def _areas(labelled: DataFrame, keys: list[str], name: str) -> DataFrame:
    return labelled.groupBy(*keys, F.col("label").alias(name)).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias(f"{name}_area"))


def pair_iou(target: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, p, iou of the pairs that meet. Joins of runs and of objects are merged here and in match: the files of a cut
    are small for the rows in them, and Spark would broadcast these."""
    pairs = overlaps(target, pred, keys, "t", "p").join(_areas(target, keys, "t").hint("merge"), [*keys, "t"]).join(_areas(pred, keys, "p").hint("merge"), [*keys, "p"])
    return pairs.withColumn("iou", F.col("common") / (F.col("t_area") + F.col("p_area") - F.col("common")))


def instance_boundaries(labelled: DataFrame, keys: list[str], k: Column) -> DataFrame:
    """Each instance's boundary of width k, as runs with label: eroded within its own pixels only."""
    return boundary_runs(labelled, [*keys, "label"], k)


def match(target: DataFrame, pred: DataFrame, keys: list[str], images: DataFrame, iou: float = 0.5, metric: str = "iou", dilation: int | float = 0.02) -> DataFrame:
    """keys, tp, fp, fn for every row of images (keys); tp counts pairs. With metric 'boundary' a pair's IoU is the
    smaller of that of the objects and that of their boundaries, whose width is dilation in pixels, or that share of each
    image's own diagonal (images then have height and width, one row each)."""
    pairs = pair_iou(target, pred, keys)
    if metric == "boundary":
        k = boundary_width(dilation, F.col("height"), F.col("width"))
        with_size = lambda df: df if isinstance(dilation, int) else df.hint("merge").join(images.select(*keys, "height", "width"), keys)
        edges = pair_iou(instance_boundaries(with_size(target), keys, k), instance_boundaries(with_size(pred), keys, k), keys)
        pairs = pairs.join(edges.select(*keys, "t", "p", F.col("iou").alias("_b")).hint("merge"), [*keys, "t", "p"], "left").withColumn("iou", F.least("iou", F.coalesce("_b", F.lit(0.0))))
    tp = pairs.groupBy(*keys).agg(F.count_if(F.col("iou") >= iou).alias("tp"))
    nt = target.groupBy(*keys).agg(F.count_distinct("label").alias("nt"))
    np_ = pred.groupBy(*keys).agg(F.count_distinct("label").alias("np"))
    m = images.select(*keys).distinct()
    for counts in (nt, np_, tp):
        m = m.join(counts.hint("merge"), keys, "left")
    m = m.fillna(0, ["tp", "nt", "np"])
    return m.select(*keys, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))


def match_pixels(df: DataFrame, keys: list[str], width: int, score: str = "score", target: str = "target", t: float = 0.5, images: DataFrame | None = None, **how) -> DataFrame:
    """Dense pixels -> match of their components; images as for match."""
    tg = components(to_runs(df, F.col(target) == 1, keys), keys, width)
    pr = components(to_runs(df, above(F.col(score), t, False), keys), keys, width)
    return match(tg, pr, keys, df if images is None else images, **how)


def instance_scores(matches: DataFrame, by: tuple = (), beta: float = 1.0) -> DataFrame:
    """Sums of tp, fp, fn and their scores; by = the image's keys for samplewise scores."""
    s = matches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn, b = (F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double"), beta * beta)
    return s.withColumns({"precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "accuracy": _div(tp, tp + fp + fn), "f_beta": _div((1 + b) * tp, (1 + b) * tp + b * fn + fp)})


def instance_confusion(matches: DataFrame, normalize: bool = False) -> DataFrame:
    """n00 = 0, n01 = fp, n10 = fn, n11 = tp."""
    s = matches.agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")])
    n = F.col("tp") + F.col("fp") + F.col("fn") if normalize else F.lit(1.0)
    return s.select(F.lit(0.0).alias("n00"), *[_div(F.col(c), n).alias(o) for c, o in (("fp", "n01"), ("fn", "n10"), ("tp", "n11"))])


def instance_pr_curve(chunks: DataFrame, keys: list[str], width: int, thresholds: list[float], score: str = "score", target: str = "target", iou: float = 0.5, size: int = SIZE) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall. chunks: bands of scores and of 0/1 targets. The components of all
    thresholds come out of one tree of merges."""
    tg = cut(components(band_runs(chunks, keys, target, 1.0), keys, width))
    found = component_curves(chunks, keys, score, thresholds, tg, iou, size=size).groupBy("threshold").agg(F.sum("hits").alias("tp"), F.sum("objects").alias("_n"))
    n = tg.select(*keys, "label").distinct().agg(F.count("*").alias("_t"))
    m = found.crossJoin(F.broadcast(n))  # one row
    return instance_scores(m.select("threshold", "tp", (F.col("_n") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn")), ("threshold",)).drop("accuracy", "f_beta")


def instance_average_precision(curve: DataFrame) -> DataFrame:
    after = F.lead("recall").over(W.orderBy("threshold"))  # one row for each threshold
    return curve.withColumn("s", (F.col("recall") - F.coalesce(after, F.lit(0.0))) * F.col("precision")).agg(F.sum("s").alias("average_precision"))


def boundary_iou(df: DataFrame, keys: list[str], k: int | float, height: Column, width: Column, pred: str = "pred", target: str = "target", by: tuple = ()) -> DataFrame:
    """Intersection over union of the boundaries of dense 0/1 columns; k is their width in pixels, or as a share of each
    scene's own diagonal. What is outside the scene is 0. by: a part of keys."""
    size = [] if isinstance(k, int) else ["_h", "_w"]
    px = df.withColumns({"_h": height, "_w": width}) if size else df
    edges = {}
    for c in (pred, target):
        runs = to_runs(px, F.col(c) == 1, [*keys, *size])
        edges[c] = cut(boundary_runs(runs, [*keys, *size], boundary_width(k, F.col("_h"), F.col("_w"))).select(*keys, "y", "x0", "x1"))
    o = edges[target].select(*keys, "y", F.col("x0").alias("_q0"), F.col("x1").alias("_q1"))
    met = edges[pred].join(o, [*keys, "y"]).where("x0 <= _q1 and _q0 <= x1").select(*by, F.lit(0).alias("_n"), (F.least("x1", "_q1") - F.greatest("x0", "_q0") + 1).alias("_c"))
    each = edges[pred].unionByName(edges[target]).select(*by, (F.col("x1") - F.col("x0") + 1).alias("_n"), F.lit(0).alias("_c"))
    s = df.select(*by, F.lit(0).alias("_n"), F.lit(0).alias("_c")).distinct().unionByName(each).unionByName(met).groupBy(*by).agg(F.sum("_c").alias("common"), (F.sum("_n") - F.sum("_c")).alias("either"))
    return s.withColumn("boundary_iou", _div(F.col("common").cast("double"), F.col("either").cast("double")))
