"""Pixel metrics from grouped counts, and curves from one bucketed pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .bands import above


def _div(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, score: str = "score", target: str = "target", by: tuple = (), t: float = 0.5) -> DataFrame:
    p, y = above(F.col(score), t, False), F.col(target) == 1
    return df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))


def scalar_metrics(conf: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    po, pe = _div(tp + tn, n), _div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return conf.withColumns({
        "accuracy": po, "precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "specificity": _div(tn, tn + fp), "f1": _div(2 * tp, 2 * tp + fp + fn),
        "jaccard": _div(tp, tp + fp + fn), "hamming": 1 - po, "kappa": _div(po - pe, 1 - pe),
    })


def normalised_confusion(conf: DataFrame) -> DataFrame:
    """Shares over the true rows: n00, n01, n10, n11."""
    return conf.withColumns({"n00": _div(F.col("tn"), F.col("tn") + F.col("fp")), "n01": _div(F.col("fp"), F.col("tn") + F.col("fp")), "n10": _div(F.col("fn"), F.col("fn") + F.col("tp")), "n11": _div(F.col("tp"), F.col("fn") + F.col("tp"))})


def hinge(df: DataFrame, score: str = "score", target: str = "target", by: tuple = ()) -> DataFrame:
    s = F.when(F.col(target) == 1, 1.0).otherwise(-1.0)
    return df.groupBy(*by).agg(F.avg(F.greatest(F.lit(0.0), 1 - s * F.col(score))).alias("hinge"))


def curve_counts(df: DataFrame, score: str = "score", target: str = "target", by: tuple = (), thresholds: int = 100) -> DataFrame:
    """by, i, threshold, tp, fp, pos, neg for thresholds i / (thresholds - 1), score >= threshold: every score goes to the
    highest threshold that it reaches, then counts add up from above; the window works on thresholds, not pixels."""
    n = thresholds - 1
    b = F.floor(F.col(score) * n).cast("int")
    # the product may round across a threshold: the comparison itself decides
    b = F.when(F.col(score) >= (b + 1) / F.lit(float(n)), b + 1).when(F.col(score) < b / F.lit(float(n)), b - 1).otherwise(b)
    b = F.when(F.isnan(score) | (F.col(score) < 0), -1).otherwise(F.least(b, F.lit(n)))
    y = F.col(target) == 1
    counts = df.groupBy(*by, b.alias("i")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
    groups = counts.select(*by).distinct() if by else counts.limit(1).select(F.lit(1).alias("_one"))
    grid = groups.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(n)))).drop("_one")
    counts = grid.join(counts, [*by, "i"], "left").fillna(0, ["p", "q"])
    down = W.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*by)
    out = counts.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down), "pos": F.sum("p").over(every), "neg": F.sum("q").over(every)})
    return out.where("i >= 0").withColumn("threshold", F.col("i") / F.lit(float(n))).drop("p", "q")


def pr_curve(df: DataFrame, score: str = "score", target: str = "target", by: tuple = (), thresholds: int = 100) -> DataFrame:
    """by, i, threshold, precision, recall; the last point (i = thresholds, no threshold) is (1, 0)."""
    c = curve_counts(df, score, target, by, thresholds)
    points = c.select(*by, "i", "threshold", _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _div(F.col("tp"), F.col("pos")).alias("recall"))
    last = points.where("i = 0").select(*by, F.lit(thresholds).alias("i"), F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(last)


def average_precision(curve: DataFrame, by: tuple = ()) -> DataFrame:
    after = F.lead("recall").over(W.partitionBy(*by).orderBy("i"))
    steps = curve.withColumn("step", (F.col("recall") - F.coalesce(after, F.lit(0.0))) * F.col("precision"))
    return steps.groupBy(*by).agg(F.sum("step").alias("average_precision"))


def roc(df: DataFrame, score: str = "score", target: str = "target", by: tuple = (), thresholds: int = 100) -> DataFrame:
    c = curve_counts(df, score, target, by, thresholds)
    return c.select(*by, "i", "threshold", _div(F.col("tp"), F.col("pos")).alias("tpr"), _div(F.col("fp"), F.col("neg")).alias("fpr"))


def auroc(curve: DataFrame, by: tuple = ()) -> DataFrame:
    """Trapezoids over the curve's points, from (0, 0) on."""
    w = W.partitionBy(*by).orderBy("i")
    t2, f2 = F.coalesce(F.lead("tpr").over(w), F.lit(0.0)), F.coalesce(F.lead("fpr").over(w), F.lit(0.0))
    return curve.withColumn("a", (F.col("fpr") - f2) * (F.col("tpr") + t2) / 2).groupBy(*by).agg(F.sum("a").alias("auroc"))


def smoothed_scores(df: DataFrame, score: str = "score", target: str = "target", by: tuple = (), eps: float = 1e-7, beta: float = 1.0, threshold: float | None = None, ignore: Column | None = None) -> DataFrame:
    """Scores of sums; rows of ignored channels are left out."""
    df = df if ignore is None else df.where(~ignore)
    p = F.col(score) if threshold is None else above(F.col(score), threshold, False).cast("double")
    y = F.col(target).cast("double")
    s = df.groupBy(*by).agg(F.sum(p * y).alias("tp"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.avg((p == y).cast("double")).alias("accuracy"))
    tp, fp, fn, b = F.col("tp"), F.col("sp") - F.col("tp"), F.col("sy") - F.col("tp"), beta * beta
    return s.select(*by, ((tp + eps) / (F.col("sp") + F.col("sy") - tp + eps)).alias("iou"), (((1 + b) * tp + eps) / ((1 + b) * tp + b * fn + fp + eps)).alias("f_score"), "accuracy", ((tp + eps) / (F.col("sp") + eps)).alias("precision"), ((tp + eps) / (F.col("sy") + eps)).alias("recall"))


def log_rows(metrics: DataFrame, step: str, key: str, names: list[str]) -> DataFrame:
    """step, metric (key/name), value."""
    return metrics.unpivot([step], names, "metric", "value").withColumn("metric", F.concat(F.lit(f"{key}/"), "metric"))


def class_weights(df: DataFrame, target: str, classes: int, by: tuple = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.try_divide(F.lit(1.0), classes * F.avg((F.col(target) == i).cast("double"))).alias(f"w{i}") for i in range(classes)])
