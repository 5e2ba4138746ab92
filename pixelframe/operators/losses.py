"""Losses of scored pixels as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .graph import cut
from .metrics import class_weights


def bce(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, stable."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def _reduce(df: DataFrame, loss: Column, by: tuple, reduction: str, name: str) -> DataFrame:
    """mean or sum over by; batchwise_mean is the sum over a batch for each place, which by names; none keeps the rows."""
    if reduction == "batchwise_mean":
        reduction = "sum"
    return df.withColumn(name, loss) if reduction == "none" else df.groupBy(*by).agg((F.sum if reduction == "sum" else F.avg)(loss).alias(name))


def focal(df: DataFrame, x: Column, y: Column, by: tuple = (), gamma: float = 2.0, alpha: float | None = None, normalized: bool = False, reduced_threshold: float | None = None, reduction: str = "mean", ignore: Column | None = None) -> DataFrame:
    """Binary focal loss; normalized divides by the sum of the focal weights."""
    df = df if ignore is None else df.where(~ignore)
    pt = F.exp(-bce(x, y))
    weight = F.pow(1 - pt, F.lit(gamma)) if reduced_threshold is None else F.when(pt < reduced_threshold, 1.0).otherwise(F.pow((1 - pt) / reduced_threshold, F.lit(gamma)))
    loss = weight * bce(x, y)
    if alpha is not None:
        loss = loss * (alpha * y + (1 - alpha) * (1 - y))
    if normalized:
        top = F.sum(loss) if reduction == "sum" else F.avg(loss)
        return df.groupBy(*by).agg((top / F.greatest(F.sum(weight), F.lit(1e-5))).alias("focal"))
    return _reduce(df, loss, by, reduction, "focal")


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(logits, lambda x: x - lse)


def softmax_focal(df: DataFrame, logits: Column, cls: Column, by: tuple = (), gamma: float = 2.0, reduced_threshold: float | None = None, normalized: bool = False, reduction: str = "mean", ignore: Column | None = None) -> DataFrame:
    """Focal loss over classes; ignored pixels are left out."""
    df = df if ignore is None else df.where(~ignore)
    lp = F.get(log_softmax(logits), cls)
    pt = F.exp(lp)
    weight = F.pow(1 - pt, F.lit(gamma)) if reduced_threshold is None else F.when(pt < reduced_threshold, 1.0).otherwise(F.pow((1 - pt) / reduced_threshold, F.lit(gamma)))
    loss = weight * -lp
    if normalized:
        top = F.sum(loss) if reduction == "sum" else F.avg(loss)
        return df.groupBy(*by).agg((top / F.greatest(F.sum(weight), F.lit(1e-5))).alias("softmax_focal"))
    return _reduce(df, loss, by, reduction, "softmax_focal")


def _overlap_loss(df: DataFrame, p: Column, y: Column, by: tuple, cls: tuple, smooth: float, eps: float, log: bool, union: bool, name: str) -> DataFrame:
    s = df.groupBy(*by, *cls).agg(F.sum(p * y).alias("i"), F.sum(p + y).alias("c"), F.sum(y).alias("t"))
    score = (F.col("i") + smooth) / F.greatest(F.col("c") - F.col("i") + smooth, F.lit(eps)) if union else (2 * F.col("i") + smooth) / F.greatest(F.col("c") + smooth, F.lit(eps))
    loss = (-F.log(F.greatest(score, F.lit(eps))) if log else 1 - score) * (F.col("t") > 0).cast("double")
    return s.groupBy(*by).agg(F.avg(loss).alias(name))


def dice(df: DataFrame, p: Column, y: Column, by: tuple = (), cls: tuple = (), smooth: float = 0.0, eps: float = 1e-7, log: bool = False) -> DataFrame:
    return _overlap_loss(df, p, y, by, cls, smooth, eps, log, False, "dice")


def jaccard(df: DataFrame, p: Column, y: Column, by: tuple = (), cls: tuple = (), smooth: float = 0.0, eps: float = 1e-7, log: bool = False) -> DataFrame:
    return _overlap_loss(df, p, y, by, cls, smooth, eps, log, True, "jaccard_loss")


def soft_bce(df: DataFrame, x: Column, y: Column, by: tuple = (), smooth: float = 0.1, weight: Column | None = None, ignore: Column | None = None, pos_weight: float = 1.0) -> DataFrame:
    """Smoothed targets; ignored pixels count as 0 and stay in the denominator; pos_weight multiplies the part of the
    positive class."""
    soft = (1 - y) * smooth + y * (1 - smooth)
    loss = bce(x, soft) if pos_weight == 1.0 else pos_weight * soft * bce(x, F.lit(1.0)) + (1 - soft) * bce(x, F.lit(0.0))
    loss = loss if weight is None else loss * weight
    return df.groupBy(*by).agg(F.avg(loss if ignore is None else F.when(ignore, 0.0).otherwise(loss)).alias("soft_bce"))


def soft_ce(df: DataFrame, logits: Column, cls: Column, by: tuple = (), smooth: float = 0.1, ignore: Column | None = None) -> DataFrame:
    """(1 - s) * nll + s / C * -sum(log p); ignored pixels count as 0 and stay in the denominator."""
    lp = log_softmax(logits)
    loss = -(1 - smooth) * F.get(lp, cls) - smooth / F.size(logits) * F.aggregate(lp, F.lit(0.0), lambda a, v: a + v)
    return df.groupBy(*by).agg(F.avg(loss if ignore is None else F.when(ignore, 0.0).otherwise(loss)).alias("soft_ce"))


def combined(df: DataFrame, weights: dict[str, float], out: str = "loss") -> DataFrame:
    """A loss made of multiples of others: the sum of columns by weight."""
    parts = [F.col(c) * w for c, w in weights.items()]
    return df.withColumn(out, sum(parts[1:], parts[0]))


def lovasz_grad_sum(df: DataFrame, error: Column, y: Column, keys: tuple, order: list) -> DataFrame:
    """keys, loss, positives: the Lovasz extension of the Jaccard loss over errors from large to small within keys, which may
    hold any share of the rows: rows are dealt by range of their errors over the tasks, each of which ranks its own; counts
    of the parts before give the rest."""
    e = df.select(*keys, error.alias("e"), y.cast("double").alias("y"), *[F.col(o) for o in order if o not in keys])
    ends = [*keys, F.col("e").desc(), *order]
    e = cut(e.repartitionByRange(*ends).withColumn("_part", F.spark_partition_id()))
    parts = e.groupBy(*keys, "_part").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    every = W.partitionBy(*keys)
    before = every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("p").over(before), F.lit(0.0)).alias("_p"), F.sum("p").over(every).alias("g"))
    own = W.partitionBy(*keys, "_part").orderBy(F.col("e").desc(), *order)
    e = e.withColumns({"k": F.row_number().over(own), "cp": F.sum("y").over(own.rowsBetween(W.unboundedPreceding, 0))}).join(parts, [*keys, "_part"])
    k, cp, g = F.col("k") + F.col("_n"), F.col("cp") + F.col("_p"), F.col("g")
    last = F.when(k > 1, 1 - (g - cp + F.col("y")) / (g + k - 1 - cp + F.col("y"))).otherwise(0.0)
    grad = 1 - (g - cp) / (g + k - cp) - last
    return e.groupBy(*keys).agg(F.sum(F.greatest("e", F.lit(0.0)) * grad).alias("loss"), F.sum("y").alias("positives"))


def lovasz_hinge(df: DataFrame, x: Column, y: Column, image: tuple, order: list, by: tuple = ()) -> DataFrame:
    """Mean over images of the hinge form."""
    return lovasz_grad_sum(df, 1 - x * (2 * y - 1), y, (*by, *image), order).groupBy(*by).agg(F.avg("loss").alias("lovasz_hinge"))


def lovasz_softmax(df: DataFrame, p: Column, y: Column, cls: str, order: list, by: tuple = ()) -> DataFrame:
    """df: one row per pixel and class; mean over the classes that are present."""
    per = lovasz_grad_sum(df, F.abs(y - p), y, (*by, cls), order)
    return per.where("positives > 0").groupBy(*by).agg(F.avg("loss").alias("lovasz_softmax"))


def wing(df: DataFrame, p: Column, y: Column, by: tuple = (), width: float = 5.0, curvature: float = 0.5) -> DataFrame:
    d = F.abs(y - p)
    c = width - width * math.log(1 + width / curvature)
    return df.groupBy(*by).agg(F.avg(F.when(d < width, width * F.log(1 + d / curvature)).otherwise(d - c)).alias("wing"))


#: Lanczos coefficients (g = 7, n = 9), fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """log gamma for x > 0."""
    z = x - 1
    s = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(s)


def gamma_log_density(x: Column, a: Column, b: Column, eps: float = 0.0) -> Column:
    """eps is added to x in the logarithm only."""
    return a * F.log(b) + (a - 1) * F.log(x + eps) - b * x - lgamma(a)


def gamma_nll(df: DataFrame, x: Column, a: Column, b: Column, by: tuple = (), log_parameters: bool = False) -> DataFrame:
    """Mean negative log-likelihood; with log_parameters a and b are exp'ed and x may be 0 (0.001 is added in the
    logarithm)."""
    d = gamma_log_density(x, F.exp(a), F.exp(b), 1e-3) if log_parameters else gamma_log_density(x, a, b)
    return df.groupBy(*by).agg((-F.avg(d)).alias("gamma_nll"))


def symmetric_focal(df: DataFrame, x: Column, y: Column, by: tuple = (), gamma: float = 2.0) -> DataFrame:
    p = 1 / (1 + F.exp(-x))
    loss = y * F.pow(1 - p, F.lit(gamma)) * bce(x, F.lit(1.0)) + (1 - y) * F.pow(p, F.lit(gamma)) * bce(x, F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(loss).alias("symmetric_focal"))


def balanced_ce(df: DataFrame, p: Column, target: str, by: tuple = ()) -> DataFrame:
    """Cross-entropy weighted by 1 / (C * frequency), over the sum of weights."""
    w = class_weights(df, target, 2, by)
    both = df.join(w, list(by)) if by else df.crossJoin(F.broadcast(w))  # one row of weights
    weight = F.when(F.col(target) == 1, F.col("w1")).otherwise(F.col("w0"))
    nll = -F.log(F.when(F.col(target) == 1, p).otherwise(1 - p))
    return both.groupBy(*by).agg((F.sum(weight * nll) / F.sum(weight)).alias("balanced_ce"))


def smoothed_jaccard_dice(df: DataFrame, p: Column, y: Column, by: tuple = (), eps: float = 1.0) -> DataFrame:
    s = df.groupBy(*by).agg(F.sum(p * y).alias("tp"), F.sum(p).alias("sp"), F.sum(y).alias("sy"))
    tp, both = F.col("tp"), F.col("sp") + F.col("sy")
    j, d = 1 - (tp + eps) / (both - tp + eps), 1 - (2 * tp + eps) / (both + eps)
    return s.select(*by, j.alias("jaccard_loss"), d.alias("dice_loss"), (0.5 * j + d).alias("combined"))
