"""Queries over masks, objects, ensembles, tiles, scores, polygons and resampling."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators.graph import cut, shared_dir
from ..operators.tree import component_curves
from ..operators import bands as B, chunks as C, ensemble as E, instances as I, morphology as MO, resample as RS, rings as RG, runs as R, tiling as T, vector as V, warp as WA
from ..sources import store
from . import fixtures as X
from .fixtures import labels_sql, views
from .scenes import r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


K = ["scene_id"]

# ------------------------------------------------------------------ runs and components


@query(views("px", more="f as (select *, x-row_number() over (partition by scene_id, y order by x) g from px where v>=0.06)") + "select scene_id, y, min(x) x0, max(x) x1 from f group by scene_id, y, g")
def mask_runs(s, d):
    return R.to_runs(X.px(s, d), B.above(F.col("v"), 0.06), K)


_CC = labels_sql("lab", "select scene_id g, y, x from px where v>=0.06")


@query(views("px", more=_CC, recursive=True) + "select g scene_id, label, count(*) area, min(y) y_min, max(y) y_max, min(x) x_min, max(x) x_max from lab group by 1,2")
def component_table(s, d):
    lab = R.components(R.to_runs(X.px(s, d), B.above(F.col("v"), 0.06), K), K, 64)
    return R.component_stats(lab, K)


@query(views("px", more=labels_sql("lab", "select scene_id g, y, x from px where v>=0.06", False), recursive=True) + "select g scene_id, label, count(*) area from lab group by 1,2 having count(*)>=4")
def objects_over_minimum_size(s, d):
    lab = R.components(R.to_runs(X.px(s, d), B.above(F.col("v"), 0.06), K), K, 64, connectivity=4)
    return R.component_stats(R.remove_small(lab, K, 4), K).select("scene_id", "label", "area")


@query(views("px", more=_CC + ", hit as (select distinct g, label from lab where (y*64+x)%97=0)", recursive=True) + "select g scene_id, label, count(*) area from lab where (g, label) not in (select (g, label) from hit) group by 1,2")
def objects_off_keep_out(s, d):
    px = X.px(s, d)
    lab = R.components(R.to_runs(px, B.above(F.col("v"), 0.06), K), K, 64)
    out = R.drop_touching(lab, R.to_runs(px, (F.col("y") * 64 + F.col("x")) % 97 == 0, K), K)
    return R.component_stats(out, K).select("scene_id", "label", "area")


@query(views("px", "hs", more="s as (select scene_id, y, x, v from px where v>=0.2), dd as (select * from range(-3,4) p(dy), range(-3,4) q(dx) where dy*dy+dx*dx<=9)") + "select distinct scene_id, y+dy y, x+dx x from s, dd where y+dy between 0 and 63 and x+dx between 0 and 63")
def disk_dilation(s, d):
    runs = R.dilate_disk(R.to_runs(X.px(s, d), B.above(F.col("v"), 0.2), K), K, 3, 64, 64)
    return R.runs_to_pixels(runs).select("scene_id", "y", "x")


@query(views("px", "hs") + "select scene_id, count(*) n from px join hs using(scene_id) where y<2 or x<2 or y>=height-2 or x>=62 group by 1")
def edge_band(s, d):
    df = X.dense(s, d).where(R.on_edge(F.col("y"), F.col("x"), F.col("height"), F.col("width"), 2))
    return df.groupBy("scene_id").agg(F.count("*").alias("n"))


_NB = "nb as (select a.scene_id, a.y, a.x, a.v, count(*) filter (b.v>=0.0) n from px a join px b on a.scene_id=b.scene_id and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1 group by all)"


@query(views("px", more=_NB) + "select scene_id, y, x, (v>=0.0)::int m, (v>=0.0 and n=9)::int eroded, ((v>=0.0) and n<9)::int boundary from nb")
def erosion_and_boundary(s, d):
    df = X.dense(s, d, 0.0)
    df = MO.erode_square(df, "m", K, 1, F.col("height"), F.col("width"))
    return df.select("scene_id", "y", "x", "m", "eroded", (F.col("m") - F.col("eroded")).alias("boundary"))


@query(views("px") + "select a.scene_id, a.y, a.x, round(avg(b.v),6) focal_mean from px a join px b on a.scene_id=b.scene_id and (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)<=9 group by all")
def focal_mean(s, d):
    out = C.focal_mean(X.chunks(s, d), K, "v", 3, size=32)
    return C.to_pixels(out, K, ["focal_mean"]).select("scene_id", "y", "x", *r6("focal_mean"))


@query(views("px", more="m as (select a.scene_id, a.y, a.x, any_value(a.v) v, avg(b.v) f from px a join px b on a.scene_id=b.scene_id and (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)<=4 group by a.scene_id, a.y, a.x)") + "select scene_id, y, x, trunc(round((v-f+30)*300,6))::int rel from m")
def relative_elevation_of_disk(s, d):
    """Against the mean of the disk around each pixel."""
    v = X.chunks(s, d)
    both = v.join(C.focal_mean(v, K, "v", 2, size=32).select("scene_id", "cy", "cx", "focal_mean"), ["scene_id", "cy", "cx"])
    px = C.to_pixels(both, K, ["v", "focal_mean"])
    return px.select("scene_id", "y", "x", B.relative_elevation(F.col("v"), F.col("focal_mean"), 6).cast("int").alias("rel"))


@query(views("px", more="w as (select scene_id, y, x, v, lag(v) over a xa, lead(v) over a xb, lag(v) over b ya, lead(v) over b yb from px window a as (partition by scene_id, y order by x), b as (partition by scene_id, x order by y)), g as (select scene_id, y, x, (coalesce(xb,v)-coalesce(xa,v))/case when xa is null or xb is null then 1 else 2 end gx, (coalesce(yb,v)-coalesce(ya,v))/case when ya is null or yb is null then 1 else 2 end gy from w)") + "select scene_id, y, x, round(degrees(atan(sqrt(gx*gx+gy*gy))),6) slope from g")
def terrain_slope(s, d):
    return MO.slope(X.px(s, d), "v", K).select("scene_id", "y", "x", *r6("slope"))


@query(views("px", more="o as (select a.scene_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) d from px a join px b on a.scene_id=b.scene_id and abs(a.y-b.y)<=4 and abs(a.x-b.x)<=4 and (a.v>=0.1)<>(b.v>=0.1) group by all)") + "select scene_id, y, x, round(case when v>=0.1 then 1 else -1 end*sqrt(least(coalesce(d,16),16))/4,6) distance from px left join o using(scene_id,y,x)")
def signed_distance(s, d):
    return _distance(s, d, 0.1, 4)


def _distance(s, d, t, far):
    """Of the pixels of v >= t."""
    mask = X.chunks(s, d).withColumn("m", F.transform("v", lambda v: (v >= t).cast("double")))
    out = C.signed_distance(mask, K, "m", far, size=32)
    return C.to_pixels(out, K, ["distance"]).select("scene_id", "y", "x", *r6("distance"))


@query(views("px", more="q as (select scene_id, y, x, v from px where v>=0.24), o as (select a.scene_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) d from px a join q b on a.scene_id=b.scene_id where a.v<0.24 group by all), u as (select a.scene_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) d from q a join px b on a.scene_id=b.scene_id and b.v<0.24 and abs(a.y-b.y)<=9 and abs(a.x-b.x)<=9 group by all)") + "select scene_id, y, x, round(case when v>=0.24 then 1 else -1 end*sqrt(least(coalesce(o.d,u.d,4096),4096))/64,6) distance from px left join o using(scene_id,y,x) left join u using(scene_id,y,x)")
def far_signed_distance(s, d):
    """Up to 64 pixels from few set pixels, over several chunks."""
    return _distance(s, d, 0.24, 64)


@query(views("px", "hs", more="g as (select scene_id, y, x, r.half, r.dy from px, (select dy, floor(sqrt(400-dy*dy))::int half from range(-20,21) t(dy)) r), cs as (select scene_id, y, x, sum(v) over (partition by scene_id, y order by x) c from px), m as (select g.scene_id, g.y, g.x, sum(e.c-coalesce(f.c,0)) s, sum(least(g.x+half,63)-greatest(g.x-half,0)+1) n from g join cs e on e.scene_id=g.scene_id and e.y=g.y+dy and e.x=least(g.x+half,63) left join cs f on f.scene_id=g.scene_id and f.y=g.y+dy and f.x=g.x-half-1 group by all)") + "select scene_id, y, x, round(s/n,6) wide_mean from m")
def wide_focal_mean(s, d):
    """A disk of 20 pixels, so that windows reach over several chunks."""
    out = C.focal_mean(X.chunks(s, d, 16), K, "v", 20, "wide_mean", size=16)
    return C.to_pixels(out, K, ["wide_mean"]).select("scene_id", "y", "x", *r6("wide_mean"))


# ------------------------------------------------------------------ object metrics: objects of v >= 0.06 against those of v >= 0.08

_TWO = labels_sql("ta", "select scene_id g, y, x from px where v>=0.06") + ",\n" + labels_sql("pa", "select scene_id g, y, x from px where v>=0.08") + """,
pr as (select g, ta.label t, pa.label p, count(*) c from ta join pa using(g,y,x) group by all),
aa as (select g, label t, count(*) a from ta group by 1,2), bb as (select g, label p, count(*) b from pa group by 1,2),
iou as (select g, t, p, c/(a+b-c) i from pr join aa using(g,t) join bb using(g,p)),
mt as (select distinct scene_id g from px),
m as (select g, (select count(*) from iou where iou.g=mt.g and i>=0.5) tp, (select count(distinct p) from bb where bb.g=mt.g) np, (select count(distinct t) from aa where aa.g=mt.g) nt from mt)"""


def _matches(s, d, **how):
    return I.match_pixels(X.px(s, d).withColumn("target", (F.col("v") >= 0.06).cast("int")).withColumn("score", F.when(F.col("v") >= 0.08, 1.0).otherwise(0.0)), K, 64, **how)


@query(views("px", more=_TWO, recursive=True) + "select g scene_id, tp, np-tp fp, nt-tp fn from m")
def instance_matching(s, d):
    return _matches(s, d)


@query(views("px", more=_TWO + ", z as (select sum(tp)::double tp, sum(np-tp)::double fp, sum(nt-tp)::double fn from m)", recursive=True) + "select tp::bigint tp, fp::bigint fp, fn::bigint fn, round(tp/(tp+fp),6) \"precision\", round(tp/(tp+fn),6) recall, round(tp/(tp+fp+fn),6) accuracy, round(2*tp/(2*tp+fp+fn),6) f_beta, round(fp/(tp+fp+fn),6) n01, round(tp/(tp+fp+fn),6) n11 from z")
def instance_scores(s, d):
    m = I.instance_scores(_matches(s, d))
    # the normalised confusion of the same sums
    n = F.col("tp") + F.col("fp") + F.col("fn")
    return m.withColumn("n01", F.col("fp") / n).withColumn("n11", F.col("tp") / n).select("tp", "fp", "fn", *r6("precision", "recall", "accuracy", "f_beta", "n01", "n11"))


@query(views("px", more=_TWO + ", z as (select sum(tp)::double tp, sum(np-tp)::double fp, sum(nt-tp)::double fn from m)", recursive=True) + "select 0.0::double n00, round(fp/(tp+fp+fn),6) n01, round(fn/(tp+fp+fn),6) n10, round(tp/(tp+fp+fn),6) n11 from z")
def instance_confusion(s, d):
    return I.instance_confusion(_matches(s, d), True).select("n00", *r6("n01", "n10", "n11"))


_WIDTH = "kw as (select scene_id, greatest(1, round_even(0.02*sqrt(height*height+64*64), 0))::int k from hs)"


def _edges_sql(lab: str, name: str) -> str:
    return f", {name} as materialized (select a.g, a.y, a.x, a.label from {lab} a join kw on kw.scene_id=a.g join {lab} b on a.g=b.g and a.label=b.label and abs(a.y-b.y)<=k and abs(a.x-b.x)<=k group by a.g, a.y, a.x, a.label, k having count(*)<(2*k+1)*(2*k+1))"


_BY_EDGE = ", " + _WIDTH + _edges_sql("ta", "te") + _edges_sql("pa", "pe") + """,
er as (select g, te.label t, pe.label p, count(*) c from te join pe using(g,y,x) group by all),
ea as (select g, label t, count(*) a from te group by 1,2), eb as (select g, label p, count(*) b from pe group by 1,2),
ei as (select g, t, p, c/(a+b-c) j from er join ea using(g,t) join eb using(g,p)),
mb as (select g, (select count(*) from iou left join ei using(g,t,p) where iou.g=mt.g and least(i, coalesce(j,0))>=0.5) tp, (select count(distinct p) from bb where bb.g=mt.g) np, (select count(distinct t) from aa where aa.g=mt.g) nt from mt)"""


@query(views("px", "hs", more=_TWO + _BY_EDGE, recursive=True) + "select g scene_id, tp, np-tp fp, nt-tp fn from mb")
def instance_matching_by_boundary(s, d):
    """Boundaries of the default width, 0.02 of each scene's own diagonal."""
    return _matches(s, d, metric="boundary", images=X.scenes(s, d).withColumn("width", F.lit(64)))


_T3 = "th as (select unnest([0.06::double, 0.08, 0.1]) t), " + labels_sql("ta", "select scene_id g, y, x from px where v>=0.06") + ",\n" + labels_sql("pa", "select struct_pack(s := scene_id, t := t) g, y, x from px, th where v>=t") + """,
aa as (select g, label t, count(*) a from ta group by 1,2), bb as (select g, label p, count(*) b from pa group by 1,2),
pr as (select pa.g, ta.label t, pa.label p, count(*) c from pa join ta on ta.g=pa.g.s and ta.y=pa.y and ta.x=pa.x group by all),
io as (select pr.g.t th, c/(a+b-c) i from pr join aa on aa.g=pr.g.s and aa.t=pr.t join bb on bb.g=pr.g and bb.p=pr.p),
cv as (select t threshold, (select count(*) from io where io.th=th.t and i>=0.5)::double tp, (select count(*) from bb where bb.g.t=th.t)::double np, (select count(*) from aa)::double nt from th),
c2 as (select threshold, tp, np-tp fp, nt-tp fn, case when np>0 then tp/np else 0 end pr, case when nt>0 then tp/nt else 0 end rc from cv)"""


def _curve(s, d, least=0.06, thresholds=(0.06, 0.08, 0.1)):
    both = X.chunks(s, d).withColumn("target", F.transform("v", lambda v: (v >= least).cast("double")))
    return I.instance_pr_curve(both, K, 64, list(thresholds), score="v", size=32)


_HUNDRED = [round(0.18 + 0.001 * k, 3) for k in range(100)]


@query(views("px", more=_T3.replace("select unnest([0.06::double, 0.08, 0.1]) t", "select round(0.18+0.001*i, 3)::double t from range(0,100) r(i)").replace("v>=0.06", "v>=0.2"), recursive=True) + "select threshold, tp::bigint tp, fp::bigint fp, fn::bigint fn from c2")
def instance_curve_of_hundred(s, d):
    """A hundred thresholds from one tree."""
    return _curve(s, d, 0.2, _HUNDRED).select("threshold", "tp", "fp", "fn")


@query(views("px", more="th as (select unnest([0.05::double, 0.07, 0.09, 0.11]) t), " + labels_sql("pa", "select struct_pack(s := scene_id, t := t) g, y, x from px, th where v>=t", False) + ", bb as (select g, label, count(*) n from pa group by all)", recursive=True) + "select g.s scene_id, g.t threshold, count(*) objects from bb where n>=3 group by all")
def objects_by_threshold(s, d):
    """Objects of at least three pixels (4-connected) at several thresholds, from one tree."""
    out = component_curves(X.chunks(s, d, 16), K, "v", [0.05, 0.07, 0.09, 0.11], min_size=3, connectivity=4, size=16)
    return out.select("scene_id", "threshold", "objects").where("objects > 0")


@query(views("px", more=_T3, recursive=True) + 'select threshold, tp::bigint tp, fp::bigint fp, fn::bigint fn, round(pr,6) "precision", round(rc,6) recall from c2')
def instance_pr_curve(s, d):
    return _curve(s, d).select("threshold", "tp", "fp", "fn", *r6("precision", "recall"))


@query(views("px", more=_T3 + ", c3 as (select pr, rc-lead(rc,1,0.0) over (order by threshold) d from c2)", recursive=True) + "select round(sum(pr*d),6) average_precision from c3")
def instance_average_precision(s, d):
    return I.instance_average_precision(_curve(s, d)).select(*r6("average_precision"))


@query(views("px", more="nb as (select a.scene_id, a.y, a.x, a.v, count(*) filter (b.v>=0.0) n, count(*) filter (b.v>=0.02) k from px a join px b on a.scene_id=b.scene_id and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1 group by all), e as (select scene_id, (v>=0.0 and n<9)::int t, (v>=0.02 and k<9)::int p from nb)") + "select scene_id, sum(t*p)::bigint common, sum(greatest(t,p))::bigint either, round(sum(t*p)/sum(greatest(t,p)),6) boundary_iou from e group by 1")
def boundary_iou(s, d):
    df = X.dense(s, d, 0.0).withColumn("pred", (F.col("v") >= 0.02).cast("int"))
    return I.boundary_iou(df, K, 1, F.col("height"), F.col("width"), "pred", "m", ("scene_id",)).select("scene_id", "common", "either", *r6("boundary_iou"))


@query(views("px", "hs", more=_WIDTH + ", nb as (select a.scene_id, a.y, a.x, a.v, (2*k+1)*(2*k+1) s, count(*) filter (b.v>=-0.1) n, count(*) filter (b.v>=-0.09) m from px a join kw using(scene_id) join px b on a.scene_id=b.scene_id and abs(a.y-b.y)<=k and abs(a.x-b.x)<=k group by all), e as (select scene_id, (v>=-0.1 and n<s)::int t, (v>=-0.09 and m<s)::int p from nb)") + "select scene_id, sum(t*p)::bigint common, sum(greatest(t,p))::bigint either, round(sum(t*p)/sum(greatest(t,p)),6) boundary_iou from e group by 1")
def boundary_iou_by_diagonal(s, d):
    """The width is 0.02 of each scene's own diagonal."""
    df = X.dense(s, d, -0.1).withColumn("pred", (F.col("v") >= -0.09).cast("int"))
    return I.boundary_iou(df, K, 0.02, F.col("height"), F.col("width"), "pred", "m", ("scene_id",)).select("scene_id", "common", "either", *r6("boundary_iou"))


# ------------------------------------------------------------------ ensembles


def _models(s, d):
    p = X.prob(s, d)
    nan = lambda c: F.when(F.col("nod"), float("nan")).otherwise(F.col(c))
    return p.select("scene_id", "y", "x", F.explode(F.array(F.struct(F.lit("m1").alias("model"), nan("p1").alias("p")), F.struct(F.lit("m2").alias("model"), nan("p2").alias("p")))).alias("q")).select("scene_id", "y", "x", "q.*")


@query(views("prob") + "select t threshold, 'class_'||replace(t::varchar,'.','') threshold_label, scene_id, count(*) n, round(sum((p1+p2)/2),6) total from prob, (values (0.4::double),(0.45),(0.5)) r(t) where not nod and (p1+p2)/2>=t group by 1,2,3")
def threshold_ensemble(s, d):
    from ..functions.names import threshold_label

    m = E.by_threshold(E.ensemble_mean(_models(s, d), K, ["m1", "m2"]), [0.4, 0.45, 0.5])
    g = m.groupBy("threshold", "scene_id").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("total"))
    return g.withColumn("threshold_label", threshold_label(F.col("threshold")))


_XT = 0.55


def _clean_sql(t: float) -> str:
    lab = labels_sql("lab", f"select scene_id g, y, x from prob where not nod and (p1+p2)/2>={t}")
    return lab + """,
bad as (select distinct l.g, l.label from lab l join hs on hs.scene_id=l.g where l.y<2 or l.x<2 or l.y>=height-2 or l.x>=62 union select distinct l.g, l.label from lab l join prob n on n.scene_id=l.g and n.nod and (n.y-l.y)*(n.y-l.y)+(n.x-l.x)*(n.x-l.x)<=9),
kept as (select * from lab where (g, label) not in (select (g, label) from bad)),
""" + labels_sql("lb2", "select g, y, x from kept", False)


@query(views("px", "hs", "prob", more=_clean_sql(_XT), recursive=True) + "select g scene_id, 0.55::double threshold, label, count(*) area, min(y) y_min, max(y) y_max, min(x) x_min, max(x) x_max from lb2 group by g, label having count(*)>=4")
def clean_ensemble_objects(s, d):
    """The flagship: mean of two models, objects, without those at nodata, edges or under the minimum size."""
    mean = cut(E.ensemble_mean(_models(s, d), K, ["m1", "m2"]))
    objects = E.ensemble_clean(mean, K, 64, F.col("height"), F.lit(64), (_XT,), border=2, min_size=4, scenes=X.scenes(s, d), disk=3)
    return E.object_table(objects, ["scene_id", "threshold"])


def _with_nan(s, d):
    """p1 and p2, NaN at nodata pixels."""
    return X.prob(s, d).withColumns({c: F.when(F.col("nod"), float("nan")).otherwise(F.col(c)) for c in ("p1", "p2")})


@query(views("prob") + "select scene_id, y, x, case when not nod then round((p1+p2)/2*(p2<0.6)::int,6) end p from prob")
def negative_class_ensemble(s, d):
    p = E.ensemble_negative(_with_nan(s, d), K, "p2", 0.6)
    return p.select("scene_id", "y", "x", F.round(F.nullif(F.col("p"), F.lit(float("nan"))), 6).alias("p"))


@query(views("prob", "hs", more="n as (select distinct p.scene_id, p.y, p.x from prob p join prob m on m.nod and m.scene_id=p.scene_id and (m.y-p.y)*(m.y-p.y)+(m.x-p.x)*(m.x-p.x)<=4)") + "select scene_id, count(*) n, round(sum(case when p2<0.6 then (p1+p2)/2 else 0 end),4) total from prob join hs using(scene_id) where (scene_id, y, x) not in (select (scene_id, y, x) from n) and y>=2 and x>=2 and y<height-2 and x<62 group by 1")
def eroded_negative_ensemble(s, d):
    """The valid area shrinks by two pixels from nodata and from the edge."""
    p = E.ensemble_negative(_with_nan(s, d).join(X.scenes(s, d), "scene_id"), K, "p2", 0.6, erode=2, height=F.col("height"), width=F.lit(64))
    return p.where(~F.isnan("p")).groupBy("scene_id").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("total"))


@query(views("prob", "hs", more="q as (select *, (y*64+x)%991=5 nan2 from prob), n as (select distinct p.scene_id, p.y, p.x from q p join q m on m.nod and m.scene_id=p.scene_id and (m.y-p.y)*(m.y-p.y)+(m.x-p.x)*(m.x-p.x)<=4)") + "select t threshold, scene_id, count(*) n, round(sum((p1+p2)/2),4) total from q join hs using(scene_id), (values (0.4::double),(0.5)) r(t) where not nan2 and p2<0.6 and (p1+p2)/2>=t and (scene_id, y, x) not in (select (scene_id, y, x) from n) and y>=2 and x>=2 and y<height-2 and x<62 group by 1,2")
def negative_ensemble_thresholds(s, d):
    """Only what the first model lacks is widened; the second one lacks pixels of its own."""
    p = _with_nan(s, d).withColumn("p2", F.when((F.col("y") * 64 + F.col("x")) % 991 == 5, float("nan")).otherwise(F.col("p2"))).join(X.scenes(s, d), "scene_id")
    out = E.ensemble_negative(p, K, "p2", 0.6, erode=2, height=F.col("height"), width=F.lit(64), thresholds=[0.4, 0.5])
    return out.groupBy("threshold", "scene_id").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("total"))


# ------------------------------------------------------------------ tiles and patches

_TL = "t as (select scene_id, r.i \"row\", c.i col, y, x, v from px, range(0,3) r(i), range(0,3) c(i) where y between r.i*20 and r.i*20+23 and x between c.i*20 and c.i*20+23), ts as (select scene_id, \"row\", col, max(y-\"row\"*20)+1 h, max(x-col*20)+1 w, avg((v<-0.1)::int) nodata from t group by 1,2,3)"


@query(views("px", more=_TL.replace("range(0,3)", "range(0,4)")) + "select scene_id, \"row\", col, h, w, round(nodata,6) nodata from ts where h=24 and w=24 and nodata<=0.25")
def tiles(s, d):
    t = T.retile(X.px(s, d), (24, 24), 4)
    return T.tile_filter(T.tile_stats(t, K, F.col("v") < -0.1), (24, 24), 0.25).select("scene_id", "row", "col", "h", "w", *r6("nodata"))


@query(views("px", "hs", more="o as (select scene_id, a.i*8 y_i, b.i*8 x_i from hs, range(0,8) a(i), range(0,8) b(i) where a.i*8<height-16 and b.i*8<48)") + "select scene_id, y_i::int y_i, x_i::int x_i, count(*) n, round(avg((v<-0.1)::int),6) nodata from o join px using(scene_id) where y>=y_i and y<y_i+16 and x>=x_i and x<x_i+16 group by 1,2,3 having avg((v<-0.1)::int)<=0.22")
def patches(s, d):
    df = X.dense(s, d)
    o = T.patch_origins(df.select("scene_id", "height", "width").distinct(), 16)
    return T.patches(X.px(s, d), K, o, 16, F.col("v") < -0.1, 0.22).select("scene_id", "y_i", "x_i", "n", *r6("nodata"))


@query(views("tile", more="i as (select *, row_number() over (partition by scene_id order by vec_id)-1 tile_idx from tile)") + "select scene_id, tile_idx::int tile_idx, vec_id, tile_idx::int//4 batch_id from i where list_max(mask)>0")
def positive_tile_batches(s, d):
    t = T.dense_index(X.tile(s, d), "scene_id", ["vec_id"])
    return T.positive_tiles(T.batches(t, 4, ["vec_id"])).select("scene_id", "tile_idx", "vec_id", "batch_id")


@query(views("tile", more="i as (select *, row_number() over (partition by scene_id order by vec_id)-1 tile_idx from tile)") + "select scene_id, tile_idx::int tile_idx, vec_id, scene_id||'-'||tile_idx tile_name from i where (scene_id=1 and tile_idx in (0,3)) or (scene_id=2 and tile_idx=5)")
def picked_tiles(s, d):
    t = T.dense_index(X.tile(s, d), "scene_id", ["vec_id"])
    return T.pick_tiles(t, {1: [0, 3], 2: [5]}).select("scene_id", "tile_idx", "vec_id", "tile_name")


@query(views("tile") + "select vec_id, list_sum(img)::double total, list_sum(mask)::bigint positives from tile".replace("list_sum(img)::double total", "round(list_sum(img::double[]),6) total"))
def aligned_parts(s, d):
    t = X.tile(s, d).withColumn("file_name", F.concat(F.col("vec_id").cast("string"), F.lit(".pt")))
    a = T.align_parts([t.select("file_name", "vec_id", "img"), t.select("file_name", "mask")])
    return a.select("vec_id", F.round(F.aggregate("img", F.lit(0.0), lambda x, v: x + v), 6).alias("total"), F.aggregate("mask", F.lit(0).cast("long"), lambda x, v: x + v).alias("positives"))


@query(views("tile", more="o as (select vec_id, img, op, op%2 fx, (op//2)%2 fy, op//4 tr from tile, range(0,8) r(op)), e as (select vec_id, op, y*8+x i, case when fy=1 then 7-y else y end a, case when fx=1 then 7-x else x end b, tr, img from o, range(0,8) p(y), range(0,8) q(x))") + "select vec_id, op::int op, round(sum((i+1)*img[case when tr=1 then b*8+a else a*8+b end+1]::double),5) digest from e group by 1,2")
def dihedral_tiles(s, d):
    t = T.dihedral(X.tile(s, d).select("vec_id", "img"), "img", 8)
    digest = F.aggregate(F.transform("img", lambda v, i: (i + 1) * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return t.select("vec_id", "op", F.round(digest, 5).alias("digest"))


@query(views("tile", more="a as (select vec_id, list_reverse(img) slope from tile)") + "select scene_id, (vec_id//8)::int \"row\", (vec_id%8)::int col, round(img[1]::double,6) \"first\", round(slope[1]::double,6) \"second\" from tile join a using(vec_id)")
def tile_sources(s, d):
    """Tiles and a second source of the same scene, row and column."""
    t = X.tile(s, d).withColumn("row", F.expr("cast(vec_id div 8 as int)")).withColumn("col", (F.col("vec_id") % 8).cast("int"))
    aux = t.select("scene_id", "row", "col", F.reverse("img").alias("slope"))
    both = T.join_sources(t, {"slope": aux})
    return both.select("scene_id", "row", "col", *[F.round(F.get(c, F.lit(0)).cast("double"), 6).alias(n) for c, n in (("img", "first"), ("slope", "second"))])


@query(views("tile", more="n as (select scene_id, count(*) n, round(sum(list_sum(list_transform(img, lambda v: v::double))),4) total from tile group by 1)") + "select scene_id, n, ceil(n/4)::bigint n_batches, least(n,4) largest, total from n")
def tile_set_batches(s, d):
    """Tiles of two parts as one set in shuffled batches of four: what is in each scene's batches."""
    t = X.tile(s, d)
    b = T.tile_dataset([t.where("vec_id % 2 = 0"), t.where("vec_id % 2 = 1")], 4, ["vec_id"], lambda x: x.withColumn("total", F.aggregate("img", F.lit(0.0), lambda a, v: a + v)), shuffle=True)
    per = b.groupBy("scene_id", "batch_id").agg(F.count("*").alias("size"), F.sum("total").alias("total"))
    return per.groupBy("scene_id").agg(F.sum("size").alias("n"), F.count("*").alias("n_batches"), F.max("size").alias("largest"), F.round(F.sum("total"), 4).alias("total"))


_AUGMENT = ["HorizontalFlip", "VerticalFlip", "Blur", "RandomRotate90", "RandomBrightnessContrast", "MultiplicativeNoise"]


def _augment_sql() -> str:
    """One clause for each operation, in which r is its number."""
    turns = {"HorizontalFlip": ("false", "r<0.5", "false"), "VerticalFlip": ("r<0.5", "false", "false"), "RandomRotate90": ("r>=0.25 and r<0.75", "r>=0.5", "(r>=0.25 and r<0.5) or r>=0.75")}
    values = {"RandomBrightnessContrast": "v*(0.8::double+0.4::double*r)+0.2::double*(r-0.5::double)", "MultiplicativeNoise": "v*(0.9::double+0.2::double*r)"}
    turn = "list_transform(range(0,64), lambda i: {0}[case when tr then (case when fx then 7-i%8 else i%8 end)*8+(case when fy then 7-i//8 else i//8 end) else (case when fy then 7-i//8 else i//8 end)*8+(case when fx then 7-i%8 else i%8 end) end+1])"
    near = lambda a, b: f"img[(case when i//8+{a}<0 then 1 when i//8+{a}>7 then 6 else i//8+{a} end)*8+(case when i%8+{b}<0 then 1 when i%8+{b}>7 then 6 else i%8+{b} end)+1]"
    out, last = [], "tile, range(0,8) c(copy)"
    for k, name in enumerate(_AUGMENT):
        drawn = f"('0x'||md5(vec_id||':'||copy||':{name}:0')[1:8])::bigint/4294967296.0::double r"
        if name in turns:
            fy, fx, tr = turns[name]
            img, mask = turn.format("img"), turn.format("mask")
            out.append(f"a{k} as materialized (select scene_id, vec_id, copy, {img} img, {mask} mask from (select *, {fy} fy, {fx} fx, {tr} tr from (select scene_id, vec_id, copy, img, mask, {drawn} from {last})))")
        else:
            blur = "list_transform(range(0,64), lambda i: ((" + "+".join(near(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)) + ")::double/9)::float)"
            img = blur if name == "Blur" else f"list_transform(img, lambda v: ({values[name]})::float)"
            out.append(f"a{k} as materialized (select scene_id, vec_id, copy, {img} img, mask from (select scene_id, vec_id, copy, img, mask, {drawn} from {last}))")
        last = f"a{k}"
    return ",\n".join(out)


@query(views("tile", more=_augment_sql()) + "select scene_id, vec_id, copy::int copy, list_transform(img, lambda v: round(v::double,5)) img, mask from a5")
def augmented_tiles(s, d):
    t = T.augment(X.tile(s, d), _AUGMENT, 8, ["vec_id"])
    # without its sign, as round() makes 0.0 of a small negative number where the SQL keeps -0.0
    rounded = lambda v: F.signum(v) * F.round(F.abs(v), 5)
    return t.select("scene_id", "vec_id", "copy", F.transform("img", lambda v: rounded(v.cast("double"))).alias("img"), "mask")


# ------------------------------------------------------------------ scoring

_BL = """st as (select scene_id, height, least(a.i*12, height-16) y0, least(b.i*12, 48) x0 from hs, range(0,6) a(i), range(0,6) b(i) where a.i*12<height and b.i*12<64),
bw as (select st.scene_id, y, x, 1/(1+exp(-v)) s, least(1.0::double, (y-y0)/3.0::double, (15-y+y0)/3.0::double)*least(1.0::double, (x-x0)/3.0::double, (15-x+x0)/3.0::double) w from st join px on px.scene_id=st.scene_id and y>=y0 and y<y0+16 and x>=x0 and x<x0+16),
bs as (select scene_id, y, x, case when sum(w)>0 then sum(w*s)/sum(w) else 0 end p from bw group by 1,2,3)"""


@query(views("px", "hs", more=_BL) + "select scene_id, y, x, round(p,6) p from bs")
def blended_scores(s, d):
    out = C.score_patches(X.chunks(s, d), K, ["v"], lambda a: 1 / (1 + np.exp(-a[0])), 16, 4, size=32)
    return C.to_pixels(out, K, ["p"]).select("scene_id", "y", "x", *r6("p"))


def _mean_of_nine(a: np.ndarray) -> np.ndarray:
    """A model that looks at neighbours, 0 outside the patch."""
    b = np.pad(a[0], 1)
    return sum(b[i : i + a.shape[1], j : j + a.shape[2]] for i in range(3) for j in range(3)) / 9 * 40


def _scored_by_nine(s, d):
    """v in tenths over a factor of 0.1, NaN for every 29th pixel, zero for every 31st (nodata)."""
    at = lambda v, i: (F.col("y0") + F.floor(i / F.col("w"))) * 64 + F.col("x0") + i % F.col("w")
    px = F.transform("v", lambda v, i: F.when(at(v, i) % 31 == 0, 0.0).when(at(v, i) % 29 == 0, float("nan")).otherwise(v / 10))
    return C.score_scenes(X.chunks(s, d).withColumn("v", px), K, {"v": 0.1}, _mean_of_nine, 16, 4, size=32, decimals=9)


_NINE = """st as (select scene_id, height, a.i pi, b.i pj, least(a.i*12, height-16) y0, least(b.i*12, 48) x0 from hs, range(0,6) a(i), range(0,6) b(i) where a.i*12<height and b.i*12<64),
vv as (select scene_id, y, x, case when (y*64+x)%31=0 or (y*64+x)%29=0 then 0 else v end v from px),
nn as (select st.scene_id, pi, pj, y0, x0, a.y, a.x, sum(b.v)/9*40 s from st join vv a on a.scene_id=st.scene_id and a.y>=y0 and a.y<y0+16 and a.x>=x0 and a.x<x0+16 join (select -1 dy union all select 0 union all select 1) e on true join (select -1 dx union all select 0 union all select 1) f on true join vv b on b.scene_id=a.scene_id and b.y=a.y+dy and b.x=a.x+dx and b.y>=y0 and b.y<y0+16 and b.x>=x0 and b.x<x0+16 group by all),
nw as (select scene_id, y, x, 1/(1+exp(-s)) s, least(1.0::double, (y-y0)/3.0::double, (15-y+y0)/3.0::double)*least(1.0::double, (x-x0)/3.0::double, (15-x+x0)/3.0::double) w from nn),
np as (select scene_id, y, x, round(case when sum(w)>0 then sum(w*s)/sum(w) else 0 end,9) p from nw group by 1,2,3),
nb as (select scene_id, y, x, v, case when v<>0 then p end p, case when v=0 then 255 else (p>0.5)::int end b from np join vv using(scene_id, y, x))"""


@query(views("px", "hs", more=_NINE) + "select scene_id, y, x, p, b::int b from nb")
def patch_model_scores(s, d):
    """A model over whole patches, normalised input and nodata, as chunks all the way."""
    out = C.to_pixels(_scored_by_nine(s, d), K, ["p", "b"])
    return out.select("scene_id", "y", "x", F.nullif("p", F.lit(float("nan"))).alias("p"), F.col("b").cast("int").alias("b"))


@query(views("px", "hs", more=_BL) + "select scene_id, y, x, (case when (y*64+x)%997=0 then 255 else (round(p,9)>0.5)::int end)::int b from bs")
def scored_scenes(s, d):
    """Every 997th pixel is nodata."""
    v = F.transform("v", lambda v, i: F.when(((F.col("y0") + F.floor(i / F.col("w"))) * 64 + F.col("x0") + i % F.col("w")) % 997 == 0, 0.0).otherwise(v))
    out = C.score_scenes(X.chunks(s, d).withColumn("v", v), K, {"v": 1.0}, lambda a: a[0], 16, 4, size=32, decimals=9)
    return C.to_pixels(out, K, ["b"]).select("scene_id", "y", "x", F.col("b").cast("int").alias("b"))


@query(views("px", "hs", more=_NINE) + "select scene_id, count(*) filter (b=255) nodata, count(*) filter (b=1) ones, round(sum(p),4) total, count(*) filter (b=1)*9.0::double area from nb group by 1")
def scene_products(s, d):
    """Probability, binary and outlines of scored scenes, written and read again."""
    at = f"{shared_dir(s).rstrip('/')}/products-{uuid.uuid4().hex}"
    store.write_scene_products(cut(_scored_by_nine(s, d)), K, at, 64, 500000.0, 7600000.0, (3.0, -3.0))
    read = lambda name: s.read.parquet(f"{at}/{name}")
    none = lambda *names: [F.lit(0.0).alias(n) for n in names]
    p = read("probability").select("scene_id", F.explode("p").alias("p")).where("not isnan(p)").select("scene_id", *none("nodata", "ones"), F.col("p").alias("total"), *none("area"))
    b = read("binarized").select("scene_id", F.explode("b").alias("b")).select("scene_id", (F.col("b") == 255).cast("double").alias("nodata"), (F.col("b") == 1).cast("double").alias("ones"), *none("total", "area"))
    rings = read("polygons").select("scene_id", F.explode(RG.from_wkb(F.col("geometry"))).alias("r"))
    cross = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.get("r", i)["x"] * F.get("r", i + 1)["y"] - F.get("r", i + 1)["x"] * F.get("r", i)["y"]), F.lit(0.0), lambda a, v: a + v)
    v = rings.select("scene_id", *none("nodata", "ones", "total"), (-cross / 2).alias("area"))  # northward rows turn rings round
    each = p.unionByName(b).unionByName(v).groupBy("scene_id").agg(*[F.sum(c).alias(c) for c in ("nodata", "ones", "total", "area")])
    return each.select("scene_id", F.col("nodata").cast("long").alias("nodata"), F.col("ones").cast("long").alias("ones"), F.round("total", 4).alias("total"), F.round("area", 3).alias("area"))


# ------------------------------------------------------------------ vectors


@query(views("prob", more="th as (select t, l from (values (0.55::double,'class_055'),(0.6,'class_06'),(0.65,'class_065')) r(t,l)), " + labels_sql("lab", "select struct_pack(s := scene_id, l := l) g, y, x from prob, th where not nod and (p1+p2)/2>=t", False), recursive=True) + "select g.l threshold_label, g.s scene_id, count(distinct label) objects, count(*)::double area from lab group by all")
def threshold_vectors(s, d):
    """Outlines of an ensemble, one folder for each threshold, read again."""
    from ..functions.names import threshold_label

    k = ["scene_id", "threshold"]
    m = E.by_threshold(E.ensemble_mean(_models(s, d), K, ["m1", "m2"]), [0.55, 0.6, 0.65])
    lab = R.components(R.to_runs(m, F.lit(True), k), k, 64, 4)
    at = f"{shared_dir(s).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    store.write_outlines(RG.polygons(lab, k, band=24).withColumn("threshold_label", threshold_label(F.col("threshold"))), at, ("threshold_label",))
    back = s.read.parquet(at).withColumn("r", F.explode(RG.from_wkb(F.col("geometry"))))
    cross = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.get("r", i)["x"] * F.get("r", i + 1)["y"] - F.get("r", i + 1)["x"] * F.get("r", i)["y"]), F.lit(0.0), lambda a, v: a + v)
    return back.groupBy("threshold_label", "scene_id").agg(F.count_distinct("label").alias("objects"), F.round(F.sum(cross / 2), 3).alias("area"))


def _polygons(s, d):
    c = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, w, h = (F.col(k) for k in ("x0", "y0", "w", "h"))
    return X.tri(s, d).withColumn("rings", F.array(F.array(c(x0, y0), c(x0 + w, y0), c(x0, y0 + h), c(x0, y0))))


def _burnt(s, d):
    return V.rasterize(_polygons(s, d), K, "poly_id", "rings", "w", "h")


@query(views("tpx") + "select scene_id, poly_id, y, x from tpx")
def rasterized_polygons(s, d):
    return R.runs_to_pixels(_burnt(s, d)).select("scene_id", "poly_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query(views("tpx", "tri", more="b as (select tpx.*, w from tpx join tri using(poly_id))") + "select scene_id, y, x, max_by(w, poly_id) \"value\" from b group by 1,2,3")
def burnt_polygons(s, d):
    """The last polygon wins."""
    b = V.burn(_burnt(s, d), K, "w", "poly_id")
    return b.select("scene_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")


@query(views("tpx", "px") + "select poly_id, count(*) n, round(avg(v),6) mean from tpx join px using(scene_id, y, x) group by 1")
def zonal_means(s, d):
    return V.zonal_mean(_burnt(s, d), X.chunks(s, d), K, "poly_id", "v", 32).select("poly_id", "n", *r6("mean"))


@query(views("tpx", "px", more="w as (select scene_id, y, x, (v>0.12)::int water from px where (y*64+x)%31<>0), m as (select poly_id, avg(coalesce(water,1)) share from tpx left join w using(scene_id,y,x) group by 1)") + "select poly_id, w, h, round(share,6) share from tri join m using(poly_id) where share<=0.2".replace("tri join", "tri join"))
def water_filter(s, d):
    at = lambda i: (F.col("y0") + F.floor(i / F.col("w"))) * 64 + F.col("x0") + i % F.col("w")
    water = X.chunks(s, d).withColumn("water", F.transform("v", lambda v, i: F.when(at(i) % 31 != 0, (v > 0.12).cast("double"))))
    kept = V.filter_water(X.tri(s, d), _burnt(s, d), water, K, "poly_id", size=32)
    return kept.select("poly_id", "w", "h", F.round("_w", 6).alias("share"))


@query(views("px", more=labels_sql("lab", "select scene_id g, y, x from px where v>=0.1", False), recursive=True) + "select a.g scene_id, a.label, count(*) area, sum(4-(select count(*) from lab b where b.g=a.g and b.label=a.label and abs(a.y-b.y)+abs(a.x-b.x)=1))::bigint perimeter from lab a group by 1,2")
def polygon_areas(s, d):
    return _outlines(s, d).select("scene_id", "label", "area", "perimeter")


def _outlines(s, d, band=24):
    """Bands of few rows, so that objects reach over several."""
    lab = R.components(C.band_runs(X.chunks(s, d), K, "v", 0.1), K, 64, 4)
    return RG.polygons(lab, K, 500000.0, 7600000.0, (3.0, -3.0), band)


_QUADS = labels_sql("lab", "select scene_id g, y, x from px where v>=0.1", False) + """, c as (select g, label, y+dy cy, x+dx cx, count(*) n, min(dy*2+dx) a, max(dy*2+dx) b from lab, (select 0 dy union all select 1), (select 0 dx union all select 1) group by all),
q as (select g, label, count(*) filter (n=1) q1, count(*) filter (n=3) q3, count(*) filter (n=2 and ((a=0 and b=3) or (a=1 and b=2))) qd from c group by all)"""


@query(views("px", more=_QUADS, recursive=True) + "select g scene_id, label, q1+q3+2*qd vertices, 1-((q1-q3+2*qd)//4) holes from q")
def polygon_corners(s, d):
    """Corners and holes of each object; in SQL by counting the patterns of two by two pixels."""
    return _outlines(s, d).select("scene_id", "label", "vertices", "holes")


@query(views("px", more=labels_sql("lab", "select scene_id g, y, x from px where v>=0.1", False), recursive=True) + "select g scene_id, label, count(*)*9.0::double area, 500000.0+3*min(x)::double west, 7600000.0-3*(max(y)+1)::double south, true same from lab group by all")
def polygons_as_wkb(s, d):
    """Outlines written as well-known binary and read again: area in square metres, the lower left corner, and whether the
    rings came back as they were."""
    out = _outlines(s, d, 256).withColumn("wkb", RG.to_wkb(F.col("rings")))
    out = out.withColumn("back", RG.from_wkb(F.col("wkb")))
    cross = lambda r: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.get(r, i)["x"] * F.get(r, i + 1)["y"] - F.get(r, i + 1)["x"] * F.get(r, i)["y"]), F.lit(0.0), lambda a, v: a + v)
    area = F.abs(F.aggregate(F.transform("back", cross), F.lit(0.0), lambda a, v: a + v)) / 2
    corner = lambda c: F.array_min(F.transform(F.get("back", F.lit(0)), lambda p: p[c]))
    return out.select("scene_id", "label", F.round(area, 3).alias("area"), corner("x").alias("west"), corner("y").alias("south"), (F.col("back") == F.col("rings")).alias("same"))


@query()
def polygons(s, d):
    out = V.polygonize(R.to_runs(X.px(s, d), B.above(F.col("v"), 0.1), K), K, 64, 4, 500000.0, 7600000.0, (3.0, -3.0))
    return out.select("scene_id", "label", "DN", F.to_json("rings").alias("rings"))


@query(views("tri") + "select poly_id, 0.0::double dx, 0.0::double dy from tri")
def utm_round_trip(s, d):
    """Vertices to longitude and latitude and back, in metres to two decimals."""
    v = X.tri(s, d).select("poly_id", (F.col("x0") * 8000.0 + 300000).alias("x"), (F.col("y0") * 20000.0 + 6500000).alias("y"))
    g = V.reproject(v, 32608)
    x, y = V.lonlat_to_utm(F.col("lon"), F.col("lat"), F.lit(8))
    return g.select("poly_id", F.round(F.abs(x - F.col("x")), 2).alias("dx"), F.round(F.abs(y - F.col("y")), 2).alias("dy"))


@query(views("tri") + "select poly_id, (x0*3-5)::double \"left\", (y0-h*3-5)::double bottom, (x0*3+w*3+5)::double \"right\", (y0+5)::double top from tri where poly_id%10<>0")
def scene_bounds(s, d):
    geo = F.struct((F.col("x0") * 3.0).alias("x0"), F.col("y0").cast("double").alias("y0"), F.lit(3.0).alias("xres"), F.lit(-3.0).alias("yres"), F.col("w").alias("width"), F.col("h").alias("height"), F.when(F.col("poly_id") % 10 != 0, 32608).alias("epsg"))
    t = X.tri(s, d).withColumn("geo", geo).where("geo.epsg is not null")
    return t.select("poly_id", V.bounds(F.col("geo"), 5.0).alias("b")).select("poly_id", "b.*")


_POLAR = "p as (select poly_id, x0*9000.0-200000 x, y0*8000.0-900000 y, w, h from tri), e as (select *, 6378137.0 a, 1/298.257223563::double*(2-1/298.257223563::double) e2, radians(70) c from p), k as (select *, sqrt(e2) ec, a*(cos(c)/sqrt(1-e2*sin(c)**2))/(tan(pi()/4-c/2)/((1-sqrt(e2)*sin(c))/(1+sqrt(e2)*sin(c)))**(sqrt(e2)/2)) r from e)"


def _polar_sql(x: str, y: str, lon: str, lat: str, source: str = "k") -> str:
    chi = f"(pi()/2-2*atan(sqrt(({x})**2+({y})**2)/r))"
    series = f"{chi}+(e2/2+5*e2**2/24+e2**3/12+13*e2**4/360)*sin(2*{chi})+(7*e2**2/48+29*e2**3/240+811*e2**4/11520)*sin(4*{chi})+(7*e2**3/120+81*e2**4/1120)*sin(6*{chi})+(4279*e2**4/161280)*sin(8*{chi})"
    return f"round(degrees(atan2({x}, -({y})))-45,6) {lon}, round(degrees({series}),6) {lat}"


def _polar(s, d):
    return X.tri(s, d).select("poly_id", (F.col("x0") * 9000.0 - 200000).alias("x"), (F.col("y0") * 8000.0 - 900000).alias("y"), "w", "h")


@query(views("tri", more=_POLAR) + f"select poly_id, {_polar_sql('x', 'y', 'lon', 'lat')}, 0.0::double dx, 0.0::double dy from k")
def polar_coordinates(s, d):
    """Vertices of the northern polar grid in degrees, and what is left after the way back, in metres to two decimals."""
    g = V.reproject(_polar(s, d), 3413)
    x, y = V.lonlat_to_polar(F.col("lon"), F.col("lat"))
    return g.select("poly_id", *r6("lon", "lat"), F.round(F.abs(x - F.col("x")), 2).alias("dx"), F.round(F.abs(y - F.col("y")), 2).alias("dy"))


@query(views("tri", more=_POLAR) + f"select poly_id, {_polar_sql('x-1000', 'y-h*3-1000', 'west', 'south')}, {_polar_sql('x+w*3+1000', 'y+1000', 'east', 'north')} from k")
def scene_bounds_lonlat(s, d):
    geo = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(3.0).alias("xres"), F.lit(-3.0).alias("yres"), F.col("w").alias("width"), F.col("h").alias("height"))
    return V.bounds_lonlat(_polar(s, d).withColumn("geo", geo), "geo", 3413).select("poly_id", *r6("west", "south", "east", "north"))


@query("select c_custkey, case when c_custkey%9=0 then null when c_custkey%4=0 then 3413 else 32570+c_custkey%150 end epsg, coalesce(c_custkey%9<>0 and (c_custkey%4=0 or (32570+c_custkey%150 between 32601 and 32660) or (32570+c_custkey%150 between 32701 and 32760)), false) known from customer")
def known_projections(s, d):
    c = F.col("c_custkey")
    e = X.table(s, d, "customer").select("c_custkey", F.when(c % 9 != 0, F.when(c % 4 == 0, F.lit(3413).cast("long")).otherwise(32570 + c % 150)).cast("int").alias("epsg"))
    return e.withColumn("known", V.has_projection(F.col("epsg")))


@query(views("scene_names") + "select o_orderkey poly_id, name image_id, string_split(name,'_')[-1] satellite, round((o_orderkey%10)/10.0,6)::double score from scene_names where o_orderkey%7<>0 and o_orderkey%10<=2")
def detections_of_files(s, d):
    """JSON lines of all scenes, some of which are cut off, and the water filter."""
    at = f"{shared_dir(s).rstrip('/')}/lines-{uuid.uuid4().hex}"
    n = X.scene_names(s, d).select(F.col("o_orderkey").alias("poly_id"), "name", ((F.col("o_orderkey") % 10) / F.lit(10.0)).alias("score"))
    line = F.to_json(F.struct("poly_id", "name", "score"))
    n.select(F.when(F.col("poly_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(at)
    water = n.select("poly_id", F.col("score").alias("share"))
    found = V.read_detections(s, at, "poly_id long, name string, score double", water)
    return found.select("poly_id", "image_id", "satellite", *r6("score"))


@query(views("tri", "px", "tpx", more=_POLAR + ", w as (select scene_id, y, x, (v>0.12)::int water from px where (y*64+x)%31<>0), m as (select poly_id, avg(coalesce(water,1)) share from tpx left join w using(scene_id,y,x) group by 1)") + f"select k.poly_id, (20200100+k.poly_id%28+1)::varchar||'_'||lpad(k.poly_id::varchar,6,'0')||'_104e' image_id, round(share,6) share, {_polar_sql('x', 'y', 'lon', 'lat')} from k join m on m.poly_id=k.poly_id where share<=0.2 and k.poly_id%11<>0")
def outlines_of_files(s, d):
    """Lines with outlines on the northern polar grid, some cut off, in degrees and without those in water."""
    at = f"{shared_dir(s).rstrip('/')}/outlines-{uuid.uuid4().hex}"
    own = _polygons(s, d).withColumn("geometry", F.base64(RG.to_wkb(V.rings_map(F.col("rings"), lambda x, y: (x * 9000.0 - 200000, y * 8000.0 - 900000)))))
    i = F.col("poly_id")
    name = F.concat_ws("_", (20200100 + i % 28 + 1).cast("string"), F.lpad(i.cast("string"), 6, "0"), F.lit("104e"))
    line = F.to_json(F.struct("poly_id", "scene_id", name.alias("name"), "geometry"))
    own.select(F.when(i % 11 == 0, F.substring(line, 1, 60)).otherwise(line).alias("value")).write.text(at)
    cell = lambda i: (F.col("y0") + F.floor(i / F.col("w"))) * 64 + F.col("x0") + i % F.col("w")
    water = X.chunks(s, d).withColumn("water", F.transform("v", lambda v, i: F.when(cell(i) % 31 != 0, (v > 0.12).cast("double"))))
    found = V.read_outlines(s, at, "poly_id long, scene_id long, name string, geometry string", 3413, water, (-200000.0, -900000.0, 9000.0, 8000.0), ("scene_id",), size=32)
    first = F.get(F.get("rings_lonlat", F.lit(0)), F.lit(0))
    return found.select("poly_id", "image_id", F.round("share", 6).alias("share"), F.round(first["x"], 6).alias("lon"), F.round(first["y"], 6).alias("lat"))


@query(views("scene_names") + "select name image_id, o_orderkey DN, case when o_orderkey%3=2 then string_split(name,'_')[2] end tile_id, string_split(name,'_')[-1] satellite, 1.5::double score from scene_names where o_orderkey%2=0 union all select name, o_orderkey, case when o_orderkey%3=2 then string_split(name,'_')[2] end, string_split(name,'_')[-1], null from scene_names where o_orderkey%2=1")
def merged_detections(s, d):
    n = X.scene_names(s, d).withColumnRenamed("o_orderkey", "DN")
    a = V.attach_scene_metadata(n.where("DN % 2 = 0").withColumn("score", F.lit(1.5)))
    return V.merge_detections([a, V.attach_scene_metadata(n.where("DN % 2 = 1"))]).select("image_id", "DN", "tile_id", "satellite", "score")


# ------------------------------------------------------------------ other grids


def _grid(s, d, scale):
    return RS.target_grid(X.scenes(s, d).withColumn("width", F.lit(64)), K, (scale, scale))


def _grid_sql(scale: float, name: str = "gr") -> str:
    return f"{name} as (select scene_id, a.i y, b.i x from hs, range(0,1000) a(i), range(0,{int(64 / scale)}) b(i) where a.i<floor(height/{scale}))"


@query(views("px", "hs", more=_grid_sql(2.0)) + "select a.scene_id, a.y::int y, a.x::int x, b.v from gr a left join px b on a.scene_id=b.scene_id and b.y=floor((a.y+0.5)*2)::int and b.x=floor((a.x+0.5)*2)::int")
def nearest_resampling(s, d):
    return RS.align_nearest(X.px(s, d), _grid(s, d, 2.0), K, "v", (2.0, 2.0))


@query(views("px", "hs", more=_grid_sql(1.0)) + "select a.scene_id, a.y::int y, a.x::int x, b.v from gr a left join px b on a.scene_id=b.scene_id and b.y=floor((a.y+0.5)*1.25-3.5)::int and b.x=floor((a.x+0.5)*1.25+2.25)::int")
def shifted_resampling(s, d):
    """A target grid of 3.75 m pixels that begins 10.5 m above and 6.75 m right of the scene's, whose pixels are 3 m."""
    geo = lambda x, y, r: F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(r).alias("xres"), F.lit(-r).alias("yres"))
    grid = _grid(s, d, 1.0).withColumn("src", geo(500000.0, 7600000.0, 3.0)).withColumn("to", geo(500006.75, 7600010.5, 3.75))
    scale, offset = RS.grid_step(F.col("src"), F.col("to"))
    return RS.align_nearest(X.px(s, d), grid, K, "v", scale, offset)


_W = "case when {0}<=1 then 1.5*{0}**3-2.5*{0}**2+1 when {0}<2 then -0.5*{0}**3+2.5*{0}**2-4*{0}+2 else 0 end"


@query(views("px", "hs", more=_grid_sql(1.5) + ", t as (select scene_id, y::int y, x::int x, (y+0.5)*1.5-0.5 fy, (x+0.5)*1.5-0.5 fx from gr), n as (select t.scene_id, t.y, t.x, v, abs(fy-b.y) dy, abs(fx-b.x) dx from t join px b on b.scene_id=t.scene_id and b.y between floor(fy)-1 and floor(fy)+2 and b.x between floor(fx)-1 and floor(fx)+2), w as (select *, (" + _W.format("dy") + ")*(" + _W.format("dx") + ") w from n)") + "select scene_id, y, x, round(sum(w*v)/sum(w),6) v from w group by 1,2,3")
def cubic_resampling(s, d):
    return RS.align_cubic(X.px(s, d), _grid(s, d, 1.5), K, "v", (1.5, 1.5)).select("scene_id", "y", "x", *r6("v"))


# ------------------------------------------------------------------ other coordinate systems, mosaics

_FAR = f"""g as (select scene_id, 500000.0+30*scene_id sx, -2275000+(b.i+0.5)*400 mx, 1000-(a.i+0.5)*400 my, a.i y, b.i x from hs, range(0,52) a(i), range(0,52) b(i)),
c0 as (select *, 1/298.257223563::double*(2-1/298.257223563::double) e2, radians(70) c from g),
c1 as (select *, 6378137.0*(cos(c)/sqrt(1-e2*sin(c)**2))/(tan(pi()/4-c/2)/((1-sqrt(e2)*sin(c))/(1+sqrt(e2)*sin(c)))**(sqrt(e2)/2)) r from c0),
c2 as (select *, pi()/2-2*atan(sqrt(mx**2+my**2)/r) chi, atan2(mx,-my)-radians(45)+radians(135) lam from c1),
c3 as (select *, chi+(e2/2+5*e2**2/24+e2**3/12+13*e2**4/360)*sin(2*chi)+(7*e2**2/48+29*e2**3/240+811*e2**4/11520)*sin(4*chi)+(7*e2**3/120+81*e2**4/1120)*sin(6*chi)+(4279*e2**4/161280)*sin(8*chi) phi from c2),
c4 as (select *, sinh(atanh(sin(phi))-sqrt(e2)*atanh(sqrt(e2)*sin(phi))) t from c3),
c5 as (select *, atan2(t,cos(lam)) xp, atanh(sin(lam)/sqrt(1+t*t)) ep from c4),
c6 as (select *, 500000+{V._K0 * V._AA!r}*(ep{"".join(f"+{a!r}*cos({2 * j}*xp)*sinh({2 * j}*ep)" for j, a in enumerate(V._ALPHA, 1))}) e, {V._K0 * V._AA!r}*(xp{"".join(f"+{a!r}*sin({2 * j}*xp)*cosh({2 * j}*ep)" for j, a in enumerate(V._ALPHA, 1))}) n from c5),
f as (select scene_id, y::int y, x::int x, (n-7700000)/-300-0.5 fy, (e-sx)/300-0.5 fx from c6)"""


def _warped(s, d, method):
    """Scenes of UTM zone 8 (300 m pixels, each begins 30 m further east) on the northern polar grid (400 m)."""
    geo = lambda x, y, r, h, w: F.struct(x.alias("x0"), F.lit(y).alias("y0"), F.lit(r).alias("xres"), F.lit(-r).alias("yres"), h.alias("height"), F.lit(w).alias("width"))
    grids = X.scenes(s, d).select("scene_id", geo(F.lit(500000.0) + 30 * F.col("scene_id"), 7700000.0, 300.0, F.col("height"), 64).alias("source"), geo(F.lit(-2275000.0), 1000.0, 400.0, F.lit(52), 52).alias("target"))
    out = WA.warp(X.chunks(s, d), K, "v", grids, 32608, 3413, method, 24, 32)
    return C.to_pixels(out, K, ["v"]).select("scene_id", "y", "x", *r6("v"))


@query(views("px", "hs", more=_FAR) + "select f.scene_id, f.y, f.x, round(v,6) v from f join px b on b.scene_id=f.scene_id and b.y=floor(fy+0.5)::int and b.x=floor(fx+0.5)::int")
def warped_nearest(s, d):
    return _warped(s, d, "nearest")


@query(views("px", "hs", more=_FAR + ", n as (select f.scene_id, f.y, f.x, b.v, abs(fy-b.y) dy, abs(fx-b.x) dx, b.y=floor(fy+0.5)::int and b.x=floor(fx+0.5)::int near from f join px b on b.scene_id=f.scene_id and b.y between floor(fy)-1 and floor(fy)+2 and b.x between floor(fx)-1 and floor(fx)+2), w as (select *, (" + _W.format("dy") + ")*(" + _W.format("dx") + ") w from n)") + "select scene_id, y, x, round(sum(w*v)/sum(w),6) v from w group by 1,2,3 having bool_or(near)")
def warped_cubic(s, d):
    return _warped(s, d, "cubic")


@query(views("px", more="z as (select scene_id%2 grp, ceil((max(scene_id//2)*40+64)*10/15)::int+4 width from px group by 1), t as (select grp, a.i y, b.i x, 35-(a.i+0.5)*15 ym, -55+(b.i+0.5)*15 xm from z, range(0,60) a(i), range(0,10000) b(i) where b.i<width), o as (select distinct scene_id from px), c as (select grp, t.y ty, t.x tx, scene_id, floor((ym+10*(scene_id%3*7))/-10)::int y, floor((xm-10*(scene_id//2*40))/10)::int x from t join o on scene_id%2=grp)") + "select grp, ty::int y, tx::int x, round(arg_max(v, scene_id),6) v from c join px using(scene_id, y, x) where v>=-0.2 group by 1,2,3")
def shifted_mosaic(s, d):
    """Scenes as tiles with origins of their own, in two mosaics of coarser pixels; the last scene is on top, and low values
    are gaps."""
    i = F.col("scene_id")
    half = F.expr("scene_id div 2")
    origin = F.struct((half * 400.0).alias("x0"), ((i % 3) * -70.0).alias("y0"), F.lit(10.0).alias("xres"), F.lit(-10.0).alias("yres"))
    tiles = X.chunks(s, d).withColumn("v", F.transform("v", lambda v: F.when(v >= -0.2, v))).withColumn("origin", origin).withColumn("grp", i % 2)
    wide = (F.ceil((F.max(half) * 40 + 64) * 10 / 15) + 4).cast("int")
    grids = X.scenes(s, d).groupBy((i % 2).alias("grp")).agg(wide.alias("w")).select("grp", F.struct(F.lit(-55.0).alias("x0"), F.lit(35.0).alias("y0"), F.lit(15.0).alias("xres"), F.lit(-15.0).alias("yres"), F.lit(60).alias("height"), F.col("w").alias("width")).alias("target"))
    out = WA.mosaic(tiles, ["grp"], "v", grids, "scene_id", 25)
    return C.to_pixels(out, ["grp"], ["v"]).select("grp", "y", "x", *r6("v"))
