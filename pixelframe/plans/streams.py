"""Streaming queries: the given tables read as streams until all is processed, results kept in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..operators.graph import shared_dir
from ..streaming import accumulate, incremental_scenes, meter_value, running_meter
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _arrivals(d, name):
    # a pattern, since a table may be one file or a folder of files
    return f"{d}/{name[:-1]}[{name[-1]}].parquet"


def _stream(s, d, name):
    return s.readStream.schema(X.table(s, d, name).schema).parquet(_arrivals(d, name))


def running_meter_stream(s, d):
    """Mean and deviation by event type, updated batch by batch; the last state of each key stands."""
    at = f"{shared_dir(s).rstrip('/')}/meter-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    running_meter(_stream(s, d, "events"), ["event_type"], "value", keep, f"{at}/state").awaitTermination()
    last = F.row_number().over(W.partitionBy("event_type").orderBy(F.col("batch").desc()))
    parts = s.read.parquet(f"{at}/out").withColumn("k", last).where("k = 1").drop("k", "batch")
    return meter_value(parts).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


ORACLES["running_meter_stream"] = 'select event_type, count(*) n, round(avg("value"),6) mean, round(stddev_samp("value"),6) std from events group by 1'


def incremental_intake_stream(s, d):
    """Orders arrive as scenes; each is taken in once, and those not finished are handed on by their names. What arrived
    before is not taken in again."""
    at = f"{shared_dir(s).rstrip('/')}/intake-{uuid.uuid4().hex}"

    def process(batch, number):
        X.names_of(batch).where("o_orderkey % 7 != 0").write.mode("overwrite").parquet(f"{at}/out/run={run}/batch={number}")

    for run in range(2):  # the second run finds nothing new
        incremental_scenes(s, _arrivals(d, "orders"), X.table(s, d, "orders").schema, process, f"{at}/state", "o_orderkey").awaitTermination()
    return s.read.parquet(f"{at}/out").select("name")


ORACLES["incremental_intake_stream"] = X.views("scene_names") + "select name from scene_names where o_orderkey%7<>0"



def epoch_counts_stream(s, d):
    """Hits, false alarms and misses of each kind of event by day, over two runs from one checkpoint: rows add up, some reset
    their day, and a day closes when the watermark has passed it. The last state of each day stands."""
    at = f"{shared_dir(s).rstrip('/')}/epochs-{uuid.uuid4().hex}"
    e = X.table(s, d, "events").withColumn("epoch", F.date_format("ts", "yyyy-MM-dd"))
    pred, true = F.col("value") > 10, F.col("user_id") % 2 == 0
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "epoch", (F.col("event_id") % 113 == 0).alias("again"), *[c.cast("long").alias(n) for n, c in (("tp", pred & true), ("fp", pred & ~true), ("fn", ~pred & true))])
    schema = e.schema

    def keep(batch, number):
        batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{at}/out/run={run}/batch={number}")

    for run, part in enumerate(("epoch < '2024-01-16'", "epoch >= '2024-01-16'")):
        # what comes in arrives in order of time
        e.where(part).write.mode("append").parquet(f"{at}/in")
        rows = s.readStream.schema(schema).parquet(f"{at}/in")
        accumulate(rows, ["event_type", "epoch"], ["tp", "fp", "fn"], keep, f"{at}/state", reset="again", order="event_id").awaitTermination()
    last = F.row_number().over(W.partitionBy("event_type", "epoch").orderBy(F.col("run").desc(), F.col("batch").desc()))
    got = s.read.parquet(f"{at}/out").withColumn("k", last).where("k = 1")
    return got.select("event_type", "epoch", "tp", "fp", "fn", "n")


ORACLES["epoch_counts_stream"] = """with e as (select *, strftime(ts, '%Y-%m-%d') epoch, max(case when event_id%113=0 then event_id end) over (partition by event_type, strftime(ts, '%Y-%m-%d')) again from events)
select event_type, epoch, count(*) filter (k and "value">10 and user_id%2=0) tp, count(*) filter (k and "value">10 and user_id%2<>0) fp, count(*) filter (k and not "value">10 and user_id%2=0) fn, count(*) filter (k) n from (select *, event_id > coalesce(again,-1) k from e) group by 1,2"""
QUERIES |= {f.__name__: f for f in (running_meter_stream, incremental_intake_stream, epoch_counts_stream)}


def bucketed_sources(s, d):
    """Tiles, masks and slopes as tables bucketed by their place: joined without a shuffle."""
    from ..operators import tiling as T
    from ..sources import store

    t = X.tile(s, d).withColumn("row", F.expr("cast(vec_id div 8 as int)")).withColumn("col", (F.col("vec_id") % 8).cast("int"))
    names = {n: f"{n}_{uuid.uuid4().hex}" for n in ("img", "mask", "slope")}
    for n, name in names.items():
        df = t.withColumn("slope", F.reverse("img")).select("scene_id", "row", "col", n)
        store.write_bucketed(df, name, ["scene_id", "row", "col"], 8)
    both = T.join_sources(s.table(names["img"]), {n: s.table(names[n]) for n in ("mask", "slope")})
    return both.select("scene_id", "row", "col", *[F.round(F.get(c, F.lit(0)).cast("double"), 6).alias(n) for c, n in (("img", "first"), ("slope", "second"))], F.aggregate("mask", F.lit(0).cast("long"), lambda a, v: a + v).alias("positives"))


QUERIES["bucketed_sources"] = bucketed_sources
ORACLES["bucketed_sources"] = X.views("tile") + "select scene_id, (vec_id//8)::int \"row\", (vec_id%8)::int col, round(img[1]::double,6) \"first\", round(img[64]::double,6) \"second\", list_sum(mask)::bigint positives from tile"


def tile_store(s, d):
    """Tiles written by source, read back for one of them: the store's columns and folders are pruned."""
    from ..sources import store

    at = f"{shared_dir(s).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    t = X.tile(s, d).select("scene_id", F.col("vec_id").cast("int").alias("tile_idx"), F.col("img").alias("ndvi"), F.reverse("img").alias("slope"), "mask")
    store.write_tiles(t, at)
    back = store.read_tiles(s, at, ["slope", "ndvi"], [1, 2])
    return back.select("scene_id", "tile_idx", F.size("x").alias("n"), F.round(F.get("x", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("x", F.lit(64)).cast("double"), 6).alias("second"))


QUERIES["tile_store"] = tile_store
ORACLES["tile_store"] = "select label::int scene_id, vec_id::int tile_idx, 128 n, round(embedding[1]::double,6) \"first\", round(embedding[64]::double,6) \"second\" from embeddings where label in (1,2)"


def versioned_detections(s, d):
    """Two versions of a product are written; readers get the last one."""
    from ..sources import store

    at = f"{shared_dir(s).rstrip('/')}/detections-{uuid.uuid4().hex}"
    t = X.tri(s, d).select("poly_id", "w", "h")
    store.write_versioned(t, at, "20240101T000000")
    store.write_versioned(t.where("w > 6"), at, "20240102T000000")
    return store.read_latest(s, at)


QUERIES["versioned_detections"] = versioned_detections
ORACLES["versioned_detections"] = X.views("tri") + "select poly_id, w, h from tri where w>6"


def metric_csv(s, d):
    """Metric rows of two epochs appended to a CSV folder and read back."""
    from ..operators import metrics as M
    from ..sources import store

    at = f"{shared_dir(s).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    for epoch in (0, 1):
        m = M.confusion(X.scored(s, d), by=("grp",), t=0.4 + 0.2 * epoch).withColumn("epoch", F.lit(epoch))
        store.write_metrics(m, at)
    return s.read.option("header", True).schema("grp string, tp long, fp long, tn long, fn long, epoch int").csv(at)


QUERIES["metric_csv"] = metric_csv
ORACLES["metric_csv"] = X.views("scored") + "select grp, count(*) filter (score>t and target=1) tp, count(*) filter (score>t and target=0) fp, count(*) filter (score<=t and target=0) tn, count(*) filter (score<=t and target=1) fn, e::int epoch from scored, (values (0,0.4::double),(1,0.6::double)) v(e,t) group by grp, e"


def scene_files(s, d):
    """Tiles written in a folder for each scene by four writes, not all of which have tiles of every scene, then listed
    without being read: how many files each scene has."""
    from ..operators import catalog as C
    from ..sources import store

    at = f"{shared_dir(s).rstrip('/')}/listed-{uuid.uuid4().hex}"
    t = X.tile(s, d).select("scene_id", F.col("vec_id").alias("tile_idx"), F.col("img").alias("ndvi"), "mask")
    for k in range(4):
        store.write_tiles(t.where(F.col("tile_idx") % (F.col("scene_id") % 4 + 1) == k).repartition("scene_id"), at, "append")
    files = C.scene_files(s, at).where(F.col("file").endswith(".parquet") & (F.col("length") > 0))
    return C.file_counts(files).select(F.regexp_extract("name", "([0-9]+)$", 1).cast("int").alias("scene_id"), "n_files")


QUERIES["scene_files"] = scene_files
ORACLES["scene_files"] = "select label::int scene_id, count(distinct vec_id%(label%4+1)) n_files from embeddings group by 1"


def metrics_log_files(s, d):
    """Log lines written as text files and read from their folder: the mean of each metric by kind of epoch."""
    from ..sources import store

    at = f"{shared_dir(s).rstrip('/')}/log-{uuid.uuid4().hex}"
    X.log_lines(s, d).select("line").write.text(at)
    log = store.read_metrics_log(s, at)
    return log.groupBy("val_type").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in store.METRICS_LOG])


QUERIES["metrics_log_files"] = metrics_log_files
ORACLES["metrics_log_files"] = "select case when event_id%2=0 then 'Train' else 'Val' end val_type, count(*) n, " + ", ".join(f"round(avg(((event_id*{k})%1000)/1000.0::double),6) {n}" for n, k in (("accuracy", 37), ('"precision"', 41), ("recall", 43), ("f1", 47), ("iou", 53), ("loss", 59))) + " from events group by 1"


def product_folders(s, d):
    """Products of an ensemble written by threshold label and of single scenes' scores, read back: pixels and their sum."""
    from ..functions.names import threshold_label
    from ..operators import ensemble as E
    from ..sources import store

    at = f"{shared_dir(s).rstrip('/')}/products-{uuid.uuid4().hex}"
    mean = X.prob(s, d).where("not nod").select("scene_id", "y", "x", ((F.col("p1") + F.col("p2")) / 2).alias("p"))
    store.write_products(E.by_threshold(mean, [0.4, 0.5]).withColumn("threshold_label", threshold_label(F.col("threshold"))), f"{at}/ensemble")
    store.write_products(mean.withColumn("threshold_label", F.lit("proba")), f"{at}/scores")
    both = s.read.parquet(f"{at}/ensemble").select("threshold_label", "p").unionByName(s.read.parquet(f"{at}/scores").select("threshold_label", "p"))
    return both.groupBy("threshold_label").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("total"))


QUERIES["product_folders"] = product_folders
ORACLES["product_folders"] = X.views("prob") + "select l threshold_label, count(*) n, round(sum((p1+p2)/2),4) total from prob, (values (0.4::double,'class_04'),(0.5,'class_05'),(0.0,'proba')) r(t,l) where not nod and (p1+p2)/2>=t group by 1"
