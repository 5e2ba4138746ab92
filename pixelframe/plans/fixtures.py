"""Scenes, rasters, masks and logs derived from the given tables, as DataFrames and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunks as C


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def px(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(F.expr("vec_id div 64").alias("scene_id"), (F.col("vec_id") % 64).cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))


def scenes(s, d):
    """scene_id and height."""
    return table(s, d, "embeddings").groupBy(F.expr("vec_id div 64").alias("scene_id")).agg(F.count("*").cast("int").alias("height"))


def chunks(s, d, size=32):
    """px as chunks with the band v, straight from the rows of the scenes."""
    e = table(s, d, "embeddings").select(F.expr("vec_id div 64").alias("scene_id"), (F.col("vec_id") % 64).cast("int").alias("y"), F.lit(0).alias("x0"), F.col("embedding").alias("v"))
    return C.strips_to_chunks(e, ["scene_id"], "v", scenes(s, d).withColumn("width", F.lit(64)), size)


def dense(s, d, t=0.06):
    """px with height and width of its scene and the mask m = v >= t."""
    return px(s, d).join(scenes(s, d), "scene_id").withColumn("width", F.lit(64)).withColumn("m", (F.col("v") >= t).cast("int"))


def bands(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    y = F.expr("vec_id div 4")
    dn = F.when((y * 64 + F.col("x")) % 17 == 0, 0).otherwise(F.round((F.col("v").cast("double") + 0.6) * 3000).cast("int"))
    return e.select(y.alias("y"), "x", (F.col("vec_id") % 4).cast("int").alias("band"), dn.alias("dn"))


def prob(s, d):
    a = px(s, d)
    b = a.select("scene_id", "y", ((F.col("x") + 63) % 64).alias("x"), F.col("v").alias("w"))
    sig = lambda c: 1 / (1 + F.exp(-10 * F.col(c)))
    return a.join(b, ["scene_id", "y", "x"]).select("scene_id", "y", "x", sig("v").alias("p1"), sig("w").alias("p2"), ((F.col("y") * 64 + F.col("x")) % 997 == 0).alias("nod"))


def scored(s, d):
    l = table(s, d, "lineitem")
    return l.select(F.col("l_linestatus").alias("grp"), (F.col("l_suppkey") % 8).alias("image"), "l_orderkey", "l_linenumber", (((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7) % 1000) / F.lit(1000.0)).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("target"))


def scene_names(s, d):
    return names_of(table(s, d, "orders"))


def names_of(o):
    day = "yyyyMMdd"
    k, c, dt = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    name = F.when(k % 3 == 0, F.concat_ws("_", F.date_format(dt, day), pad(k, 6), F.lit("104e"))).when(k % 3 == 1, F.concat_ws("_", F.date_format(dt, day), pad(k, 6), pad(c % 100, 2), F.lit("241d"))).otherwise(F.concat_ws("_", pad(k, 7), pad(c, 7), F.date_format(dt, "yyyy-MM-dd"), F.lit("0f17")))
    return o.select("o_orderkey", name.alias("name"))


def status(s, d):
    k = F.col("o_orderkey")
    return scene_names(s, d).select("name", "o_orderkey", (k % 5 != 0).alias("processed"), (k % 9).alias("n_files"), (k % 7 == 0).alias("finished"), (k % 4 != 0).alias("m1"), (k % 6 != 0).alias("m2"), (k % 10 == 0).alias("ens"))


def udm(s, d):
    bit = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.floor(F.col("l_orderkey") / F.pow(F.lit(2.0), k)).cast("long") + F.col("l_linenumber")) % 2).cast("int"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", bit.alias("b"))


def tri(s, d):
    c = F.col("c_custkey")
    return table(s, d, "customer").select(c.alias("poly_id"), (c % 8).alias("scene_id"), (c % 50).alias("x0"), (c * 7 % 50).alias("y0"), (F.col("c_nationkey") % 10 + 3).alias("w"), (c % 8 + 4).alias("h"))


def tile(s, d):
    return table(s, d, "embeddings").select(F.col("label").alias("scene_id"), "vec_id", F.col("embedding").alias("img"), F.transform("embedding", lambda e: (e > F.lit(0.3).cast("float")).cast("int")).alias("mask"))


def log_lines(s, d):
    e = F.col("event_id")
    part = lambda n, k: F.concat(F.lit(f"{n}:0."), F.lpad((e * k % 1000).cast("string"), 3, "0"))
    return table(s, d, "events").select("event_id", F.concat(F.lit("Epoch "), e.cast("string"), F.lit(" - "), F.when(e % 2 == 0, "Train").otherwise("Val"), F.lit(": "), F.concat_ws(", ", *[part(n, k) for n, k in (("accuracy", 37), ("precision", 41), ("recall", 43), ("f1", 47), ("iou", 53), ("loss", 59))])).alias("line"))


SQL = {
    "px": "select vec_id//64 scene_id, vec_id%64 y, t.i-1 x, embedding[t.i]::double v from embeddings, range(1,65) t(i)",
    "hs": "select vec_id//64 scene_id, count(*) height from embeddings group by 1",
    "bands": "select vec_id//4 y, t.i-1 x, vec_id%4 band, case when ((vec_id//4)*64+t.i-1)%17=0 then 0 else round((embedding[t.i]::double+0.6)*3000)::int end dn from embeddings, range(1,65) t(i)",
    "prob": "select a.scene_id, a.y, a.x, 1/(1+exp(-10*a.v)) p1, 1/(1+exp(-10*b.v)) p2, (a.y*64+a.x)%997=0 nod from px a join px b on a.scene_id=b.scene_id and a.y=b.y and b.x=(a.x+1)%64",
    "scored": "select l_linestatus grp, l_suppkey%8 image, l_orderkey, l_linenumber, ((l_orderkey*31+l_partkey*17+l_linenumber*7)%1000)/1000.0::double score, (l_returnflag='R')::int target from lineitem",
    "scene_names": "select o_orderkey, case o_orderkey%3 when 0 then strftime(o_orderdate,'%Y%m%d')||'_'||lpad(o_orderkey::varchar,greatest(6,length(o_orderkey::varchar))::int,'0')||'_104e' when 1 then strftime(o_orderdate,'%Y%m%d')||'_'||lpad(o_orderkey::varchar,6,'0')||'_'||lpad((o_custkey%100)::varchar,2,'0')||'_241d' else lpad(o_orderkey::varchar,7,'0')||'_'||lpad(o_custkey::varchar,7,'0')||'_'||strftime(o_orderdate,'%Y-%m-%d')||'_0f17' end name from orders".replace("greatest(6,length(o_orderkey::varchar))::int", "6"),
    "status": "select name, o_orderkey, o_orderkey%5<>0 processed, o_orderkey%9 n_files, o_orderkey%7=0 finished, o_orderkey%4<>0 m1, o_orderkey%6<>0 m2, o_orderkey%10=0 ens from scene_names",
    "udm": "select l_orderkey, l_linenumber, l_quantity, list_transform(range(0,8), lambda k: (l_orderkey//(1<<k)+l_linenumber)%2) b from lineitem",
    "tri": "select c_custkey poly_id, c_custkey%8 scene_id, c_custkey%50 x0, (c_custkey*7)%50 y0, 3+c_nationkey%10 w, 4+c_custkey%8 h from customer",
    "tpx": "select poly_id, scene_id, y0+dy y, x0+dx x from tri, range(0,12) a(dy), range(0,13) b(dx) where (2*dx+1)*h+(2*dy+1)*w < 2*w*h",
    "tile": "select label scene_id, vec_id, embedding img, list_transform(embedding, lambda e: (e>0.3::float)::int) mask from embeddings",
    "log_lines": "select event_id, 'Epoch '||event_id||' - '||case when event_id%2=0 then 'Train' else 'Val' end||': accuracy:0.'||lpad(((event_id*37)%1000)::varchar,3,'0')||', precision:0.'||lpad(((event_id*41)%1000)::varchar,3,'0')||', recall:0.'||lpad(((event_id*43)%1000)::varchar,3,'0')||', f1:0.'||lpad(((event_id*47)%1000)::varchar,3,'0')||', iou:0.'||lpad(((event_id*53)%1000)::varchar,3,'0')||', loss:0.'||lpad(((event_id*59)%1000)::varchar,3,'0') line from events",
}
_NEEDS = {"prob": ["px"], "status": ["scene_names"], "tpx": ["tri"]}


def views(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause of the named views and what they need; more: further clauses."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [f"{n} as ({SQL[n]})" for n in order] + ([more] if more else [])
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"


def labels_sql(name: str, fg: str, eight: bool = True) -> str:
    """Clauses of a recursive WITH: fg selects g (any key), y, x; name(g, y, x, label) has each pixel's smallest y * 64 + x of
    its component."""
    return f"""{name}_f as materialized ({fg}),
{name}_d as materialized (select * from range(-1,2) p(dy), range(-1,2) q(dx) where (dy<>0 or dx<>0) {'' if eight else 'and abs(dy)+abs(dx)=1'}),
{name}_e as materialized (select a.g, a.y, a.x, b.y y2, b.x x2 from {name}_f a, {name}_d d, {name}_f b where b.g=a.g and b.y=a.y+d.dy and b.x=a.x+d.dx),
{name}_r as (select g, y, x, y*64+x root from {name}_f union select e.g, e.y2, e.x2, r.root from {name}_r r join {name}_e e on r.g=e.g and r.y=e.y and r.x=e.x where r.root < e.y2*64+e.x2),
{name} as materialized (select g, y, x, min(root) label from {name}_r group by all)"""
