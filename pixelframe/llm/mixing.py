"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into BLOCKS blocks by a hash of the document id. The number of blocks that a source gives to
the mix (its quota; whole passes first, then a part of one more) follows from its target. The quotas of all sources
are split along a binary tree over the output shards: a node draws its left child's share of each source from a
multivariate hypergeometric distribution, so that shards get the mix's proportions without any block being given
twice. Shards then take disjoint runs of each source's permuted blocks, and shuffle their documents locally.

Defined results: a null or empty text has size 0 (it may be drawn, which takes nothing); a null source is a source of its
own, ordered last; repeated rows are separate documents, but rows of one id are drawn together; ties go by hashes of ids, so
that reruns agree; texts may be of any length; an empty table gives no rows; other columns are left alone, whatever
their names. There may be at most SOURCES sources (more are an error): each is one row of one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights by source in order, and the share of all words that the mix holds.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Blocks of a source, and parts of the one block that a quota cuts through.
BLOCKS = 1024
#: Most sources: their targets and a node of the tree are made in one task, a row for each, and a draw is from less than
#: 10**9 blocks (numpy's bound), of which a source gives at most MOST * BLOCKS.
SOURCES = 480_000


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """skey, source, source_size -> with target: share * all words by weight, none above most * its own size.

    Sources are a small dimension (one row each); what is above a limit is shared again by weight, which ends at
    one level: sources in order of limit per weight are at their limit until the level of the rest is below it."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_limit = W.orderBy("ratio", "skey")
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("before", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)))
    everything = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("before")) / F.col("left"))
    s = s.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything))
    return s.select("skey", "source", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """skey, quota -> skey, shard, n: a binary tree of multivariate hypergeometric draws. A node's group holds one
    row for each source."""

    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("skey", ignore_index=True)
        node, width = int(pdf["node"].iloc[0]), int(pdf["width"].iloc[0])
        if width == 1:
            return pdf
        q = pdf["n"].to_numpy(np.int64)
        left_width = width // 2
        draw = int(q.sum()) * left_width // width
        left = np.random.default_rng([seed, width, node]).multivariate_hypergeometric(q, draw) if draw else np.zeros_like(q)
        two = [pdf.assign(width=left_width, n=left), pdf.assign(node=node + left_width, width=width - left_width, n=q - left)]
        return pd.concat(two, ignore_index=True)

    tree = quotas.select("skey", F.lit(0).cast("long").alias("node"), F.lit(shards).cast("long").alias("width"), F.col("quota").cast("long").alias("n"))
    for _ in range((shards - 1).bit_length()):
        tree = tree.groupBy("node", "width").applyInPandas(halve, tree.schema)
    return tree.select("skey", F.col("node").alias("shard"), "n")


def plan_mix(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and draws array<struct<epoch, shard>>, one entry
    for each copy that the mix takes. Whole documents are taken, so none is taken more than twice."""
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col("source").alias("source"),
            F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("z")).alias("skey"),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
        )
        .withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BLOCKS)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(BLOCKS)).cast("int"))
    )
    blocks = cut(sized.groupBy("skey", "source", "block").agg(F.sum("size").alias("words")))
    if blocks.select("skey").distinct().count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    count = blocks.count()
    targets = source_targets(blocks.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, share)
    # whole passes, and the words of the last one
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    at = W.partitionBy("skey").orderBy("rank", "block")  # at most BLOCKS rows for each source
    b = blocks.withColumn("rank", F.xxhash64("block", "skey", F.lit(seed + 2))).withColumn("pos", F.row_number().over(at) - 1)
    b = b.withColumn("upto", F.sum("words").over(at.rowsBetween(W.unboundedPreceding, 0))).join(targets.drop("source"), "skey")
    b = cut(b.withColumn("last", F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("words") < F.col("rest"), 2).otherwise(0)), rows=count)
    # the block that the target cuts through: its parts in order until the target is nearest
    through = b.where("last = 2").select("skey", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("want"))
    parts = sized.join(through, ["skey", "block"]).groupBy("skey", "block", "want", "part").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("skey").orderBy("part"))  # at most BLOCKS rows for each source
    parts = parts.withColumn("upto", upto).groupBy("skey", "want").agg(F.max(F.when(F.col("upto") <= F.col("want"), F.struct("part", "upto"))).alias("m"))
    parts = parts.select("skey", F.coalesce("m.part", F.lit(-1)).alias("last_part"), (F.col("want") - F.coalesce("m.upto", F.lit(0))).alias("gap"))
    b = b.join(parts, "skey", "left").withColumn("last_part", F.when(F.col("last") == 2, F.coalesce("last_part", F.lit(-1))))
    # and one document that this pass has not drawn, the one nearest to what is still missing
    spare = sized.join(b.where("gap is not null and (last = 0 or last = 2)").select("skey", "block", "last_part", "gap"), ["skey", "block"])
    spare = spare.where("(last_part is null or part > last_part) and abs(size - gap) < gap")
    spare = spare.groupBy("skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), F.xxhash64("doc_id").alias("h"), "doc_id", "block")).alias("m"))
    spare = spare.select("skey", F.col("m.block").alias("block"), F.col("m.doc_id").alias("extra"))
    quotas = b.groupBy("skey").agg(F.sum(F.col("passes") + F.sign("last").cast("int")).alias("quota"))
    shares = split_tree(quotas, shards, seed)
    along = W.partitionBy("skey").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = shares.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).where("n > 0")
    spots = runs.select("skey", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("spot"))
    # a source's draws in order: pass 0 of all blocks, pass 1, ..., each in permuted order
    drawn = b.withColumn("copies", F.col("passes") + F.sign("last").cast("int")).where("copies > 0")
    drawn = drawn.select("skey", "block", "pos", "last_part", "passes", F.explode(F.expr("sequence(0, copies - 1)")).alias("epoch"))
    drawn = drawn.withColumn("spot", (F.col("epoch") * BLOCKS + F.col("pos")).cast("long"))
    drawn = drawn.withColumn("spot", (F.row_number().over(W.partitionBy("skey").orderBy("spot")) - 1).cast("long")).join(spots, ["skey", "spot"])
    one = F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("shard").cast("int").alias("shard"), F.when(F.col("epoch") == F.col("passes"), F.col("last_part")).alias("upto"))
    drawn = cut(drawn.select("skey", "block", one.alias("draw")), rows=3 * count)
    # the extra document goes where its source's cut block goes
    spare = spare.join(drawn.where("draw.upto is not null"), "skey", "left").select(spare["skey"], spare["block"], "extra", F.struct(F.coalesce("draw.epoch", F.lit(0)).alias("epoch"), F.coalesce("draw.shard", F.lit(0)).alias("shard")).alias("extra_draw"))
    drawn = drawn.groupBy("skey", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws"))  # at most three
    per_block = cut(b.select("skey", "block", "source_size", "target").join(drawn, ["skey", "block"], "left").join(spare, ["skey", "block"], "left"), rows=count)
    out = sized.join(per_block, ["skey", "block"])
    draws = F.filter(F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int,upto:int>>")), lambda d: d["upto"].isNull() | (F.col("part") <= d["upto"]))
    draws = F.transform(draws, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard")))
    out = out.withColumn("draws", F.when(F.col("doc_id") == F.col("extra"), F.array_append(draws, F.col("extra_draw"))).otherwise(draws))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", **how) -> DataFrame:
    """The mixed corpus: docs' rows, one for each draw, with shard and epoch (with underscores behind them if docs has such
    columns), shuffled within shards. A shard is dealt over several tasks by a salt, each of which sorts its rows by a
    random key. Rows that share an id are drawn together."""
    key_, epoch, shard = fresh(docs, "_id", "epoch", "shard")
    draws = plan_mix(docs, shards, seed, id_col, **how).select(F.col("doc_id").alias(key_), F.explode("draws").alias("_d"))
    draws = draws.distinct().select(key_, F.col("_d.epoch").alias(epoch), F.col("_d.shard").alias(shard))
    out = docs.join(draws, F.col(id_col).eqNullSafe(F.col(key_))).drop(key_)
    key = F.xxhash64(id_col, epoch, F.lit(seed + 3))
    return out.repartition(shard, F.pmod(key, F.lit(16))).sortWithinPartitions(shard, key)
