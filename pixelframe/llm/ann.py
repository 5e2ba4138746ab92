"""Nearest neighbours by a hash-prefix forest (LSH forest) under Euclidean distance.

Vectors are centred and lifted to a sphere. A tree turns its points by a random projection per digit; the digit is the
nearest of the 2 * WIDE poles of the turned axes (a cross-polytope), one byte of the tree's string. Rows are dealt over
shards by hash; a shard's forest holds, for each tree, its rows in the order of their strings, and is built once. Every
query (the stated set) comes to every shard. It descends to the rows with the longest common prefixes in all trees; then
all trees ascend together, one digit less in every step, which adds the rows that share the shorter prefix. The ascent
ends when rows as near as those found would have been missed by all trees with a mean probability of at most MISS; there
is no limit of candidates. A query that has not ended when no digit is left is compared with all rows of the shard.

Equal vectors are one from the start. Only centre, radius and the chance of a common digit are fitted, on SAMPLE rows; every
row is indexed. One forest over the whole cluster, with queries joined to ranges of prefixes, would have to carry each pair of
a query and a candidate through a shuffle, which on vectors without structure is a share of all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; those of another
length than the query's are no candidates; ties go to the smaller id; equal rows are separate candidates, and rows of one id
and vector are one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut

K, TREES, DIGITS, WIDE, MISS = 10, 80, 3, 128, 0.1
#: Rows of the sample, rows in a shard, and queries that are looked up together.
SAMPLE, SHARD, QUERIES = 512, 8192, 256


def _finite(vec: str):
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


@functools.cache
def same_digit() -> tuple[np.ndarray, np.ndarray]:
    """Distances of two points on the unit sphere, and the probability that they get the same digit (by simulation)."""
    rng, at = np.random.default_rng(5), np.linspace(0, 1.5, 101)
    a, b = rng.normal(size=(2, 6000, WIDE))
    pole = lambda x: np.where(x[np.arange(len(x)), i := np.abs(x).argmax(axis=1)] > 0, i, i + WIDE)
    base = pole(a)
    found = [float((pole((1 - d * d / 2) * a + math.sqrt(max(0.0, 1 - (1 - d * d / 2) ** 2)) * b) == base).mean()) for d in at]
    return at, np.minimum.accumulate(np.array(found))


def missed(distance: np.ndarray, digits: int) -> np.ndarray:
    """The probability that all trees miss a common prefix of so many digits with a row at this distance on the sphere."""
    at, p = same_digit()
    return (1 - np.interp(distance, at, p) ** digits) ** TREES


class Projections:
    """What turns vectors into strings: centre and radius of the usual length's vectors, and the trees' projections."""

    def __init__(self, centre: np.ndarray | None, radius: float, seed: int = 3):
        self.centre, self.radius, self.seed, self._lines = centre, radius, seed, {}

    def lift(self, v: np.ndarray) -> np.ndarray:
        x = v - self.centre if self.centre is not None and v.shape[1] == len(self.centre) else v
        square = (x * x).sum(axis=1)
        top = np.maximum(self.radius, np.sqrt(square))
        return np.concatenate([x, np.sqrt(np.maximum(0, self.radius**2 - square))[:, None]], axis=1) / top[:, None]

    def strings(self, v: np.ndarray) -> np.ndarray:
        """(rows, TREES): length, tree and digits as one number, so that a prefix is a shift."""
        z, dim = self.lift(v).astype(np.float32), v.shape[1]
        out = np.empty((len(v), TREES), dtype=np.int64)
        for t in range(TREES):
            word = np.full(len(v), dim * TREES + t, dtype=np.int64)
            for d in range(DIGITS):
                y = z @ np.random.default_rng([self.seed, dim, t, d]).normal(size=(dim + 1, WIDE)).astype(np.float32)
                pole = np.abs(y).argmax(axis=1)
                word = word << 8 | np.where(y[np.arange(len(y)), pole] > 0, pole, pole + WIDE)
            out[:, t] = word
        return out


def fit(vectors: DataFrame) -> Projections:
    """Centre and radius (three quarters of the rows lie within) of SAMPLE rows taken by hash, those of the usual length."""
    rows = [r.v for r in vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()]
    if not rows:
        return Projections(None, 1.0)
    sizes = [len(v) for v in rows]
    usual = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([v for v in rows if len(v) == usual], dtype=np.float64)
    centre = x.mean(axis=0) if len(x) > 1 else np.zeros(usual)
    radius = float(np.quantile(np.sqrt(((x - centre) ** 2).sum(axis=1)), 0.75))
    return Projections(centre, radius if radius > 0 else 1.0)


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length."""
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    size = np.diff(offsets)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)


class PrefixForest:
    """The forest of a shard's rows of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, projections: Projections):
        order = np.argsort(ids)
        self.ids, self.rows, self.projections = ids[order], rows[order], projections
        words = np.concatenate([projections.strings(self.rows[a : a + 2000]) for a in range(0, len(ids), 2000)]).T
        self.order = np.argsort(words, axis=1, kind="stable").astype(np.int32)
        self.words = np.take_along_axis(words, self.order, axis=1)

    def search(self, asked: np.ndarray, k: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the places and squared distances of the k + 1 nearest found, and how many rows it was compared
        with."""
        own = self.projections.strings(asked).T
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(len(self.ids), dtype=bool)) for _ in asked]
        live = list(range(len(asked)))
        for digits in range(DIGITS, -1, -1):
            shift = 8 * (DIGITS - digits)
            low = own[:, live] >> shift << shift
            span = [(np.searchsorted(w, x), np.searchsorted(w, x + (1 << shift))) for w, x in zip(self.words, low)] if digits else None
            still = []
            for at, q in enumerate(live):
                near, square, seen = found[q]
                new = np.ones(len(seen), dtype=bool) if digits == 0 else np.zeros(len(seen), dtype=bool)
                if digits:
                    for order, (a, b) in zip(self.order, span):
                        new[order[a[at] : b[at]]] = True
                new = np.flatnonzero(new & ~seen)
                seen[new] = True
                part = self.rows[new] - asked[q]
                near, square = np.concatenate([near, new]), np.concatenate([square, (part * part).sum(axis=1)])
                best = np.lexsort((self.ids[near], square))[: k + 1]
                found[q] = near[best], square[best], seen
                far = len(best) <= k or missed(np.sqrt(square[best]) / self.projections.radius, digits).mean() > miss
                still += [q] if far else []
            live = still
            if not live:
                break
        return ((near, square, int(seen.sum())) for near, square, seen in found)


def _searched(reps: DataFrame, asks: DataFrame, shards: int, projections: Projections, k: int, miss: float) -> DataFrame:
    """q, id, square (of the distance), seen: for each query and shard the k + 1 nearest found; seen (on one row of them) is how
    many rows were looked at."""
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    rows = reps.select(shard, F.lit(0).alias("kind"), "id", "v")
    queries = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v")

    def run(batches):
        now, held, forests, asked = None, {}, {}, {}

        def answer(dim: int):
            ids, v = zip(*asked.pop(dim))
            if dim in held and dim not in forests:
                own, rows = zip(*held.pop(dim))
                forests[dim] = PrefixForest(np.array(own, np.int64), np.array(rows, np.float64), projections)
            if dim in forests:
                forest = forests[dim]
                out = [(np.full(len(n), q), forest.ids[n], s, np.where(np.arange(len(n)) == 0, seen, 0)) for q, (n, s, seen) in zip(ids, forest.search(np.array(v, np.float64), k, miss))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["q", "id", "square", "seen"])

        for batch in batches:
            for at, kind, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if at != now:
                    for dim in list(asked):
                        yield from answer(dim)
                    now, held, forests = at, {}, {}
                v = np.asarray(v.values)
                into = (asked if kind else held).setdefault(len(v), [])
                into.append((i, v))
                if kind and len(into) == QUERIES:
                    yield from answer(len(v))
        for dim in list(asked):
            yield from answer(dim)

    dealt = rows.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "q long, id long, square double, seen long")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score, examined (rows that the query was compared with, equal ones
    once): for each row where is_query
    holds its k nearest among all others."""
    every = vectors.where(_finite(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    every = every.groupBy("id", "v").agg(F.max("q").alias("q"))
    # of equal vectors the k + 1 smallest ids can be among anyone's k nearest
    key = F.xxhash64("v")
    first = F.row_number().over(W.partitionBy("h", "v").orderBy("id"))
    ranked = every.withColumn("h", key).withColumn("place", first)
    members = ranked.where(F.col("place") <= k + 1)
    reps = cut(members.groupBy("h", "v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    queries = cut(every.where("q").join(reps.select("h", "v", F.col("id").alias("rep")), (F.xxhash64(every["v"]) == F.col("h")) & (every["v"] == reps["v"])).select(F.col("id").alias("query_id"), "rep"))
    shards = max(1, -(-reps.count() // SHARD))
    asks = reps.join(queries.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "v")
    got = _searched(reps, asks, shards, fit(reps), k, miss)
    ranked = got.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("square", "id"))).withColumn("all", F.sum("seen").over(W.partitionBy("q")))
    found = cut(ranked.where(F.col("place") <= k + 1).select("q", "id", "square", "place", "all"))
    groups = queries.join(found.withColumnRenamed("q", "rep"), "rep")
    each = groups.join(reps.select("id", "ids"), "id").select("query_id", "square", "all", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("square", "vec_id"))
    out = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("square").alias("score"), F.col("all").alias("examined"))

