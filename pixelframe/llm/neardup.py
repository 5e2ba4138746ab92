"""Embedding near-duplicates by lattice hashing.

In each of TABLES tables unit vectors are projected at random to two blocks of eight dimensions and decoded to the
nearest point of the E8 lattice. A vector lives in its own cell and visits the PROBES neighbouring cells nearest to it
(one root vector away). Vectors that meet in a cell, one of them living there, are compared by cosine in
double precision. A pair that meets in several cells counts in the one with the smallest key, so that links are
counted without ever listing pairs. Cells with many vectors are dealt out as pairs of parts.

Defined results: vectors that are null, zero or hold null or non-finite components, and those without a label, link
with nothing and are kept; vectors of different length or label are not compared; equal vectors are compared once and count
as often as they stand; a pair at the threshold is a link; each row of the table has one row in the result, whether its
id is repeated or null (an id of several vectors has each one's links in that one's row); vectors may be of any length
above zero that doubles can tell, for they are scaled first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, connected_components, cut, mix64
from .jaccard import _Forest

COSINE, TABLES, PROBES, SCALE, BLOCKS, PART = 0.98, 10, 3, 0.3, 2, 1500


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([np.array(out), halves[(halves < 0).sum(axis=1) % 2 == 0]])


ROOTS = _roots()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    rest = x - near
    worst = np.abs(rest).argmax(axis=1)
    near[odd, worst[odd]] += np.where(rest[odd, worst[odd]] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of D8 or of D8 moved by one half, whichever is nearer."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _cell_keys(points: np.ndarray, seed: int, label: np.ndarray) -> np.ndarray:
    h = mix64(label.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    for d in range(points.shape[1]):
        h = mix64(h ^ (np.rint(points[:, d] * 2).astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)))
    return h


def lattice_keys(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 11) -> np.ndarray:
    """(n, tables, 1 + probes) cell keys: the own cell first, then the neighbouring ones."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), dtype=U64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dim])
        a = np.concatenate([np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim] for _ in range(BLOCKS)], axis=1)
        y = unit @ a / scale * np.sqrt(dim / 64)
        points = np.concatenate([decode_e8(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
        out[:, t, 0] = _cell_keys(points, t, label)
        toward = np.concatenate([(y - points)[:, 8 * b : 8 * b + 8] @ ROOTS.T for b in range(BLOCKS)], axis=1)
        nearest = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            moved, b = points.copy(), nearest[:, p] // len(ROOTS)
            for k in range(BLOCKS):
                rows = np.flatnonzero(b == k)
                moved[rows, 8 * k : 8 * k + 8] += ROOTS[nearest[rows, p] % len(ROOTS)]
            out[:, t, 1 + p] = _cell_keys(moved, t, label)
    return out


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return vectors.where(_usable(v) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *_hashes(label_col), v.alias("v"))


def _usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _hashes(label_col: str) -> list[Column]:
    """label and label2: together 128 bits that stand for a label."""
    return [F.xxhash64(label_col).alias("label"), F.xxhash64(F.lit(1), F.col(label_col)).alias("label2")]


def _keyed(reps: DataFrame) -> DataFrame:
    """id, w, cells (the own cell of each table and those that the vector visits), keys (the same as bytes), v (label2 and
    the vector over its largest entry, as bytes): what a comparison needs, written once."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                some = batch.slice(a, 5000)
                label, lists = np.array(some.column(1), dtype=np.int64), some.column(2)
                second = np.array([x.tobytes() for x in np.array(some.column(4), dtype=np.int64)], dtype=object)
                offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
                size = np.diff(offsets)
                for dim in np.unique(size):
                    rows = np.flatnonzero(size == dim)
                    v = flat[offsets[rows][:, None] + np.arange(dim)]
                    unit = v / np.abs(v).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    keys = lattice_keys(unit, mix64(label[rows].view(U64) + U64(dim)).view(np.int64)).reshape(len(rows), -1)
                    at, per = pa.array(rows), keys.shape[1]
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * per), pa.array(keys.reshape(-1).view(np.int64)))
                    own, vb = [k.tobytes() for k in keys], [b + x.tobytes() for b, x in zip(second[rows], v / np.abs(v).max(axis=1, keepdims=True))]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(3).take(at), cells, pa.array(own, pa.binary()), pa.array(vb, pa.binary())], ["id", "w", "cells", "keys", "v"])

    return reps.select(F.col("rep").alias("id"), "label", "v", "w", "label2").mapInArrow(run, "id long, w long, cells array<long>, keys binary, v binary")


def _owner(kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """The smallest key at which the pairs (rows of kx, ky: (m, tables, 1 + probes)) meet with one of them at home."""
    best = np.full(len(kx), np.iinfo(np.uint64).max, dtype=U64)
    for t in range(kx.shape[1]):
        for home, other in ((kx[:, t, 0], ky[:, t]), (ky[:, t, 0], kx[:, t])):
            meets = (other == home[:, None]).any(axis=1)
            best = np.where(meets & (home < best), home, best)
    return best


def _compare(key: int, i: int, j: int, held: list, cosine: float):
    """Links of one cell (or of two parts of it): [(id, number, other id or None)]."""
    ids = np.array([h[0] for h in held], np.int64)
    weight = np.array([h[1] for h in held], np.int64)
    home = np.array([h[4] for h in held])
    part = np.array([h[5] for h in held])
    v = np.stack([np.frombuffer(h[3][8:]) for h in held])
    second = np.array([int.from_bytes(h[3][:8], "little", signed=True) for h in held])
    keys = np.stack([np.frombuffer(h[2], U64) for h in held]).reshape(len(held), TABLES, 1 + PROBES)
    norm = np.sqrt((v * v).sum(axis=1))
    unit = v / norm[:, None]
    n, links, forest, out = len(ids), np.zeros(len(ids), np.int64), _Forest(len(ids)), []
    for a in range(0, n, 256):
        x = np.arange(a, min(a + 256, n))
        near = unit[x] @ unit.T >= cosine - 1e-9
        p, q = np.nonzero(near)
        p = x[p]
        ok = (ids[p] < ids[q]) & (home[p] | home[q]) & (second[p] == second[q])
        ok &= (part[p] != part[q]) if i != j else True
        p, q = p[ok], q[ok]
        exact = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= cosine
        p, q = p[exact], q[exact]
        mine = _owner(keys[p], keys[q]) == U64(key & (2**64 - 1))
        p, q = p[mine], q[mine]
        links += np.bincount(p, weights=weight[q], minlength=n).astype(np.int64) + np.bincount(q, weights=weight[p], minlength=n).astype(np.int64)
        for b, c in zip(p.tolist(), q.tolist()):
            if forest.join(b, c):
                out.append((int(ids[b]), 0, int(ids[c])))
    some = np.flatnonzero(links)
    return out + [(int(ids[s]), int(links[s]), None) for s in some]


def _search(cells: DataFrame, cosine: float) -> DataFrame:
    def run(batches):
        now, held, out = None, [], []

        def done():
            live = any(h[4] for h in held) and len(held) > 1
            return _compare(now[0], now[1], now[2], held, cosine) if live else []

        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(9)]
            for key, i, j, *rest in zip(*c):
                if (key, i, j) != now:
                    out += done() if held else []
                    now, held = (key, i, j), []
                held.append(tuple(rest))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "n", "b"])
                out = []
        out += done() if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "n", "b"])

    dealt = cells.select("key", "i", "j", "id", "w", "keys", "v", "home", "part").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(run, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id, kept."""
    every = valid_vectors(vectors, id_col, vec_col, label_col)
    # a representative's number is written with it, so it stays the same whatever is computed again
    reps = cut(every.groupBy("label", "label2", "v").agg(F.min("id").alias("id"), F.count("*").alias("w")).withColumn("rep", F.monotonically_increasing_id()))
    keyed = cut(_keyed(reps))
    payload = keyed.drop("cells")
    # a vector may come to one cell twice only by a clash of hashes, which changes nothing
    places = keyed.select("id", F.posexplode("cells").alias("at", "key")).select("key", (F.col("at") % (1 + PROBES) == 0).alias("home"), "id")
    count = places.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("lived")).where("c > 1 and lived")
    count = count.select("key", F.ceil(F.col("c") / PART).cast("int").alias("k"))
    # short rows find the cells where anything meets; only for these do vectors travel
    cells = places.join(count, "key").withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("k")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.expr("sequence(0, k - 1)"))).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))
    cells = cut(cells.select("key", "i", "j", "part", "home", "id"))
    found = cut(_search(cells.join(payload, "id"), cosine), cells, keyed)
    groups = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    per_rep = reps.select(*_vector_key("v"), "id", "rep", "w").join(links, F.col("rep") == F.col("a"), "left").drop("a").join(groups.withColumnRenamed("id", "g"), F.col("rep") == F.col("g"), "left")
    per_rep = per_rep.select("k1", "k2", "id", F.coalesce("component", "rep").alias("root"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("w") - 1).alias("n_links")).where("n_links > 0")
    per_rep = cut(per_rep)
    least = per_rep.groupBy("root").agg(F.min("id").alias("component_id"))
    got = per_rep.join(least, "root").select("k1", "k2", "n_links", "component_id")
    # rows find their vector by 128 bits of it and its label; no vector travels again
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col), *_hashes(label_col), v.alias("v")).select(id_col, *[F.when(_usable(F.col("v")), k).alias(n) for k, n in zip(_vector_key("v"), ("_k1", "_k2"))])
    out = rows.join(got, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")
    component = F.coalesce("component_id", F.col(id_col).cast("long"))
    return out.select(id_col, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col(id_col)).alias("kept"))


def _vector_key(v: str) -> list[Column]:
    return [F.xxhash64("label", "label2", v).alias("k1"), F.xxhash64(F.lit(2), F.col(v), F.col("label2"), F.col("label")).alias("k2")]
