"""Components of all thresholds at once: one tree of merges for each scene.

Pixels are taken in order of falling score. A node of the tree is a component between two thresholds where nothing
joins it; its parent is what it merges into. Each chunk makes its own tree in one Arrow step. What cannot reach a seam is settled
there; the rest (ancestors of pixels at seams, bounded by the chunks' rims) goes to one task for each scene, where the same
merge joins the trees. Overlaps with target objects go up the tree only while a match is still possible: an object that has
grown beyond area(target) / iou can match that target no more, nor can anything it merges into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .chunks import SIZE, _values
from .graph import cut
from .runs import joined_up

_SPINE = [("lo", "array<long>"), ("hi", "array<long>"), ("level", "array<long>"), ("parent", "array<long>"), ("area", "array<long>"), ("e_node", "array<long>"), ("e_target", "array<long>"), ("e_area", "array<long>"), ("e_count", "array<long>"), ("at", "array<long>"), ("at_node", "array<long>")]


def merge_tree(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices with levels and links a-b, which hold from the lower level of their ends down -> the node of each vertex,
    and the parent (-1 for none) and level of each node. Children come before their parents."""
    n = len(level)
    root, node_of, node = np.arange(n), np.full(n, -1), np.full(n, -1)
    parent, of_level, count = np.full(n, -1), np.zeros(n, np.int64), 0
    weight = np.minimum(level[a], level[b])
    links, vertices = np.argsort(-weight, kind="stable"), np.argsort(-level, kind="stable")
    steps = np.unique(level)[::-1]
    link_ends, vertex_ends = np.searchsorted(-weight[links], -steps, side="right"), np.searchsorted(-level[vertices], -steps, side="right")
    seen = at = 0

    def find(x: np.ndarray) -> np.ndarray:
        r = root[x]
        while (root[r] != r).any():
            r = root[r]
        root[x] = r
        return r

    for step, link_end, vertex_end in zip(steps, link_ends, vertex_ends):
        own, new = links[seen:link_end], vertices[at:vertex_end]
        seen, at = link_end, vertex_end
        ra, rb = find(a[own]), find(b[own])
        ends = np.unique(np.concatenate([new, ra, rb]))
        joined = joined_up(len(ends), np.searchsorted(ends, ra), np.searchsorted(ends, rb))
        root[ends] = ends[joined]
        first, group = np.unique(joined, return_inverse=True)
        ids = count + np.arange(len(first))
        old = node_of[ends]
        parent[old[old >= 0]] = ids[group[old >= 0]]
        node[ends[old < 0]] = ids[group[old < 0]]
        node_of[ends[first]] = ids
        of_level[ids] = step
        count += len(first)
    return node, parent[:count], of_level[:count]


def settle(node: np.ndarray, parent: np.ndarray, level: np.ndarray, area: np.ndarray, entries: tuple, border: np.ndarray, steps: int, iou: float, min_size: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Objects and hits at each of the thresholds 1 .. steps, of the nodes that do not reach a border vertex, and what hangs
    on those that do (the spine). area: of vertices; entries: vertex, target, its area, common pixels."""
    m = len(parent)
    own, low, open_ = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    np.add.at(own, node, area)
    np.add.at(low, node, area)
    open_[node[border]] = True
    by = np.argsort(-level, kind="stable")
    falling = np.unique(level)[::-1]
    stops = np.searchsorted(-level[by], -falling, side="right")
    groups = np.split(by, stops[:-1]) if m else []
    for ids in groups:
        up = ids[parent[ids] >= 0]
        np.add.at(low, parent[up], low[up])
        open_[parent[up[open_[up]]]] = True
        closed = up[~open_[up]]
        np.add.at(own, parent[closed], own[closed])
    floor = np.where(parent >= 0, level[np.maximum(parent, 0)], 0)
    objects, hits = np.zeros(steps + 2, np.int64), np.zeros(steps + 2, np.int64)

    def count(into: np.ndarray, ids: np.ndarray) -> None:
        """One more for all thresholds over the parent's, up to the node's own."""
        np.add.at(into, floor[ids] + 1, 1)
        np.add.at(into, level[ids] + 1, -1)

    count(objects, np.flatnonzero(~open_ & (own >= min_size)))
    vertex, target, size, common = entries
    waiting: dict[int, list] = {int(l): [] for l in falling}
    at = node[vertex]
    for l in falling:
        k = level[at] == l
        if k.any():
            waiting[int(l)].append((at[k], target[k], size[k], common[k]))
    hanging = []
    for l in falling:
        parts = waiting.pop(int(l))
        if not parts:
            continue
        at, t, size, c = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((t, at))
        at, t, size, c = at[order], t[order], size[order], c[order]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (t[1:] != t[:-1])]) if len(at) else np.zeros(0, int)
        at, t, size, c = at[first], t[first], size[first], np.add.reduceat(c, first) if len(first) else c
        done = ~open_[at]
        match = done & (own[at] >= min_size) & (c / (size + own[at] - c) >= iou)
        count(hits, at[match])
        stay = ~done & (size >= iou * low[at] * (1 - 1e-12))
        hanging.append((at[stay], t[stay], size[stay], c[stay]))
        to = parent[at]
        go = done & (to >= 0)
        go[go] &= size[go] >= iou * low[to[go]] * (1 - 1e-12)
        to, t, size, c = to[go], t[go], size[go], c[go]
        for q in np.unique(level[to]):
            k = level[to] == q
            waiting[int(q)].append((to[k], t[k], size[k], c[k]))
    spine = np.flatnonzero(open_)
    number = np.full(m + 1, -1)
    number[spine] = np.arange(len(spine))
    hang = [np.concatenate(x) if hanging else np.zeros(0, np.int64) for x in (zip(*hanging) if hanging else [()] * 4)]
    left = {"level": level[spine], "parent": number[parent[spine]], "area": own[spine], "e_node": number[hang[0]], "e_target": hang[1], "e_area": hang[2], "e_count": hang[3], "at_node": number[node[border]]}
    return np.cumsum(objects)[1 : steps + 1], np.cumsum(hits)[1 : steps + 1], left


def component_curves(chunks: DataFrame, keys: list[str], band: str, thresholds: list[float], targets: DataFrame | None = None, iou: float = 0.5, min_size: int = 1, connectivity: int = 8, size: int = SIZE) -> DataFrame:
    """keys, threshold, objects, hits: the components of band >= threshold of at least min_size pixels, and the pairs of
    these and target objects whose intersection over union is at least iou. targets: labelled runs (keys, y, x0, x1,
    label). One pass for all thresholds; NaN is below all of them."""
    grid = np.array(sorted(set(thresholds)), dtype=np.float64)
    steps = len(grid)
    side = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    if targets is None:
        more = T.StructType.fromDDL("cy int, cx int, y int, x0 int, x1 int, label long, area long").fields
        runs = chunks.sparkSession.createDataFrame([], T.StructType([*[chunks.schema[k] for k in keys], *more]))
    else:
        sizes = targets.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"))
        runs = targets.join(sizes, [*keys, "label"]).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / size).cast("int"), F.floor(F.col("x1") / size).cast("int"))))
        runs = runs.select(*keys, F.floor(F.col("y") / size).cast("int").alias("cy"), "cx", F.col("y").cast("int").alias("y"), F.greatest("x0", F.col("cx") * size).cast("int").alias("x0"), F.least("x1", (F.col("cx") + 1) * size - 1).cast("int").alias("x1"), F.col("label").cast("long").alias("label"), "area")

    def row(t: pa.Table, objects: np.ndarray, hits: np.ndarray, **left: np.ndarray) -> pa.Table:
        cols = {"lo": objects, "hi": hits, **left}
        one = [pa.ListArray.from_arrays(pa.array([0, len(cols[c])], pa.int32()), pa.array(np.asarray(cols[c], np.int64))) for c, _ in _SPINE if c in cols]
        return pa.Table.from_arrays([*[t.column(k).slice(0, 1).combine_chunks() for k in keys], *one], names=[*keys, *[c for c, _ in _SPINE if c in cols]])

    def local(chunk: pa.Table, own: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table({**{k: own.column(k).slice(0, 0) for k in keys}, **{c: pa.array([], pa.list_(pa.int64())) for c, _ in _SPINE}})
        height, width, y0, x0, h, w = (chunk.column(c)[0].as_py() for c in ("height", "width", "y0", "x0", "h", "w"))
        score = _values(chunk.column(band)).reshape(h, w)
        level = np.where(np.isnan(score), 0, np.searchsorted(grid, np.nan_to_num(score), side="right")).astype(np.int64)
        y, x = np.nonzero(level)
        number = np.full((h, w), -1)
        number[y, x] = np.arange(len(y))
        a, b = [], []
        for dy, dx in side:
            p = number[: h - dy, max(0, -dx) : w - max(0, dx)]
            q = number[dy:, max(0, dx) : w + min(0, dx)]
            ok = (p >= 0) & (q >= 0)
            a.append(p[ok])
            b.append(q[ok])
        node, parent, of_level = merge_tree(level[y, x], np.concatenate(a), np.concatenate(b))
        border = np.flatnonzero(((y == 0) & (y0 > 0)) | ((x == 0) & (x0 > 0)) | ((y == h - 1) & (y0 + h < height)) | ((x == w - 1) & (x0 + w < width)))
        label, area = np.full(h * w, -1), np.zeros(h * w, np.int64)
        first, last = own.column("x0").to_numpy() - x0, own.column("x1").to_numpy() - x0
        long = last - first + 1
        at = np.repeat((own.column("y").to_numpy() - y0) * w + first, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        label[at], area[at] = np.repeat(own.column("label").to_numpy(), long), np.repeat(own.column("area").to_numpy(), long)
        label, area = label[y * w + x], area[y * w + x]
        met = np.flatnonzero(label >= 0)
        # pixels of one node and target count together
        pair, back, common = np.unique(np.stack([node[met], label[met]]), axis=1, return_index=True, return_counts=True) if len(met) else (np.zeros((2, 0), int), np.zeros(0, int), np.zeros(0, int))
        objects, hits, left = settle(node, parent, of_level, np.ones(len(y), np.int64), (met[back], pair[1], area[met[back]], common), border, steps, iou, min_size)
        return row(chunk, objects, hits, at=(y[border] + y0) * width + x[border] + x0, **left)

    def joined(t: pa.Table) -> pa.Table:
        """The trees of one scene's chunks, joined at the seams."""
        get = lambda c: [np.asarray(v.as_py(), dtype=np.int64) for v in t.column(c)]
        level, parent, area, at, width = get("level"), get("parent"), get("area"), get("at"), t.column("width")[0].as_py()
        start = np.cumsum([0, *[len(v) for v in level]])
        whose = np.repeat(np.arange(len(at)), [len(v) for v in at])
        pixel, vertex = np.concatenate(at), np.concatenate([v + s for v, s in zip(get("at_node"), start)])
        order = np.argsort(pixel, kind="stable")
        a, b = [], []
        for v, s in zip(parent, start):
            a.append(np.flatnonzero(v >= 0) + s)
            b.append(v[v >= 0] + s)
        y, x = pixel // width, pixel % width
        for dy, dx in side:
            ok = (x + dx >= 0) & (x + dx < width)
            want = (y + dy) * width + x + dx
            k = np.minimum(np.searchsorted(pixel[order], want), max(len(pixel) - 1, 0))
            if len(pixel):
                other = order[k]
                ok &= (pixel[other] == want) & (whose[other] != whose)
                a.append(vertex[ok])
                b.append(vertex[other[ok]])
        node, up, of_level = merge_tree(np.concatenate(level), np.concatenate(a), np.concatenate(b))
        entries = (np.concatenate([v + s for v, s in zip(get("e_node"), start)]), *[np.concatenate(get(c)) for c in ("e_target", "e_area", "e_count")])
        objects, hits, _ = settle(node, up, of_level, np.concatenate(area), entries, np.zeros(0, int), steps, iou, min_size)
        return row(t, objects + sum(get("lo")), hits + sum(get("hi")))

    fields = [chunks.schema[k] for k in keys]
    wide = T.StructType(fields + T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in _SPINE)).fields)
    trees = chunks.groupBy(*keys, "cy", "cx").cogroup(runs.groupBy(*keys, "cy", "cx")).applyInArrow(local, wide)
    trees = cut(trees).join(chunks.select(*keys, "width").distinct(), keys)
    found = trees.groupBy(*keys).applyInArrow(joined, T.StructType(fields + T.StructType.fromDDL("lo array<long>, hi array<long>").fields))
    each = found.select(*keys, F.posexplode(F.arrays_zip("lo", "hi")).alias("_k", "_v"))
    return each.select(*keys, F.get(F.array(*[F.lit(float(g)) for g in grid]), F.col("_k")).alias("threshold"), F.col("_v.lo").alias("objects"), F.col("_v.hi").alias("hits"))
