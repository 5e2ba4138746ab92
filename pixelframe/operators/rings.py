"""Outlines of labelled runs as rings, and rings as WKB.

Edges come straight from the ends of runs: every run has a side at each end, and where the runs of two rows differ there
are stretches above or below. Bands of rows chain their own edges, in one Arrow step each; what goes on over a seam stays an
open path, and only the paths of an object meet again. Edges have the inside at their right; where two corners of an
object touch, an outline turns right, so that 4-connected parts stay apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .graph import cut

#: Rows of a band.
BAND = 256
RIGHT, DOWN, LEFT, UP = range(4)
RING = "array<struct<x:double,y:double>>"
_PATH = "label long, closed boolean, area2 long, edges long, first int, last int, ex long, ey long, xs array<long>, ys array<long>"


def _follow(start: np.ndarray, direction: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each edge the one that goes on where it ends (codes of corners): to the right if there is one, else straight on, else
    to the left; -1 for none."""
    code = start * 4 + direction
    order = np.argsort(code, kind="stable")
    known, nxt = code[order], np.full(len(code), -1)
    for turn in (3, 0, 1):  # what comes later goes first
        want = end * 4 + (direction + turn) % 4
        k = np.minimum(np.searchsorted(known, want), max(len(known) - 1, 0))
        hit = known[k] == want if len(known) else np.zeros(0, bool)
        nxt[hit] = order[k[hit]]
    return nxt


def _chains(nxt: np.ndarray) -> tuple[list[np.ndarray], list[bool]]:
    """Edges in order, chain by chain, and whether each closes: pointer doubling finds the cycles, cuts them at their
    smallest edge, and ranks all edges by their distance from the end."""
    n = len(nxt)
    rounds = max(1, int(n).bit_length())
    jump, low = np.append(np.where(nxt < 0, n, nxt), n), np.append(np.arange(n), n)
    for _ in range(rounds):
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    ring = jump[:n] != n
    nxt = nxt.copy()
    last_of_ring = np.flatnonzero(ring & (nxt == low[:n]))
    nxt[last_of_ring] = -1
    jump = np.append(np.where(nxt < 0, n, nxt), n)
    far, end = np.append((nxt >= 0).astype(np.int64), 0), np.append(np.where(nxt < 0, np.arange(n), nxt), n)
    # end: the farthest edge reached so far; far: how many steps it is away
    for _ in range(rounds):
        far, end = far + far[end], end[end]
    order = np.lexsort((-far[:n], end[:n]))
    stops = np.flatnonzero(np.diff(end[:n][order])) + 1
    chains = np.split(order, stops) if n else []
    closed = np.zeros(n + 1, bool)
    closed[last_of_ring] = True
    return chains, [bool(closed[c[-1]]) for c in chains]


def _corners(x: np.ndarray, y: np.ndarray, direction: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a chain starts and turns; a ring begins at its smallest (x, y)."""
    turn = np.r_[True if not closed else direction[0] != direction[-1], direction[1:] != direction[:-1]]
    x, y = x[turn], y[turn]
    if closed:
        k = int(np.lexsort((y, x))[0])
        x, y = np.roll(x, -k), np.roll(y, -k)
    return x, y


def band_paths(labelled: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """keys, label, closed, area2 (twice the signed area under the path), edges (unit edges), first and last direction, end (ex,
    ey), xs, ys: rings within a band of rows, and paths that begin and end at its seams."""
    place = F.floor(F.col("y") / band).cast("int")
    both = F.when(F.pmod("y", F.lit(band)) == band - 1, F.array(place, place + 1)).otherwise(F.array(place))
    rows = labelled.select(*keys, F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), F.col("label").cast("long").alias("label"), F.explode(both).alias("_band"))
    out = T.StructType([labelled.schema[k] for k in keys] + T.StructType.fromDDL(_PATH).fields)

    def run(t: pa.Table) -> pa.Table:
        top = t.column("_band")[0].as_py() * band
        y, x0, x1, label = (t.column(c).to_numpy() for c in ("y", "x0", "x1", "label"))
        names, lab = np.unique(label, return_inverse=True)
        base, wide = int(x0.min()) - 1, int(x1.max() - x0.min()) + 4
        tall = band + 3
        corner = lambda l, py, px: (l * tall + (py - top + 1)) * wide + (px - base)
        # sides of runs; those of the row above the band are there only to be met
        sides = [(lab, x0, y + 1, x0, y, UP), (lab, x1 + 1, y, x1 + 1, y + 1, DOWN)]
        # stretches between two rows: 1 the upper row only, 2 the lower one only
        upper, lower = y + 1 <= top + band - 1, y >= top
        at = np.concatenate([y[upper] + 1, y[upper] + 1, y[lower], y[lower]])
        px = np.concatenate([x0[upper], x1[upper] + 1, x0[lower], x1[lower] + 1])
        of = np.concatenate([lab[upper], lab[upper], lab[lower], lab[lower]])
        step = np.concatenate([np.full(upper.sum(), 1), np.full(upper.sum(), -1), np.full(lower.sum(), 2), np.full(lower.sum(), -2)])
        order = np.lexsort((px, at, of))
        at, px, of, step = at[order], px[order], of[order], step[order]
        state = np.cumsum(step)
        # of several steps at one corner the last one counts
        keep = np.flatnonzero(np.r_[(px[1:] != px[:-1]) | (at[1:] != at[:-1]) | (of[1:] != of[:-1]), True]) if len(px) else np.zeros(0, int)
        at, px, of, state = at[keep], px[keep], of[keep], state[keep]
        changed = np.flatnonzero(np.r_[True, (state[1:] != state[:-1]) | (at[1:] != at[:-1]) | (of[1:] != of[:-1])]) if len(px) else keep
        at, px, of, state = at[changed], px[changed], of[changed], state[changed]
        for kind, direction in ((2, RIGHT), (1, LEFT)):
            k = np.flatnonzero(state == kind)
            a, b = (px[k], px[k + 1]) if direction == RIGHT else (px[k + 1], px[k])
            sides.append((of[k], a, at[k], b, at[k], direction))
        l, ax, ay, bx, by = (np.concatenate([s[i] for s in sides]) for i in range(5))
        direction = np.concatenate([np.full(len(s[0]), s[5]) for s in sides])
        ghost = (np.minimum(ay, by) < top) | ((np.maximum(ay, by) > top + band) & (direction % 2 == 1))
        nxt = _follow(corner(l, ay, ax), direction, corner(l, by, bx))
        own = np.flatnonzero(~ghost)
        number = np.full(len(l) + 1, -1)
        number[own] = np.arange(len(own))
        nxt = number[nxt[own]]
        l, ax, ay, bx, by, direction = (v[own] for v in (l, ax, ay, bx, by, direction))
        chains, closed = _chains(nxt)
        twice = ax * by - bx * ay
        long = np.abs(bx - ax) + np.abs(by - ay)
        found = []
        for c, shut in zip(chains, closed):
            xs, ys = _corners(ax[c], ay[c], direction[c], shut)
            e = c[-1]
            found.append((int(names[l[e]]), shut, int(twice[c].sum()), int(long[c].sum()), int(direction[c[0]]), int(direction[e]), int(bx[e]), int(by[e]), xs, ys))
        cols = list(zip(*found)) if found else [()] * 10
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        ids = pa.array(np.zeros(len(found), np.int64))
        return pa.Table.from_arrays([*[t.column(k).combine_chunks().take(ids) for k in keys], *[pa.array(v, k) for v, k in zip(cols, kinds)]], names=[f.name for f in out.fields])

    return rows.groupBy(*keys, "_band").applyInArrow(run, out)


def object_rings(labelled: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """keys, label, area2 (twice the area, negative for holes), edges, xs, ys: the corners of each ring, the first one not
    repeated. Rings that lie in one band are done there; the open paths of an object are joined by their ends."""
    paths = cut(band_paths(labelled, keys, band))
    out = T.StructType([paths.schema[k] for k in keys] + T.StructType.fromDDL("label long, area2 long, edges long, xs array<long>, ys array<long>").fields)

    def join(t: pa.Table) -> pa.Table:
        xs, ys = ([np.asarray(v.as_py(), np.int64) for v in t.column(c)] for c in ("xs", "ys"))
        first, last, ex, ey, area2, edges = (t.column(c).to_numpy() for c in ("first", "last", "ex", "ey", "area2", "edges"))
        sx, sy = np.array([v[0] for v in xs]), np.array([v[0] for v in ys])
        wide, low_x, low_y = int(max(sx.max(), ex.max()) - min(sx.min(), ex.min())) + 1, min(sx.min(), ex.min()), min(sy.min(), ey.min())
        code = lambda px, py: (py - low_y) * wide + px - low_x
        start, end = code(sx, sy), code(ex, ey)
        # a path goes on where another begins, by the direction that it begins with
        order = np.argsort(start * 4 + first, kind="stable")
        known, nxt = (start * 4 + first)[order], np.full(len(start), -1)
        for turn in (3, 0, 1):
            want = end * 4 + (last + turn) % 4
            k = np.minimum(np.searchsorted(known, want), len(known) - 1)
            hit = known[k] == want
            nxt[hit] = order[k[hit]]
        chains, closed = _chains(nxt)
        if not all(closed):
            raise ValueError("an outline does not close")
        rows = []
        for c in chains:
            # where a path goes straight on into the next one, the corner between them goes
            px = [xs[p][1:] if last[q] == first[p] else xs[p] for q, p in zip(np.roll(c, 1), c)]
            py = [ys[p][1:] if last[q] == first[p] else ys[p] for q, p in zip(np.roll(c, 1), c)]
            x, y = np.concatenate(px), np.concatenate(py)
            k = int(np.lexsort((y, x))[0])
            rows.append((int(area2[c].sum()), int(edges[c].sum()), np.roll(x, -k), np.roll(y, -k)))
        ids = pa.array(np.zeros(len(rows), np.int64))
        cols = list(zip(*rows))
        return pa.Table.from_arrays([*[t.column(k).combine_chunks().take(ids) for k in [*keys, "label"]], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))], names=[f.name for f in out.fields])

    whole = paths.where("closed").select(*[f.name for f in out.fields])
    return whole.unionByName(paths.where("not closed").groupBy(*keys, "label").applyInArrow(join, out))


def polygons(labelled: DataFrame, keys: list[str], x0: float = 0.0, y0: float = 0.0, res: tuple[float, float] = (1.0, 1.0), band: int = BAND) -> DataFrame:
    """keys, label, DN, area and perimeter (pixels), vertices, holes, rings array<ring>: the outer ring first, holes by size;
    closed rings in map coordinates."""
    ring = object_rings(labelled, keys, band)
    p = F.zip_with("xs", "ys", lambda x, y: F.struct((x0 + x * res[0]).cast("double").alias("x"), (y0 + y * res[1]).cast("double").alias("y")))
    ring = ring.withColumn("ring", F.concat(p, F.slice(p, 1, 1))).withColumn("n", F.size("xs"))
    each = F.array_sort(F.collect_list(F.struct((-F.abs("area2")).alias("size"), "xs", "ys", "ring")))
    g = ring.groupBy(*keys, "label").agg((F.sum("area2") / 2).cast("long").alias("area"), F.sum("edges").alias("perimeter"), F.sum("n").alias("vertices"), F.sum((F.col("area2") < 0).cast("int")).alias("holes"), each.alias("r"))
    return g.select(*keys, "label", F.lit(1).alias("DN"), "area", "perimeter", "vertices", "holes", F.transform("r", lambda r: r["ring"]).alias("rings"))


# ------------------------------------------------------------------ WKB

_POINT = np.dtype([("x", "<f8"), ("y", "<f8")])


def to_wkb(rings: Column) -> Column:
    """A polygon's rings (array of arrays of struct<x, y>) as well-known binary, little-endian; null for null or no rings."""

    @F.arrow_udf("binary")
    def encode(v: pa.Array) -> pa.Array:
        out = []
        inner = v.values
        points = inner.values
        xy = np.empty(len(points), _POINT)
        xy["x"], xy["y"] = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        outer, ends = v.offsets.to_numpy(), inner.offsets.to_numpy()
        gone = np.asarray(v.is_null())
        for i in range(len(v)):
            a, b = outer[i], outer[i + 1]
            if gone[i] or a == b:
                out.append(None)
                continue
            parts = [b"\x01" + np.array([3, b - a], "<u4").tobytes()]
            for k in range(a, b):
                parts += [np.array([ends[k + 1] - ends[k]], "<u4").tobytes(), xy[ends[k] : ends[k + 1]].tobytes()]
            out.append(b"".join(parts))
        return pa.array(out, pa.binary())

    return encode(rings)


def from_wkb(wkb: Column) -> Column:
    """The rings of a polygon in well-known binary of either byte order; null for what is no polygon."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def rings_of(b: bytes | None):
        if b is None or len(b) < 9 or b[0] not in (0, 1):
            return None
        e = "<" if b[0] else ">"
        number = lambda at: int(np.frombuffer(b, f"{e}u4", 1, at)[0])
        if number(1) != 3:
            return None
        at, rings = 9, []
        for _ in range(number(5)):
            if at + 4 > len(b) or at + 4 + 16 * (n := number(at)) > len(b):
                return None
            rings.append([{"x": x, "y": y} for x, y in np.frombuffer(b, f"{e}f8", 2 * n, at + 4).reshape(n, 2).tolist()])
            at += 4 + 16 * n
        return rings

    @F.arrow_udf(f"array<{RING}>")
    def decode(v: pa.Array) -> pa.Array:
        return pa.array([rings_of(x.as_py()) for x in v], kind)

    return decode(wkb)
