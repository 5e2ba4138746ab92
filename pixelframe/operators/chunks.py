"""Rasters as chunks: one row for a block of SIZE x SIZE pixels, with one array for each band. Operators that look at
neighbours get a window: a chunk with the rims of the chunks around it. Only chunks and rims are shuffled, never pixels.

A chunk row: the scene's keys, height and width (of the scene), cy, cx (place of the chunk), y0, x0, h, w (its
pixels), and bands: array<double>, row by row; null where there is no pixel. Sizes of windows are bounded by the
chunk's size and the halo, whatever the scene's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bands import normalise

#: Pixels along a chunk's side.
SIZE = 512
PLACE = ["height", "width", "cy", "cx", "y0", "x0", "h", "w"]


@dataclass
class Window:
    """Bands of a chunk with halo pixels on each side; there: which pixels exist. y0, x0: the chunk's own first pixel."""

    bands: dict[str, np.ndarray]
    there: np.ndarray
    halo: int
    y0: int
    x0: int
    h: int
    w: int
    height: int
    width: int

    def own(self, a: np.ndarray) -> np.ndarray:
        return a[self.halo : self.halo + self.h, self.halo : self.halo + self.w]


def _schema(df: DataFrame, keys: list[str], fields: list[tuple[str, str]]) -> T.StructType:
    out = T.StructType([df.schema[k] for k in keys])
    return T.StructType(out.fields + [f for name, kind in fields for f in T.StructType.fromDDL(f"{name} {kind}").fields])


def _values(column: pa.Array) -> np.ndarray:
    """An array column's values, one after the other; NaN for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


def _gaps(column: pa.Array) -> np.ndarray:
    """Where the values of an array column are null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().is_null())


def _list(a: np.ndarray, gaps: np.ndarray | None = None) -> pa.Array:
    return _lists([a], None if gaps is None else [gaps])


def _lists(arrays: list[np.ndarray], gaps: list[np.ndarray] | None = None) -> pa.Array:
    """An array column with one row for each array."""
    flat = np.concatenate([np.asarray(a, np.float64).ravel() for a in arrays]) if arrays else np.zeros(0)
    none = None if gaps is None or not gaps else np.concatenate([g.ravel() for g in gaps])
    ends = np.cumsum([0, *[a.size for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=none))


def _rows(t, places: list[str], bands: list[str]) -> Iterator[tuple[dict, dict, dict]]:
    """For each row of a table or batch its places, and of each band the values (rows of h pixels of w) and where they are null."""
    at = {c: t.column(c).to_pylist() for c in places}
    cols = {b: (c.combine_chunks() if isinstance(c := t.column(b), pa.ChunkedArray) else c) for b in bands}
    flat = {b: (_values(c), _gaps(c), np.asarray(c.offsets) - (c.offsets[0].as_py() if len(c.offsets) else 0)) for b, c in cols.items()}
    for i in range(t.num_rows):
        place = {c: v[i] for c, v in at.items()}
        shape = (place["h"], place["w"])
        values, gaps = {}, {}
        for b, (v, g, ends) in flat.items():
            values[b], gaps[b] = v[ends[i] : ends[i + 1]].reshape(shape), g[ends[i] : ends[i + 1]].reshape(shape)
        yield place, values, gaps


def to_chunks(pixels: DataFrame, keys: list[str], bands: list[str], scenes: DataFrame, size: int = SIZE) -> DataFrame:
    """pixels: keys, y, x, bands; scenes: keys, height, width. A block without any pixel has no row."""
    p = pixels.select(*keys, "y", "x", *[F.col(b).cast("double").alias(b) for b in bands]).join(scenes.select(*keys, "height", "width"), keys)
    p = p.where("y >= 0 and y < height and x >= 0 and x < width").withColumn("cy", F.floor(F.col("y") / size).cast("int")).withColumn("cx", F.floor(F.col("x") / size).cast("int"))

    def gather(t: pa.Table) -> pa.Table:
        height, width, cy, cx = (t.column(c)[0].as_py() for c in ("height", "width", "cy", "cx"))
        y0, x0 = cy * size, cx * size
        h, w = min(size, height - y0), min(size, width - x0)
        at = (t.column("y").to_numpy() - y0) * w + t.column("x").to_numpy() - x0
        row = [t.column(k).slice(0, 1).combine_chunks() for k in keys] + [pa.array([v], pa.int32()) for v in (height, width, cy, cx, y0, x0, h, w)]
        for b in bands:
            a, gaps = np.zeros(h * w), np.ones(h * w, bool)
            c = t.column(b)
            a[at], gaps[at] = c.to_numpy(), np.asarray(c.is_null())
            row.append(_list(a, gaps))
        return pa.Table.from_arrays(row, names=[*keys, *PLACE, *bands])

    return p.groupBy(*keys, "cy", "cx").applyInArrow(gather, _schema(pixels, keys, [(c, "int") for c in PLACE] + [(b, "array<double>") for b in bands]))


def strips_to_chunks(strips: DataFrame, keys: list[str], band: str, scenes: DataFrame, size: int = SIZE) -> DataFrame:
    """strips: keys, y, x0 and band, an array of the pixels from x0 on -> chunks. Whole stretches of rows are shuffled."""
    end = F.col("x0") + F.size(band) - 1
    parts = strips.where(F.size(band) > 0).select(*keys, "y", "x0", band, F.explode(F.sequence(F.floor(F.col("x0") / size).cast("int"), F.floor(end / size).cast("int"))).alias("cx"))
    left = F.greatest(F.col("x0"), F.col("cx") * size)
    right = F.least(end, (F.col("cx") + 1) * size - 1)
    parts = parts.select(*keys, F.floor(F.col("y") / size).cast("int").alias("cy"), "cx", F.col("y").cast("int").alias("y"), left.cast("int").alias("x0"), F.slice(F.col(band).cast("array<double>"), left - F.col("x0") + 1, right - left + 1).alias(band))
    parts = parts.join(scenes.select(*keys, "height", "width"), keys).where("y >= 0 and y < height and cx >= 0 and cx * %d < width" % size)

    def gather(t: pa.Table) -> pa.Table:
        height, width, cy, cx = (t.column(c)[0].as_py() for c in ("height", "width", "cy", "cx"))
        y0, left = cy * size, cx * size
        h, w = min(size, height - y0), min(size, width - left)
        a, gaps = np.zeros((h, w)), np.ones((h, w), bool)
        flat, none = _values(t.column(band)), _gaps(t.column(band))
        sizes = np.asarray(pc.list_value_length(t.column(band)))
        row = np.repeat(t.column("y").to_numpy() - y0, sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(t.column("x0").to_numpy() - left, sizes)
        inside = col < w
        a[row[inside], col[inside]], gaps[row[inside], col[inside]] = flat[inside], none[inside]
        place = [pa.array([v], pa.int32()) for v in (height, width, cy, cx, y0, left, h, w)]
        return pa.Table.from_arrays([*[t.column(k).slice(0, 1).combine_chunks() for k in keys], *place, _list(a, gaps)], names=[*keys, *PLACE, band])

    return parts.groupBy(*keys, "cy", "cx").applyInArrow(gather, _schema(strips, keys, [(c, "int") for c in PLACE] + [(band, "array<double>")]))


def to_pixels(chunks: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """keys, y, x, bands of the pixels where any band has a value."""
    px = chunks.select(*keys, "y0", "x0", "w", F.posexplode(F.arrays_zip(*bands)).alias("_at", "_v"))
    px = px.select(*keys, (F.col("y0") + F.expr("_at div w")).cast("int").alias("y"), (F.col("x0") + F.col("_at") % F.col("w")).cast("int").alias("x"), *[F.col(f"_v.{b}").alias(b) for b in bands])
    return px.where(F.coalesce(*[F.col(b) for b in bands]).isNotNull())


def _sent(chunks: DataFrame, keys: list[str], bands: list[str], targets: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Pieces of chunks: targets(place of a chunk) gives ty, tx and the rectangle y0, y1, x0, x1 (ends exclusive, inside
    the chunk) that goes there -> keys, ty, tx, height, width, y0, x0, h, w, bands. Nothing is shuffled yet."""
    names = [*keys, "ty", "tx", "height", "width", "y0", "x0", "h", "w", *bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, values, gaps) in enumerate(_rows(batch, PLACE, bands)):  # a row is a whole chunk
                found = list(targets(at))
                if not found:
                    continue
                cuts = [np.s_[y0 - at["y0"] : y1 - at["y0"], x0 - at["x0"] : x1 - at["x0"]] for _, _, y0, y1, x0, x1 in found]
                place = zip(*[(ty, tx, at["height"], at["width"], y0, x0, y1 - y0, x1 - x0) for ty, tx, y0, y1, x0, x1 in found])
                ids = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(ids) for k in keys], *[pa.array(v, pa.int32()) for v in place], *[_lists([values[b][c] for c in cuts], [gaps[b][c] for c in cuts]) for b in bands]], names)

    fields = [(c, "int") for c in names[len(keys) : len(names) - len(bands)]] + [(b, "array<double>") for b in bands]
    return chunks.select(*keys, *PLACE, *bands).mapInArrow(run, _schema(chunks, keys, fields))


def _assembled(t: pa.Table, bands: list[str], y0: int, x0: int, h: int, w: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Bands of the rectangle from the pieces of t (NaN where there is nothing), and where they have values."""
    out, there = {b: np.full((h, w), np.nan) for b in bands}, {b: np.zeros((h, w), bool) for b in bands}
    for at, values, gaps in _rows(t, ["y0", "x0", "h", "w"], bands):
        py, px = at["y0"], at["x0"]
        a, b, c, d = max(py, y0), min(py + at["h"], y0 + h), max(px, x0), min(px + at["w"], x0 + w)
        if a >= b or c >= d:
            continue
        to, of = np.s_[a - y0 : b - y0, c - x0 : d - x0], np.s_[a - py : b - py, c - px : d - px]
        for band in bands:
            out[band][to] = values[band][of]
            there[band][to] = ~gaps[band][of]
    return out, there


def map_windows(chunks: DataFrame, keys: list[str], bands: list[str], halo: int, fn: Callable[[Window], dict[str, np.ndarray]], out: list[str], size: int = SIZE) -> DataFrame:
    """Chunks with the bands out: what fn makes of each chunk's window (arrays of the chunk's own size; NaN counts as a
    value). A pixel is there if its first band has a value, and has a value in the result only then. The halo may be
    wider than a chunk."""

    def around(at: dict) -> Iterator[tuple]:
        y1, x1 = at["y0"] + at["h"], at["x0"] + at["w"]
        for ty in range(max(0, (at["y0"] - halo) // size), (min(at["height"], y1 + halo) - 1) // size + 1):
            for tx in range(max(0, (at["x0"] - halo) // size), (min(at["width"], x1 + halo) - 1) // size + 1):
                a, b = max(at["y0"], ty * size - halo), min(y1, (ty + 1) * size + halo)
                c, d = max(at["x0"], tx * size - halo), min(x1, (tx + 1) * size + halo)
                if a < b and c < d:
                    yield ty, tx, a, b, c, d

    names = [*keys, *PLACE, *out]
    schema = _schema(chunks, keys, [(c, "int") for c in PLACE] + [(b, "array<double>") for b in out])

    def run(t: pa.Table) -> pa.Table:
        ty, tx, height, width = (t.column(c)[0].as_py() for c in ("ty", "tx", "height", "width"))
        y0, x0 = ty * size, tx * size
        h, w = min(size, height - y0), min(size, width - x0)
        values, there = _assembled(t, bands, y0 - halo, x0 - halo, h + 2 * halo, w + 2 * halo)
        window = Window(values, there[bands[0]], halo, y0, x0, h, w, height, width)
        own = window.own(window.there)
        if not own.any():
            return pa.Table.from_batches([], schema=pa.schema([(k, t.schema.field(k).type) for k in keys] + [(c, pa.int32()) for c in PLACE] + [(b, pa.list_(pa.float64())) for b in out]))
        made = fn(window)
        place = [pa.array([v], pa.int32()) for v in (height, width, ty, tx, y0, x0, h, w)]
        return pa.Table.from_arrays([*[t.column(k).slice(0, 1).combine_chunks() for k in keys], *place, *[_list(made[b], ~own) for b in out]], names=names)

    return _sent(chunks, keys, bands, around).groupBy(*keys, "ty", "tx").applyInArrow(run, schema)


# ------------------------------------------------------------------ windows


def focal_mean(chunks: DataFrame, keys: list[str], band: str, r: int, out: str = "focal_mean", size: int = SIZE) -> DataFrame:
    """Mean over the disk of radius r, of the pixels that are there. Sums along rows once; the disk is one difference of
    them for each of its 2 r + 1 rows."""

    def fn(win: Window) -> dict[str, np.ndarray]:
        there = win.there & ~np.isnan(win.bands[band])
        nan = win.there & np.isnan(win.bands[band])
        sums = [np.pad(np.cumsum(a, axis=1, dtype=np.float64), ((0, 0), (1, 0))) for a in (np.where(there, win.bands[band], 0.0), win.there, nan)]
        total = [np.zeros((win.h, win.w)) for _ in sums]
        for d in range(-r, r + 1):
            half = int((r * r - d * d) ** 0.5)
            rows = slice(r + d, r + d + win.h)
            for t, s in zip(total, sums):
                t += s[rows, r + half + 1 : r + half + 1 + win.w] - s[rows, r - half : r - half + win.w]
        mean = total[0] / np.maximum(total[1], 1)
        return {out: np.where(total[2] > 0.5, np.nan, mean)}

    return map_windows(chunks, keys, [band], r, fn, [out], size)


def _column_distance(other: np.ndarray, far: float) -> np.ndarray:
    """Rows to the nearest true pixel of the same column, far if there is none."""
    n = len(other)
    row = np.arange(n)[:, None]
    before = np.maximum.accumulate(np.where(other, row, -(10**9)), axis=0)
    behind = np.minimum.accumulate(np.where(other, row, 10**9)[::-1], axis=0)[::-1]
    return np.minimum(np.minimum(row - before, behind - row), far)


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (x - q)^2 + f[., q] for each row and place x: the envelope of parabolas. Columns are taken one after
    the other, all rows at once; a row drops its last parabolas as long as the new one hides them."""
    rows, n = f.shape
    at = np.arange(rows)
    places, edges, last = np.zeros((rows, n), np.int64), np.full((rows, n + 1), np.inf), np.zeros(rows, np.int64)
    edges[:, 0] = -np.inf
    for q in range(1, n):
        todo = np.ones(rows, bool)
        while todo.any():
            i = at[todo]
            v = places[i, last[i]]
            s = ((f[i, q] + q * q) - (f[i, v] + v * v)) / (2.0 * (q - v))
            hidden = s <= edges[i, last[i]]
            last[i[hidden]] -= 1
            done = i[~hidden]
            last[done] += 1
            places[done, last[done]] = q
            edges[done, last[done]] = s[~hidden]
            edges[done, last[done] + 1] = np.inf
            todo[done] = False
    out, k = np.empty_like(f, dtype=np.float64), np.zeros(rows, np.int64)
    for x in range(n):
        while (more := edges[at, k + 1] < x).any():
            k += more
        v = places[at, k]
        out[:, x] = (x - v) ** 2 + f[at, v]
    return out


def signed_distance(chunks: DataFrame, keys: list[str], band: str, t: int = 16, out: str = "distance", size: int = SIZE) -> DataFrame:
    """Distance to the nearest pixel of the other class, at most t, over t; negative outside (class 0). Exact: distances
    along columns, then the lower envelope of parabolas along rows, whose cost does not depend on t."""
    far = 4.0 * (t + size)

    def fn(win: Window) -> dict[str, np.ndarray]:
        one = win.there & (win.bands[band] == 1)
        rows = slice(win.halo, win.halo + win.h)
        best = []
        for other in (win.there & ~one, one):
            g = _column_distance(other, far)[rows].astype(np.float64)
            best.append(lower_envelope(g * g)[:, win.halo : win.halo + win.w])
        own = win.own(one)
        d = np.sqrt(np.minimum(np.where(own, best[0], best[1]), t * t)) / t
        return {out: np.where(own, d, -d)}

    return map_windows(chunks, keys, [band], t, fn, [out], size)


# ------------------------------------------------------------------ scoring


def _starts(size: int, patch: int, margin: int) -> np.ndarray:
    """First rows of patches: steps of patch - margin, the last ones moved inside; repeats count twice."""
    return np.minimum(np.arange(0, size, patch - margin), size - patch)


def _ramp(patch: int, margin: int) -> np.ndarray:
    i = np.arange(patch)
    step = 1.0 / (margin - 1) if margin > 1 else 1.0
    one = np.minimum(1.0, np.minimum(i * step, (patch - 1 - i) * step))
    return one[:, None] * one[None, :]


def score_patches(chunks: DataFrame, keys: list[str], bands: list[str], scorer: Callable[[np.ndarray], np.ndarray], patch: int, margin: int, out: str = "p", size: int = SIZE) -> DataFrame:
    """Chunks with the band out: sum(w * score) / sum(w) over the patches that hold the pixel, 0 where the weights are 0.

    The scorer takes one whole patch (bands, patch, patch), 0 where there is no pixel, and gives scores (patch, patch). Rectangles
    of chunks go to patches, each patch is scored once, and rectangles of weighted scores go back to chunks."""

    def to_patches(at: dict) -> Iterator[tuple]:
        if at["height"] < patch or at["width"] < patch:
            raise ValueError("scene smaller than a patch")
        rows, cols = _starts(at["height"], patch, margin), _starts(at["width"], patch, margin)
        y1, x1 = at["y0"] + at["h"], at["x0"] + at["w"]
        for i in np.flatnonzero((rows < y1) & (rows + patch > at["y0"])).tolist():
            for j in np.flatnonzero((cols < x1) & (cols + patch > at["x0"])).tolist():
                yield i, j, max(at["y0"], int(rows[i])), min(y1, int(rows[i]) + patch), max(at["x0"], int(cols[j])), min(x1, int(cols[j]) + patch)

    weights = _ramp(patch, margin)
    back = [*keys, "cy", "cx", "ty", "tx", "height", "width", "y0", "x0", "h", "w", "a", "b"]
    fields = [(c, "int") for c in back[len(keys) : -2]] + [("a", "array<double>"), ("b", "array<double>")]

    def score(t: pa.Table) -> pa.Table:
        i, j, height, width = (t.column(c)[0].as_py() for c in ("ty", "tx", "height", "width"))
        y0, x0 = int(_starts(height, patch, margin)[i]), int(_starts(width, patch, margin)[j])
        values, there = _assembled(t, bands, y0, x0, patch, patch)
        a = weights * scorer(np.stack([np.where(there[b], values[b], 0.0) for b in bands]))
        places, cuts = [], []
        for cy in range(y0 // size, (y0 + patch - 1) // size + 1):
            for cx in range(x0 // size, (x0 + patch - 1) // size + 1):
                r0, r1 = max(y0, cy * size), min(y0 + patch, (cy + 1) * size)
                c0, c1 = max(x0, cx * size), min(x0 + patch, (cx + 1) * size)
                cuts.append(np.s_[r0 - y0 : r1 - y0, c0 - x0 : c1 - x0])
                places.append((cy, cx, i, j, height, width, r0, c0, r1 - r0, c1 - c0))
        ids = pa.array(np.zeros(len(cuts), np.int64))
        return pa.Table.from_arrays([*[t.column(k).combine_chunks().take(ids) for k in keys], *[pa.array(v, pa.int32()) for v in zip(*places)], _lists([a[c] for c in cuts]), _lists([weights[c] for c in cuts])], names=back)

    def blend(t: pa.Table) -> pa.Table:
        cy, cx, height, width = (t.column(c)[0].as_py() for c in ("cy", "cx", "height", "width"))
        y0, x0 = cy * size, cx * size
        h, w = min(size, height - y0), min(size, width - x0)
        total = np.zeros((2, h, w))
        # in order of patches, so that reruns agree
        for at, values, _ in sorted(_rows(t, ["ty", "tx", "y0", "x0", "h", "w"], ["a", "b"]), key=lambda r: (r[0]["ty"], r[0]["tx"])):
            to = np.s_[at["y0"] - y0 : at["y0"] - y0 + at["h"], at["x0"] - x0 : at["x0"] - x0 + at["w"]]
            for k, c in enumerate(("a", "b")):
                total[k][to] += values[c]
        p = np.where(total[1] > 0, total[0] / np.where(total[1] > 0, total[1], 1.0), 0.0)
        place = [pa.array([v], pa.int32()) for v in (height, width, cy, cx, y0, x0, h, w)]
        return pa.Table.from_arrays([*[t.column(k).slice(0, 1).combine_chunks() for k in keys], *place, _list(p)], names=[*keys, *PLACE, out])

    scored = _sent(chunks, keys, bands, to_patches).groupBy(*keys, "ty", "tx").applyInArrow(score, _schema(chunks, keys, fields))
    return scored.groupBy(*keys, "cy", "cx").applyInArrow(blend, _schema(chunks, keys, [(c, "int") for c in PLACE] + [(out, "array<double>")]))


def score_scenes(chunks: DataFrame, keys: list[str], factors: dict[str, float], scorer: Callable[[np.ndarray], np.ndarray], patch: int, margin: int, t: float = 0.5, size: int = SIZE, decimals: int | None = None) -> DataFrame:
    """Chunks with p and b: bands with NaN as 0 over their factors, patches scored by scorer (logits) and blended by their
    sigmoids; a pixel whose bands are all 0, or that is not there, is nodata: p NaN and b 255, else b is p > t."""
    bands = list(factors)

    def normal(f: float) -> Callable[[Column], Column]:
        return lambda v: F.when(v.isNotNull(), normalise(v, float(f)))

    ready = chunks.select(*keys, *PLACE, *[F.transform(b, normal(f)).alias(b) for b, f in factors.items()])
    scored = score_patches(ready, keys, bands, lambda a: 1 / (1 + np.exp(-scorer(a))), patch, margin, "_p", size)
    both = ready.select(*keys, "cy", "cx", *bands).join(scored, [*keys, "cy", "cx"])
    void = F.transform(F.arrays_zip(*bands), lambda v: F.forall(F.array(*[v[b] for b in bands]), lambda x: F.coalesce(x == 0, F.lit(True))))
    p = F.col("_p") if decimals is None else F.transform("_p", lambda v: F.round(v, decimals))
    both = both.withColumn("p", F.zip_with(p, void, lambda v, n: F.when(n, F.lit(float("nan"))).otherwise(v)))
    b = F.transform("p", lambda v: F.when(F.isnan(v), 255.0).otherwise(F.when(v > t, 1.0).otherwise(0.0)))
    return both.select(*keys, *PLACE, "p", b.alias("b"))


# ------------------------------------------------------------------ runs and chunks


def band_runs(chunks: DataFrame, keys: list[str], band: str, at_least: float, inclusive: bool = True) -> DataFrame:
    """keys, y, x0, x1: runs of band >= at_least (or >), NaN is not. Runs are found in each chunk and joined up where chunks
    meet; what is shuffled are runs."""
    from .runs import merge_runs

    names = [*keys, "y", "x0", "x1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                y0, x0, h, w = (row.column(c)[0].as_py() for c in ("y0", "x0", "h", "w"))
                a = _values(row.column(band)).reshape(h, w)
                with np.errstate(invalid="ignore"):
                    on = np.pad((a >= at_least) if inclusive else (a > at_least), ((0, 0), (1, 1))).astype(np.int8)
                step = np.diff(on, axis=1)
                y, first = np.nonzero(step == 1)
                last = np.nonzero(step == -1)[1] - 1
                ids = pa.array(np.zeros(len(y), np.int64))
                yield pa.RecordBatch.from_arrays([*[row.column(k).take(ids) for k in keys], *[pa.array(v, pa.int32()) for v in (y + y0, first + x0, last + x0)]], names)

    found = chunks.select(*keys, "y0", "x0", "h", "w", band).mapInArrow(run, _schema(chunks, keys, [(c, "int") for c in ("y", "x0", "x1")]))
    return merge_runs(found, keys)


def row_sums(chunks: DataFrame, keys: list[str], band: str) -> DataFrame:
    """keys, y, cx, left, sums, counts: for each row of each chunk the sums and numbers of its values up to each place
    (w + 1 entries each), so that any interval of the row costs two lookups."""
    names = [*keys, "y", "cx", "left", "sums", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                cx, y0, x0, h, w = (row.column(c)[0].as_py() for c in ("cx", "y0", "x0", "h", "w"))
                there = ~_gaps(row.column(band)).reshape(h, w)
                a = np.where(there, _values(row.column(band)).reshape(h, w), 0.0)
                offsets = pa.array(np.arange(h + 1) * (w + 1), pa.int32())
                sums, counts = (np.pad(np.cumsum(v, axis=1), ((0, 0), (1, 0))).ravel() for v in (a, there))
                ids = pa.array(np.zeros(h, np.int64))
                place = [pa.array(np.arange(y0, y0 + h), pa.int32()), pa.array(np.full(h, cx), pa.int32()), pa.array(np.full(h, x0), pa.int32())]
                yield pa.RecordBatch.from_arrays([*[row.column(k).take(ids) for k in keys], *place, pa.ListArray.from_arrays(offsets, pa.array(sums)), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))], names)

    fields = [("y", "int"), ("cx", "int"), ("left", "int"), ("sums", "array<double>"), ("counts", "array<long>")]
    return chunks.select(*keys, "cx", "y0", "x0", "h", "w", band).mapInArrow(run, _schema(chunks, keys, fields))


def zonal_sums(runs: DataFrame, chunks: DataFrame, keys: list[str], ident: str, band: str, size: int = SIZE) -> DataFrame:
    """ident, n (pixels of its runs), there (those that have a value), total: two lookups for each run and chunk."""
    parts = runs.select(*keys, ident, "y", "x0", "x1").withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / size).cast("int"), F.floor(F.col("x1") / size).cast("int"))))
    parts = parts.select(*keys, ident, F.col("y").cast("int").alias("y"), "cx", F.greatest("x0", F.col("cx") * size).alias("x0"), F.least("x1", (F.col("cx") + 1) * size - 1).alias("x1"))
    met = parts.join(row_sums(chunks, keys, band), [*keys, "y", "cx"], "left")
    end = lambda c: F.get(c, F.least(F.col("x1") - F.col("left") + 1, F.size(c) - 1)) - F.get(c, F.least(F.col("x0") - F.col("left"), F.size(c) - 1))
    sums = met.groupBy(ident).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("n"), F.coalesce(F.sum(end("counts")), F.lit(0)).cast("long").alias("there"), F.coalesce(F.sum(end("sums")), F.lit(0.0)).alias("total"))
    return sums
