"""Rasters on other grids and in other coordinate systems, and mosaics of tiles with their own origins, as chunks.

A target chunk asks for what it needs: the places of its pixels in the source are worked out, the box around them tells
which source chunks come, and each is cut to that box before it travels. No pixel is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import PLACE, SIZE, _assembled, _gaps, _list, _schema, _values
from .vector import from_lonlat, numpy_math, to_lonlat

GRID = "struct<x0:double,y0:double,xres:double,yres:double,height:int,width:int>"


def _places(grid: dict, source: dict, epsg: int, source_epsg: int, y0: int, x0: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column in the source (pixel centres are whole numbers) of the centres of h x w target pixels; NaN where the
    coordinate systems do not meet."""
    x = grid["x0"] + (np.arange(x0, x0 + w) + 0.5)[None, :] * grid["xres"] + np.zeros((h, 1))
    y = grid["y0"] + (np.arange(y0, y0 + h) + 0.5)[:, None] * grid["yres"] + np.zeros((1, w))
    if epsg != source_epsg:
        with np.errstate(all="ignore"):
            x, y = from_lonlat(*to_lonlat(x, y, epsg, numpy_math), source_epsg, numpy_math)
    return (y - source["y0"]) / source["yres"] - 0.5, (x - source["x0"]) / source["xres"] - 0.5


def _kernel(d: np.ndarray, a: float = -0.5) -> np.ndarray:
    d = np.abs(d)
    return np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0.0))


def _sample(fy: np.ndarray, fx: np.ndarray, values: np.ndarray, there: np.ndarray, top: int, left: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Values at the places and which are there: those whose nearest source pixel is. cubic: weighted by the 4 x 4 pixels
    around that are there."""
    ok = np.isfinite(fy) & np.isfinite(fx)
    fy, fx = np.where(ok, fy, -1e9), np.where(ok, fx, -1e9)

    def at(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, c = r - top, c - left
        inside = (r >= 0) & (c >= 0) & (r < values.shape[0]) & (c < values.shape[1])
        r, c = np.where(inside, r, 0), np.where(inside, c, 0)
        return values[r, c], inside & there[r, c]

    near, found = at(np.floor(fy + 0.5).astype(np.int64), np.floor(fx + 0.5).astype(np.int64))
    if method == "nearest":
        return near, found
    y, x = np.floor(fy).astype(np.int64), np.floor(fx).astype(np.int64)
    total, weight = np.zeros_like(fy), np.zeros_like(fy)
    for i in range(-1, 3):
        for j in range(-1, 3):
            v, ok = at(y + i, x + j)
            k = np.where(ok, _kernel(fy - y - i) * _kernel(fx - x - j), 0.0)
            total += k * np.where(ok, v, 0.0)
            weight += k
    return total / np.where(weight == 0, 1.0, weight), found & (weight != 0)


def warp(chunks: DataFrame, keys: list[str], band: str, grids: DataFrame, source_epsg: int, epsg: int, method: str = "nearest", size: int = SIZE, source_size: int = SIZE) -> DataFrame:
    """Chunks of band on other grids. grids: keys, source and target (GRID each; sizes in pixels); method nearest or cubic.
    Where a target pixel is coarser than a source pixel, a chunk's box holds as many source pixels more: take a smaller
    size then."""
    if method not in ("nearest", "cubic"):
        raise ValueError(f"no method {method}")
    t = grids.select(*keys, F.col("source").cast(GRID).alias("source"), F.col("target").cast(GRID).alias("target"))
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(f"target.{c}") - 1) / size).cast("int")))
    t = t.where("target.height > 0 and target.width > 0").withColumn("ty", steps("height")).withColumn("tx", steps("width"))
    asks = [*keys, "source", "target", "ty", "tx", "cy", "cx", "top", "bottom", "left", "right"]

    def box(grid: dict, source: dict, ty: int, tx: int) -> tuple:
        h, w = min(size, grid["height"] - ty * size), min(size, grid["width"] - tx * size)
        return _places(grid, source, epsg, source_epsg, ty * size, tx * size, h, w)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                source, grid, ty, tx = (row.column(c)[0].as_py() for c in ("source", "target", "ty", "tx"))
                fy, fx = box(grid, source, ty, tx)
                ok = np.isfinite(fy) & np.isfinite(fx)
                if not ok.any():
                    continue
                top, bottom = max(0, int(np.floor(fy[ok].min())) - 1), min(source["height"] - 1, int(np.floor(fy[ok].max())) + 2)
                left, right = max(0, int(np.floor(fx[ok].min())) - 1), min(source["width"] - 1, int(np.floor(fx[ok].max())) + 2)
                need = [(cy, cx) for cy in range(top // source_size, bottom // source_size + 1) for cx in range(left // source_size, right // source_size + 1)] if top <= bottom and left <= right else []
                if need:
                    ids = pa.array(np.zeros(len(need), np.int64))
                    more = [[p[0] for p in need], [p[1] for p in need], *[[v] * len(need) for v in (top, bottom, left, right)]]
                    yield pa.RecordBatch.from_arrays([*[row.column(c).take(ids) for c in asks[: len(keys) + 4]], *[pa.array(v, pa.int32()) for v in more]], asks)

    wide = _schema(t, [*keys, "source", "target", "ty", "tx"], [(c, "int") for c in asks[len(keys) + 4 :]])
    wanted = t.mapInArrow(ask, wide)
    met = wanted.join(chunks.select(*keys, "cy", "cx", "y0", "x0", "h", "w", band), [*keys, "cy", "cx"])
    names = [*keys, "source", "target", "ty", "tx", "y0", "x0", "h", "w", band]

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece cut to the box that asked for it."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                y0, x0, h, w, top, bottom, left, right = (row.column(c)[0].as_py() for c in ("y0", "x0", "h", "w", "top", "bottom", "left", "right"))
                a, b, c, d = max(y0, top), min(y0 + h, bottom + 1), max(x0, left), min(x0 + w, right + 1)
                if a < b and c < d:
                    cut = np.s_[a - y0 : b - y0, c - x0 : d - x0]
                    v, g = _values(row.column(band)).reshape(h, w)[cut], _gaps(row.column(band)).reshape(h, w)[cut]
                    yield pa.RecordBatch.from_arrays([*[row.column(n) for n in names[: len(keys) + 4]], *[pa.array([n], pa.int32()) for n in (a, c, b - a, d - c)], _list(v, g)], names)

    pieces = met.mapInArrow(trim, _schema(t, [*keys, "source", "target", "ty", "tx"], [(c, "int") for c in ("y0", "x0", "h", "w")] + [(band, "array<double>")]))

    def fill(p: pa.Table) -> pa.Table:
        source, grid, ty, tx = (p.column(c)[0].as_py() for c in ("source", "target", "ty", "tx"))
        y0, x0, h, w = (p.column(c).to_numpy() for c in ("y0", "x0", "h", "w"))
        top, left = int(y0.min()), int(x0.min())
        values, there = _assembled(p, [band], top, left, int((y0 + h).max()) - top, int((x0 + w).max()) - left)
        v, ok = _sample(*box(grid, source, ty, tx), values[band], there[band], top, left, method)
        place = (grid["height"], grid["width"], ty, tx, ty * size, tx * size, *v.shape)
        return pa.Table.from_arrays([*[p.column(k).slice(0, 1).combine_chunks() for k in keys], *[pa.array([n], pa.int32()) for n in place], _list(v, ~ok)], names=[*keys, *PLACE, band])

    return pieces.groupBy(*keys, "ty", "tx").applyInArrow(fill, _schema(chunks, keys, [(c, "int") for c in PLACE] + [(band, "array<double>")]))


def mosaic(tiles: DataFrame, keys: list[str], band: str, grids: DataFrame, order: str, size: int = SIZE) -> DataFrame:
    """Tiles with their own origins laid over each other on each target grid, the highest order on top (of equals any, but
    one for all pixels of a chunk). tiles: chunks with keys (of the target), order, origin struct<x0, y0, xres, yres> of the
    tile; grids: keys, target (GRID), of one coordinate system. A target pixel takes the value of the tile pixel that
    holds its centre. A chunk's own box on the target tells the target chunks that it goes to."""
    t = tiles.join(grids.select(*keys, F.col("target").cast(GRID).alias("target")), keys)
    o, g = (lambda c: F.col(f"origin.{c}")), (lambda c: F.col(f"target.{c}"))

    def span(first: str, long: str, at: str, res: str, most: str):
        """First and last target chunk that the piece reaches along one side."""
        a = (o(at) + F.col(first) * o(res) - g(at)) / g(res)
        b = (o(at) + (F.col(first) + F.col(long)) * o(res) - g(at)) / g(res)
        low, high = F.greatest(F.floor(F.least(a, b)), F.lit(0)), F.least(F.ceil(F.greatest(a, b)), g(most)) - 1
        return F.when(low <= high, F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int")))

    t = t.withColumn("ty", F.explode(span("y0", "h", "y0", "yres", "height"))).withColumn("tx", F.explode(span("x0", "w", "x0", "xres", "width")))

    def lay(p: pa.Table) -> pa.Table:
        grid, ty, tx = (p.column(c)[0].as_py() for c in ("target", "ty", "tx"))
        y0, x0 = ty * size, tx * size
        h, w = min(size, grid["height"] - y0), min(size, grid["width"] - x0)
        y, x = grid["y0"] + (np.arange(y0, y0 + h) + 0.5) * grid["yres"], grid["x0"] + (np.arange(x0, x0 + w) + 0.5) * grid["xres"]
        out, there = np.zeros((h, w)), np.zeros((h, w), bool)
        ranks = [p.column(order)[i].as_py() for i in range(p.num_rows)]
        for i in sorted(range(p.num_rows), key=lambda i: (ranks[i] is not None, ranks[i])):
            row = p.slice(i, 1)
            at, py, px, ph, pw = (row.column(c)[0].as_py() for c in ("origin", "y0", "x0", "h", "w"))
            r, c = np.floor((y - at["y0"]) / at["yres"]).astype(np.int64) - py, np.floor((x - at["x0"]) / at["xres"]).astype(np.int64) - px
            rows, cols = np.flatnonzero((r >= 0) & (r < ph)), np.flatnonzero((c >= 0) & (c < pw))
            if not len(rows) or not len(cols):
                continue
            to, of = np.ix_(rows, cols), np.ix_(r[rows], c[cols])
            ok = ~_gaps(row.column(band)).reshape(ph, pw)[of]
            out[to] = np.where(ok, _values(row.column(band)).reshape(ph, pw)[of], out[to])
            there[to] |= ok
        place = (grid["height"], grid["width"], ty, tx, y0, x0, h, w)
        return pa.Table.from_arrays([*[p.column(k).slice(0, 1).combine_chunks() for k in keys], *[pa.array([n], pa.int32()) for n in place], _list(out, ~there)], names=[*keys, *PLACE, band])

    sent = t.select(*keys, order, "origin", "target", "ty", "tx", "y0", "x0", "h", "w", band)
    return sent.groupBy(*keys, "ty", "tx").applyInArrow(lay, _schema(tiles, keys, [(c, "int") for c in PLACE] + [(band, "array<double>")]))
