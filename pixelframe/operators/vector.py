"""Polygons: from runs and to runs, zonal means, water filter, reprojection, scene metadata, merging."""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import names as N
from .chunks import SIZE, zonal_sums
from .rings import RING, from_wkb, polygons  # noqa: F401
from .runs import components, runs_to_pixels



def polygonize(runs: DataFrame, keys: list[str], width: int, connectivity: int = 4, x0: float = 0.0, y0: float = 0.0, res: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Components of runs as polygons in map coordinates; see rings.polygons."""
    return polygons(components(runs, keys, width, connectivity), keys, x0, y0, res)


def rasterize(polygons: DataFrame, keys: list[str], ident: str, rings: str, attr: str, order: str) -> DataFrame:
    """keys, ident, attr, order, y, x0, x1: runs of the pixels whose centre is inside (even-odd). Scanlines: each edge meets the
    rows it crosses, crossings of a row are paired in order."""
    own = list(dict.fromkeys([*keys, ident, attr, order]))
    seg = polygons.select(*own, F.explode(rings).alias("_r")).select("*", F.explode(F.sequence(F.lit(0), F.size("_r") - 2)).alias("_i"))
    seg = seg.select(*own, F.get("_r", F.col("_i")).alias("a"), F.get("_r", F.col("_i") + 1).alias("b")).where("a.y != b.y")
    lo, hi = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    first, last = F.ceil(lo - 0.5).cast("int"), (F.ceil(hi - 0.5) - 1).cast("int")
    seg = seg.withColumn("_f", first).withColumn("_l", last).where("_f <= _l").withColumn("y", F.explode(F.sequence("_f", "_l")))
    cross = F.col("a.x") + (F.col("y") + 0.5 - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))
    row = seg.groupBy(*own, "y").agg(F.array_sort(F.collect_list(cross)).alias("_c"))  # one polygon's crossings of one row
    pair = row.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.size("_c") / 2).cast("int") - 1)))
    runs = pair.select(*own, "y", F.ceil(F.get("_c", F.col("_k") * 2) - 0.5).cast("int").alias("x0"), (F.ceil(F.get("_c", F.col("_k") * 2 + 1) - 0.5) - 1).cast("int").alias("x1")).where("x0 <= x1")
    return runs


def burn(runs_of_polygons: DataFrame, keys: list[str], attr: str, order: str) -> DataFrame:
    """keys, y, x, value: the last polygon in order wins."""
    return runs_to_pixels(runs_of_polygons).groupBy(*keys, "y", "x").agg(F.max_by(attr, order).alias("value"))


def zonal_mean(runs_of_polygons: DataFrame, chunks: DataFrame, keys: list[str], ident: str, band: str, size: int = SIZE) -> DataFrame:
    """ident, n, mean of the band over the polygon's pixels that are in the raster."""
    z = zonal_sums(runs_of_polygons, chunks, keys, ident, band, size).where("there > 0")
    return z.select(ident, F.col("there").alias("n"), (F.col("total") / F.col("there")).alias("mean"))


def filter_water(polygons: DataFrame, runs_of_polygons: DataFrame, water: DataFrame, keys: list[str], ident: str, band: str = "water", t: float = 0.2, size: int = SIZE) -> DataFrame:
    """Polygons whose mean water share (_w) is at most t; pixels without a water value count as water. water: chunks."""
    z = zonal_sums(runs_of_polygons, water, keys, ident, band, size)
    ok = z.select(ident, ((F.col("total") + F.col("n") - F.col("there")) / F.col("n")).alias("_w")).where(F.col("_w") <= t)
    return polygons.join(ok, ident)


def bounds(geo: Column, buffer: float = 0.0) -> Column:
    """struct<x0, y0, xres, yres, width, height> -> struct<left, bottom, right, top>, widened by buffer."""
    x1, y1 = geo["x0"] + geo["xres"] * geo["width"], geo["y0"] + geo["yres"] * geo["height"]
    return F.struct((F.least(geo["x0"], x1) - buffer).alias("left"), (F.least(geo["y0"], y1) - buffer).alias("bottom"), (F.greatest(geo["x0"], x1) + buffer).alias("right"), (F.greatest(geo["y0"], y1) + buffer).alias("top"))


# WGS84, fixed values
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _E0 = 0.9996, 500000.0
_N3 = _F / (2 - _F)
_AA = _A / (1 + _N3) * (1 + _N3**2 / 4 + _N3**4 / 64)
_ALPHA = (_N3 / 2 - 2 * _N3**2 / 3 + 5 * _N3**3 / 16, 13 * _N3**2 / 48 - 3 * _N3**3 / 5, 61 * _N3**3 / 240)
_BETA = (_N3 / 2 - 2 * _N3**2 / 3 + 37 * _N3**3 / 96, _N3**2 / 48 + _N3**3 / 15, 17 * _N3**3 / 480)
_DELTA = (2 * _N3 - 2 * _N3**2 / 3 - 2 * _N3**3, 7 * _N3**2 / 3 - 8 * _N3**3 / 5, 56 * _N3**3 / 15)


def utm_to_lonlat(x: Column, y: Column, zone: Column, south: bool = False, m=F) -> tuple[Column, Column]:
    """Krueger's series, to about a millimetre."""
    xi, eta = (y - (1e7 if south else 0.0)) / (_K0 * _AA), (x - _E0) / (_K0 * _AA)
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, 1):
        xp = xp - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        ep = ep - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(xp) / m.cosh(ep))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * m.sin(2 * j * chi)
    return zone * 6 - 183 + m.degrees(m.atan2(m.sinh(ep), m.cos(xp))), m.degrees(lat)


def lonlat_to_utm(lon: Column, lat: Column, zone: Column, south: bool = False, m=F) -> tuple[Column, Column]:
    phi, lam = m.radians(lat), m.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N3) / (1 + _N3)
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xp, ep = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    x, y = ep, xp
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * m.cos(2 * j * xp) * m.sinh(2 * j * ep)
        y = y + a * m.sin(2 * j * xp) * m.cosh(2 * j * ep)
    return _E0 + _K0 * _AA * x, _K0 * _AA * y + (1e7 if south else 0.0)


# EPSG:3413, fixed values: polar stereographic, true at 70 degrees north, centred on 45 degrees west
_TRUE, _CENTRE, _E2 = math.radians(70.0), -45.0, _F * (2 - _F)
_ECC = math.sqrt(_E2)
_POLAR = _A * (math.cos(_TRUE) / math.sqrt(1 - _E2 * math.sin(_TRUE) ** 2)) / (math.tan(math.pi / 4 - _TRUE / 2) / ((1 - _ECC * math.sin(_TRUE)) / (1 + _ECC * math.sin(_TRUE))) ** (_ECC / 2))


def polar_to_lonlat(x: Column, y: Column, m=F) -> tuple[Column, Column]:
    """Degrees of EPSG:3413 coordinates; the latitude is a series in the conformal one."""
    chi = math.pi / 2 - 2 * m.atan(m.hypot(x, y) / m.lit(_POLAR))
    e2, e4, e6, e8 = (_E2**k for k in (1, 2, 3, 4))
    series = ((2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360), (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520), (6, 7 * e6 / 120 + 81 * e8 / 1120), (8, 4279 * e8 / 161280))
    lat = sum((c * m.sin(k * chi) for k, c in series), chi)
    return m.degrees(m.atan2(x, -y)) + _CENTRE, m.degrees(lat)


def lonlat_to_polar(lon: Column, lat: Column, m=F) -> tuple[Column, Column]:
    s = m.sin(m.radians(lat))
    rho = _POLAR * m.tan(math.pi / 4 - m.radians(lat) / 2) / m.pow((1 - _ECC * s) / (1 + _ECC * s), m.lit(_ECC / 2))
    turn = m.radians(lon - _CENTRE)
    return rho * m.sin(turn), -rho * m.cos(turn)


def has_projection(epsg: Column) -> Column:
    """Whether reproject knows the code; false for null."""
    zone = epsg % 100
    utm = F.floor(epsg / 100).isin(326, 327) & (zone >= 1) & (zone <= 60)
    return F.coalesce(utm | epsg.isin(3413, 4326), F.lit(False))


def bounds_lonlat(scenes: DataFrame, geo: str, epsg: int, buffer: float = 1000.0) -> DataFrame:
    """scenes with west, south, east, north: the lower left and the upper right corner of the widened bounds in degrees."""
    out = scenes.withColumn("_b", bounds(F.col(geo), buffer))
    for a, b, names in (("left", "bottom", ("west", "south")), ("right", "top", ("east", "north"))):
        out = out.withColumn("_x", F.col(f"_b.{a}")).withColumn("_y", F.col(f"_b.{b}"))
        out = reproject(out, epsg, "_x", "_y").withColumnsRenamed(dict(zip(("lon", "lat"), names)))
    return out.drop("_b", "_x", "_y")


def read_detections(spark: SparkSession, path: str, schema: str, water: DataFrame | None = None, ident: str = "poly_id") -> DataFrame:
    """Detections of all scenes (JSON lines below path) with their scene's metadata; lines that are no detections are left
    out, and so are files that cannot be read. water: ident and share, of which those over 0.2 go."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("ignoreCorruptFiles", "true").json(path)
    rows = attach_scene_metadata(rows.where("_bad is null").drop("_bad"))
    return rows if water is None else rows.join(water.where("share <= 0.2").select(ident), ident, "left_semi")


def read_outlines(spark: SparkSession, path: str, schema: str, epsg: int, water: DataFrame | None = None, grid: tuple[float, float, float, float] | None = None, keys: tuple[str, ...] = (), ident: str = "poly_id", geometry: str = "geometry", t: float = 0.2, size: int = SIZE) -> DataFrame:
    """Detections with outlines in one call: geometry (WKB as base64) becomes rings in the coordinates of epsg and
    rings_lonlat in degrees; lines without a polygon are left out. water: chunks with keys and a band water on the grid
    (x0, y0, xres, yres): outlines with a mean water share over t go, the others have it as share; a pixel without a
    value is water, and so is an outline that holds no pixel's centre."""
    rows = read_detections(spark, path, schema).withColumn("rings", from_wkb(F.unbase64(geometry))).where("rings is not null").drop(geometry)
    rows = rows.withColumn("rings_lonlat", rings_map(F.col("rings"), lambda x, y: to_lonlat(x, y, epsg)))
    if water is None:
        return rows
    x0, y0, xres, yres = grid
    on_grid = rows.withColumn("_r", rings_map(F.col("rings"), lambda x, y: ((x - x0) / xres, (y - y0) / yres)))
    burnt = rasterize(on_grid, list(keys), ident, "_r", ident, ident)
    return filter_water(rows, burnt, water, list(keys), ident, "water", t, size).withColumnRenamed("_w", "share")


#: The projections' functions for arrays, under the names that columns have.
numpy_math = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, atanh=np.arctanh, hypot=np.hypot, sqrt=np.sqrt, pow=np.power, degrees=np.degrees, radians=np.radians, lit=float)


def _zone(epsg: int) -> int:
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"no projection for EPSG:{epsg}")
    return epsg % 100


def to_lonlat(x: Column, y: Column, epsg: int, m=F) -> tuple[Column, Column]:
    """Degrees; UTM zones on WGS84 (326zz, 327zz), the northern polar grid (3413) and EPSG:4326. With m numpy_math, x and y
    are arrays."""
    if epsg == 4326:
        return x, y
    if epsg == 3413:
        return polar_to_lonlat(x, y, m)
    return utm_to_lonlat(x, y, m.lit(_zone(epsg)), epsg // 100 == 327, m)


def from_lonlat(lon: Column, lat: Column, epsg: int, m=F) -> tuple[Column, Column]:
    """The way back."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3413:
        return lonlat_to_polar(lon, lat, m)
    return lonlat_to_utm(lon, lat, m.lit(_zone(epsg)), epsg // 100 == 327, m)


def reproject(vertices: DataFrame, epsg: int, x: str = "x", y: str = "y") -> DataFrame:
    """vertices with lon, lat."""
    lon, lat = to_lonlat(F.col(x), F.col(y), epsg)
    return vertices.withColumn("lon", lon).withColumn("lat", lat)


def rings_map(rings: Column, point: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Rings with each vertex (x, y) moved to point(x, y)."""

    def move(p: Column) -> Column:
        x, y = point(p["x"], p["y"])
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.transform(rings, lambda r: F.transform(r, move))


def attach_scene_metadata(polygons: DataFrame, name: str = "name") -> DataFrame:
    p = N.parse_scene_id(F.col(name))
    return polygons.withColumn("_p", p).select("*", F.col(name).alias("image_id"), "_p.take_id", "_p.tile_id", "_p.date", "_p.year", "_p.satellite").drop("_p")


def merge_detections(dfs: list[DataFrame]) -> DataFrame:
    """One table; missing columns are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def first_label(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")
