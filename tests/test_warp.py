"""Warps and mosaics against numpy over whole rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import chunks, vector, warp

from .test_chunks import K, as_arrays, as_chunks

GEO = "scene_id long, source struct<x0:double,y0:double,xres:double,yres:double,height:int,width:int>, target struct<x0:double,y0:double,xres:double,yres:double,height:int,width:int>"


@pytest.mark.parametrize("method,size", [("nearest", 8), ("cubic", 8), ("cubic", 64)])
def test_warp_matches_a_loop(spark, method, size):
    rng = np.random.default_rng(1)
    a, there = rng.normal(size=(30, 26)), rng.random((30, 26)) >= 0.05
    source, target = (500000.0, 7700000.0, 300.0, -300.0, 30, 26), (-2262000.0, 500.0, 500.0, -400.0, 25, 19)
    grids = spark.createDataFrame([(0, source, target)], GEO)
    out = warp.warp(as_chunks(spark, [(a, there)], size), K, "v", grids, 32608, 3413, method, 7, size)
    (got,) = as_arrays(out, "v", [(np.zeros((25, 19)), None)])
    near = 0
    for y in range(25):
        for x in range(19):
            lon, lat = vector.to_lonlat(np.float64(target[0] + (x + 0.5) * 500), np.float64(target[1] - (y + 0.5) * 400), 3413, vector.numpy_math)
            e, n = vector.from_lonlat(lon, lat, 32608, vector.numpy_math)
            fy, fx = (n - 7700000) / -300 - 0.5, (e - 500000) / 300 - 0.5
            r, c = int(np.floor(fy + 0.5)), int(np.floor(fx + 0.5))
            if not (0 <= r < 30 and 0 <= c < 26 and there[r, c]):
                assert got[y, x] == -99
                continue
            near += 1
            if method == "nearest":
                assert got[y, x] == a[r, c]
                continue
            k = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else (-0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0)
            ws = [(k(abs(fy - i)) * k(abs(fx - j)), a[i, j]) for i in range(int(np.floor(fy)) - 1, int(np.floor(fy)) + 3) for j in range(int(np.floor(fx)) - 1, int(np.floor(fx)) + 3) if 0 <= i < 30 and 0 <= j < 26 and there[i, j]]
            assert got[y, x] == pytest.approx(sum(w * v for w, v in ws) / sum(w for w, _ in ws))
    assert near > 50


def test_grids_that_do_not_meet_give_nothing(spark):
    c = as_chunks(spark, [(np.ones((4, 4)), np.ones((4, 4), bool))], 2)
    grids = spark.createDataFrame([(0, (0.0, 0.0, 1.0, -1.0, 4, 4), (100.0, 100.0, 1.0, -1.0, 5, 5))], GEO)
    assert warp.warp(c, K, "v", grids, 4326, 4326, size=2, source_size=2).count() == 0
    assert warp.warp(c.where(F.lit(False)), K, "v", grids, 4326, 4326, size=2, source_size=2).count() == 0
    with pytest.raises(ValueError):
        warp.warp(c, K, "v", grids, 4326, 4326, "spline")
    with pytest.raises(Exception, match="no projection"):
        warp.warp(c, K, "v", grids, 3031, 4326, size=2, source_size=2).count()


@pytest.mark.parametrize("size", [3, 16])
def test_mosaic_matches_a_loop(spark, size):
    rng = np.random.default_rng(2)
    rasters = [(rng.normal(size=(9, 7)), rng.random((9, 7)) >= 0.2) for _ in range(4)]
    at = [(0.0, 0.0, 2.0, -2.0), (5.5, -3.25, 2.0, -2.0), (-4.0, 6.0, 1.0, -1.0), (7.0, -20.0, 2.0, 2.0)]
    tiles = as_chunks(spark, rasters, 4).withColumn("mosaic", F.lit("m"))
    origins = spark.createDataFrame(list(enumerate(at)), "scene_id long, origin struct<x0:double,y0:double,xres:double,yres:double>")
    grid = (-5.0, 7.0, 1.5, -1.5, 20, 17)
    grids = spark.createDataFrame([("m", grid)], "mosaic string, target struct<x0:double,y0:double,xres:double,yres:double,height:int,width:int>")
    out = warp.mosaic(tiles.join(origins, "scene_id"), ["mosaic"], "v", grids, "scene_id", size)
    got = {(r.y, r.x): r.v for r in chunks.to_pixels(out, ["mosaic"], ["v"]).collect()}
    want = {}
    for (a, there), (x0, y0, xres, yres) in zip(rasters, at):
        for y in range(20):
            for x in range(17):
                r, c = int(np.floor((7.0 - (y + 0.5) * 1.5 - y0) / yres)), int(np.floor((-5.0 + (x + 0.5) * 1.5 - x0) / xres))
                if 0 <= r < 9 and 0 <= c < 7 and there[r, c]:
                    want[y, x] = a[r, c]
    assert got == want
