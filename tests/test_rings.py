"""Outlines over bands against outlines in one piece, and WKB."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import rings, runs

from .test_raster import pixels

K = ["scene_id"]


def outlines(spark, masks, connectivity, band):
    lab = runs.components(runs.to_runs(pixels(spark, masks), F.col("v") == 1, K), K, masks[0].shape[1], connectivity)
    return {(r.scene_id, r.label): r for r in rings.polygons(lab, K, band=band).collect()}, {(r.scene_id, r.label, r.y, r.x) for r in runs.runs_to_pixels(lab).collect()}


def inside(ring, y, x):
    return sum((p.y > y + 0.5) != (q.y > y + 0.5) and p.x > x + 0.5 for p, q in zip(ring, ring[1:])) % 2


@pytest.mark.parametrize("share,connectivity,seed", [(0.5, 4, 1), (0.6, 8, 2), (0.85, 4, 3), (0.3, 8, 4)])
def test_bands_give_the_same_outlines(spark, share, connectivity, seed):
    rng = np.random.default_rng(seed)
    masks = [(rng.random((13, 17)) < share).astype(float) for _ in range(3)]
    whole, px = outlines(spark, masks, connectivity, 256)
    for band in (1, 2, 5):
        parts, _ = outlines(spark, masks, connectivity, band)
        assert {k: (r.area, r.perimeter, r.vertices, r.holes, r.rings) for k, r in parts.items()} == {k: (r.area, r.perimeter, r.vertices, r.holes, r.rings) for k, r in whole.items()}
    # the rings of an object hold its pixels and no others (even-odd), and have no idle corners
    assert {(i, l, y, x) for (i, l), r in whole.items() for y in range(13) for x in range(17) if sum(inside(g, y, x) for g in r.rings) % 2} == px
    for r in whole.values():
        for g in r.rings:
            assert g[0] == g[-1] and all((a.x == b.x) != (b.x == c.x) for a, b, c in zip(g, g[1:], g[2:]))


def test_a_comb_of_many_edges_over_many_bands(spark):
    """One object of 100,000 edges."""
    n = 1000
    rows = [(0, y, x, x) for y in range(50) for x in range(0, 2 * n, 2)] + [(0, 50, 0, 2 * n - 2)]
    lab = spark.createDataFrame(rows, "scene_id long, y int, x0 int, x1 int").withColumn("label", F.lit(7).cast("long"))
    (r,) = rings.polygons(lab, K, band=8).collect()
    assert (r.area, r.holes, r.vertices, r.perimeter) == (50 * n + 2 * n - 1, 0, 4 * n, 100 * n + 2 * (2 * n - 1) + 2)
    assert rings.band_paths(lab, K, 8).count() > 2 * n


def test_wkb_of_either_order(spark):
    ring = [(0.0, 0.0), (3.5, 0.0), (0.0, -2.25), (0.0, 0.0)]
    hole = [(1.0, -0.5), (0.5, -0.5), (0.5, -1.0), (1.0, -0.5)]
    pack = lambda e: (b"\x01" if e == "<" else b"\x00") + struct.pack(e + "II", 3, 2) + b"".join(struct.pack(e + "I", 4) + b"".join(struct.pack(e + "dd", *p) for p in r) for r in (ring, hole))
    rows = [(1, pack("<")), (2, pack(">")), (3, None), (4, b"\x01\x01\x00\x00\x00" + b"\0" * 16), (5, pack("<")[:40]), (6, b"")]
    df = spark.createDataFrame(rows, "id int, b binary").withColumn("rings", rings.from_wkb(F.col("b")))
    got = {r.id: r.rings and [[(p.x, p.y) for p in g] for g in r.rings] for r in df.collect()}
    assert got == {1: [ring, hole], 2: [ring, hole], 3: None, 4: None, 5: None, 6: None}
    back = {r.id: r.w for r in df.select("id", rings.to_wkb(F.col("rings")).alias("w")).collect()}
    assert back == {1: bytearray(pack("<")), 2: bytearray(pack("<")), 3: None, 4: None, 5: None, 6: None}


def test_spark_reads_the_wkb(spark):
    spark.conf.set("spark.sql.geospatial.enabled", "true")
    df = spark.createDataFrame([([[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]],)], f"r array<{rings.RING}>")
    (r,) = df.select(rings.to_wkb(F.col("r")).alias("w")).selectExpr("w", "st_asbinary(st_geomfromwkb(w)) back").collect()
    assert r.w == r.back
