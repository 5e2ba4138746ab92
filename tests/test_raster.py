"""Golden table of eight scenes, and operators against NumPy on small random masks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import bands, chunks, ensemble, instances, morphology, runs, tiling, vector

SCHEMA = "scene_id long, y int, x int, v double"


def pixels(spark, arrays, name="v"):
    rows = [(i, y, x, float(a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, SCHEMA.replace("v double", f"{name} double"))


def brute_labels(m, eight=True):
    lab, h, w = {}, *m.shape
    for y0, x0 in zip(*np.nonzero(m)):
        if (y0, x0) in lab:
            continue
        todo, mine = [(int(y0), int(x0))], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in mine or not (0 <= y < h and 0 <= x < w and m[y, x]):
                continue
            mine.add((y, x))
            todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
        low = min(y * w + x for y, x in mine)
        lab |= {p: low for p in mine}
    return lab


@pytest.mark.parametrize("connectivity, band", [(4, 1024), (8, 1024), (8, 5), (4, 1)])
def test_components_match_flood_fill(spark, connectivity, band, monkeypatch):
    monkeypatch.setattr(runs, "BAND", band)  # scenes of one band, and of several
    rng = np.random.default_rng(connectivity)
    masks = [rng.random((14, 17)) < p for p in (0.0, 0.3, 0.5, 0.65, 1.0)]
    df = pixels(spark, masks)
    lab = runs.components(runs.to_runs(df, F.col("v") == 1, ["scene_id"]), ["scene_id"], 17, connectivity)
    got = {(r.scene_id, r.y, r.x): r.label for r in runs.runs_to_pixels(lab).collect()}
    assert got == {(i, y, x): v for i, m in enumerate(masks) for (y, x), v in brute_labels(m, connectivity == 8).items()}
    assert sum(r.area for r in runs.component_stats(lab, ["scene_id"]).collect()) == sum(m.sum() for m in masks)


def test_golden_instances(spark):
    """tp, fp, fn of eight scenes of 256 x 256 (fixed values): squares, a pair of blobs, extra and missing objects, nothing."""
    t, p = np.zeros((8, 256, 256)), np.zeros((8, 256, 256))
    a, b = (slice(10, 110),) * 2, (slice(120, 220),) * 2
    t[0, 10:120, 10:120], p[0, 20:110, 5:125] = 1, 0.8
    i = np.arange(100)
    blob = np.exp(-((i[:, None] - 50.0) ** 2 + (i[None] - 50.0) ** 2) / 25**2)
    t[1, 78:178, 78:178], p[1, 70:170, 70:170] = blob > 0.8, blob
    for k, targets, preds in ((2, (a, b), (a,)), (3, (), (a,)), (4, (a,), (a, b)), (5, (a, b), (a, b)), (6, (a, b), (a,))):
        for s in targets:
            t[(k, *s)] = 1
        for s in preds:
            p[(k, *s)] = 0.7
    p[6, 10:120, 120:220] = 0.7
    keep = (t > 0) | (p > 0)
    rows = [(int(k), int(y), int(x), float(p[k, y, x]), int(t[k, y, x])) for k, y, x in zip(*np.nonzero(keep))] + [(7, 0, 0, 0.0, 0)]
    df = spark.createDataFrame(rows, "scene_id long, y int, x int, score double, target int")
    got = {r.scene_id: (r.tp, r.fp, r.fn) for r in instances.match_pixels(df, ["scene_id"], 256).collect()}
    assert [got[k] for k in range(8)] == [(1, 0, 0), (0, 1, 1), (1, 0, 1), (0, 1, 0), (1, 1, 0), (2, 0, 0), (1, 1, 1), (0, 0, 0)]


def test_morphology_matches_numpy(spark):
    rng = np.random.default_rng(5)
    masks = [(rng.random((9, 12)) < p).astype(float) for p in (0.2, 0.8, 1.0)]
    df, k = pixels(spark, masks), ["scene_id"]
    r, h, w = 2, 9, 12
    dil = runs.dilate_disk(runs.to_runs(df, F.col("v") == 1, k), k, r, h, w)
    got = {(q.scene_id, q.y, q.x) for q in runs.runs_to_pixels(dil).collect()}
    true = {(i, y + a, x + b) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m)) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r and 0 <= y + a < h and 0 <= x + b < w}
    assert got == true
    ero = morphology.erode_square(df, "v", k, 1, F.lit(h), F.lit(w))
    pad = [np.pad(m, 1) for m in masks]
    for q in ero.collect():
        assert q.eroded == pad[q.scene_id][q.y : q.y + 3, q.x : q.x + 3].min()
    for width in (1, 2):
        eroded = runs.erode_runs(runs.to_runs(df, F.col("v") == 1, k), k, F.lit(width))
        got = {(q.scene_id, q.y, q.x) for q in runs.runs_to_pixels(eroded).collect()}
        wide = [np.pad(m, width) for m in masks]
        assert got == {(i, y, x) for i in range(3) for y in range(h) for x in range(w) if wide[i][y : y + 2 * width + 1, x : x + 2 * width + 1].min() == 1}


def test_clean_ensemble_drops_edges_and_nodata(spark):
    a = np.zeros((40, 40))
    a[5:10, 5:10] = a[20:26, 20:26] = a[0:4, 30:34] = 0.9
    a[30, 30] = 0.9
    a[27, 20] = np.nan
    mean = pixels(spark, [a], "p")
    out = ensemble.ensemble_clean(mean, ["scene_id"], 40, F.lit(40), F.lit(40), (0.5,), border=2, min_size=4)
    assert {r.label for r in out.collect()} == {5 * 40 + 5}
    none = ensemble.ensemble_clean(mean, ["scene_id"], 40, F.lit(40), F.lit(40), (0.95,), border=2, min_size=4)
    assert none.count() == 0


def test_nan_passes_no_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,)], "p double")
    assert [r[0] for r in df.select(bands.above(F.col("p"), 0.5)).collect()] == [False, False, True]


def test_ndvi_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (3, 1), (7999, 8001)], "r int, n int")
    assert [r[0] for r in df.select(bands.ndvi(F.col("r"), F.col("n"))).collect()] == [0, 10000, 5000, 10001]


def test_polygons_keep_area_and_holes(spark):
    rng = np.random.default_rng(3)
    ring = np.zeros((8, 8))
    ring[1:7, 1:7] = 1
    ring[3:5, 3:5] = 0
    masks = [ring] + [(rng.random((10, 11)) < 0.55).astype(float) for _ in range(3)]
    polys = vector.polygonize(runs.to_runs(pixels(spark, masks), F.col("v") == 1, ["scene_id"]), ["scene_id"], 11).collect()
    area = lambda r: sum(p.x * q.y - q.x * p.y for p, q in zip(r, r[1:])) / 2
    for i, m in enumerate(masks):
        want = {}
        for v in brute_labels(np.pad(m, ((0, 0), (0, 11 - m.shape[1]))), False).values():
            want[v] = want.get(v, 0) + 1
        got = {p.label: abs(area(p.rings[0])) - sum(abs(area(r)) for r in p.rings[1:]) for p in polys if p.scene_id == i}
        assert got == want and {p.label: p.area for p in polys if p.scene_id == i} == want
    assert len([p for p in polys if p.scene_id == 0][0].rings) == 2
    assert all(r[0] == r[-1] for p in polys for r in p.rings)


def test_utm_known_point(spark):
    df = spark.createDataFrame([(500000.0, 0.0), (630084.0, 4833438.0)], "x double, y double")
    a, b = vector.reproject(df, 32617).collect()
    assert (a.lon, a.lat) == pytest.approx((-81.0, 0.0))
    assert (b.lon, b.lat) == pytest.approx((-79.387139, 43.642567), abs=1e-5)
    with pytest.raises(ValueError):
        vector.reproject(df, 3031)


def test_polar_grid(spark):
    """A point on the circle of true scale and the central meridian, and the way back from many points."""
    rows = spark.createDataFrame([(0.0, -2187927.9), (1e6, 1e6), (-2.5e6, 3e5)], "x double, y double")
    got = vector.reproject(rows, 3413)
    x, y = vector.lonlat_to_polar(F.col("lon"), F.col("lat"))
    got = got.withColumn("bx", x).withColumn("by", y).collect()
    assert got[0].lon == pytest.approx(-45) and got[0].lat == pytest.approx(70, abs=1e-3)
    assert all(r.bx == pytest.approx(r.x, abs=1e-3) and r.by == pytest.approx(r.y, abs=1e-3) for r in got)


def test_blur_of_a_constant_and_a_point(spark):
    flat, point = [2.0] * 9, [0.0] * 4 + [9.0] + [0.0] * 4
    rows = spark.createDataFrame([(1, flat), (2, point)], "k int, t array<float>").withColumn("b", tiling.blur(F.col("t"), 3)).orderBy("k").collect()
    assert rows[0].b == flat and rows[1].b == [4.0, 2.0, 4.0, 2.0, 1.0, 2.0, 4.0, 2.0, 4.0]


def test_rasterize_matches_point_in_polygon(spark):
    rng = random.Random(2)
    polys = []
    for i in range(20):
        n = rng.randint(3, 7)
        angles = sorted(rng.uniform(0, 6.28) for _ in range(n))
        pts = [(10 + rng.uniform(3, 9) * np.cos(t), 10 + rng.uniform(3, 9) * np.sin(t)) for t in angles]
        polys.append((1, i, [[{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]]))
    df = spark.createDataFrame(polys, f"scene_id long, id int, rings array<{vector.RING}>")
    burnt = vector.rasterize(df.withColumns({"attr": F.col("id"), "ord": F.col("id")}), ["scene_id"], "id", "rings", "attr", "ord")
    got = {(r.id, r.y, r.x) for r in runs.runs_to_pixels(burnt).select("id", "y", "x").collect()}

    def inside(ring, x, y):
        ok = False
        for p, q in zip(ring, ring[1:]):
            if (p["y"] > y) != (q["y"] > y) and x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]):
                ok = not ok
        return ok

    assert got == {(i, y, x) for _, i, r in polys for y in range(-1, 22) for x in range(-1, 22) if inside(r[0], x + 0.5, y + 0.5)}


def test_dihedral_turns(spark):
    t = np.arange(9.0).reshape(3, 3)
    df = spark.createDataFrame([(1, t.ravel().tolist())], "id int, img array<double>")
    got = {tuple(r.img) for r in tiling.dihedral(df, "img", 3).collect()}
    assert got == {tuple(q.ravel()) for k in range(4) for q in (np.rot90(t, k), np.rot90(t, k).T)}


def test_augmentation_moves_image_and_mask_alike(spark):
    rows = [(i, [float(v) for v in range(16)], list(range(16))) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, img array<double>, mask array<int>")
    out = tiling.augment(df, list(tiling.GEOMETRY), 4, ["id"]).collect()
    assert len(out) == 80 and all([int(v) for v in r.img] == r.mask for r in out) and len({tuple(r.mask) for r in out}) == 8


def test_tiles_cover_all_pixels(spark):
    df = pixels(spark, [np.zeros((30, 41))])
    t = tiling.retile(df, (12, 16), 5)
    assert t.select("y", "x").distinct().count() == 30 * 41 and t.where("ty < 0 or ty >= 12 or tx < 0 or tx >= 16").count() == 0


def test_missing_mask_fails(spark):
    from pyspark.errors import PySparkException

    from pixelframe.operators import catalog

    files = spark.createDataFrame([("a", "a_SR.tif")], "name string, file string")
    with pytest.raises(PySparkException, match="no usable-data mask"):
        catalog.file_roles(files).collect()
    assert catalog.file_roles(files, fail_on_missing_mask=False).count() == 1
