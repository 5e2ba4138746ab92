"""Chunked rasters against numpy over whole scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import chunks

K = ["scene_id"]


def scene(rng, h, w, missing=0.1, nan=0.0):
    a = rng.normal(size=(h, w))
    a[rng.random((h, w)) < nan] = np.nan
    return a, rng.random((h, w)) >= missing


def as_chunks(spark, scenes, size):
    rows = [(i, y, x, float(a[y, x])) for i, (a, there) in enumerate(scenes) for y, x in zip(*np.nonzero(there))]
    px = spark.createDataFrame([(i, int(y), int(x), v) for i, y, x, v in rows], "scene_id long, y int, x int, v double")
    sizes = spark.createDataFrame([(i, *a.shape) for i, (a, _) in enumerate(scenes)], "scene_id long, height int, width int")
    return chunks.to_chunks(px, K, ["v"], sizes, size)


def as_arrays(df, band, scenes):
    out = [np.full(a.shape, -99.0) for a, _ in scenes]
    for r in chunks.to_pixels(df, K, [band]).collect():
        out[r.scene_id][r.y, r.x] = r[band]
    return out


def scenes_of(seed, **how):
    rng = np.random.default_rng(seed)
    return [scene(rng, h, w, **how) for h, w in ((20, 33), (9, 4), (1, 1), (16, 16))]


def test_chunks_hold_all_pixels(spark):
    all_ = scenes_of(1, nan=0.1)
    for got, (a, there) in zip(as_arrays(as_chunks(spark, all_, 8), "v", all_), all_):
        assert np.array_equal(got, np.where(there, a, -99.0), equal_nan=True)


def test_strips_make_the_same_chunks(spark):
    all_ = scenes_of(2, missing=0.0)
    rows = [(i, y, x0, [float(v) for v in a[y, x0 : x0 + 7]]) for i, (a, _) in enumerate(all_) for y in range(a.shape[0]) for x0 in range(0, a.shape[1], 7)]
    strips = spark.createDataFrame(rows, "scene_id long, y int, x0 int, v array<double>")
    sizes = spark.createDataFrame([(i, *a.shape) for i, (a, _) in enumerate(all_)], "scene_id long, height int, width int")
    for got, (a, _) in zip(as_arrays(chunks.strips_to_chunks(strips, K, "v", sizes, 8), "v", all_), all_):
        assert np.array_equal(got, a)


@pytest.mark.parametrize("r,size", [(1, 8), (3, 4), (9, 8), (11, 64)])
def test_focal_mean_matches_a_loop(spark, r, size):
    all_ = scenes_of(3, nan=0.01)
    got = as_arrays(chunks.focal_mean(as_chunks(spark, all_, size), K, "v", r, size=size), "focal_mean", all_)
    for g, (a, there) in zip(got, all_):
        for y, x in zip(*np.nonzero(there)):
            near = [a[i, j] for i in range(max(0, y - r), min(a.shape[0], y + r + 1)) for j in range(max(0, x - r), min(a.shape[1], x + r + 1)) if there[i, j] and (i - y) ** 2 + (j - x) ** 2 <= r * r]
            assert g[y, x] == pytest.approx(np.mean(near), nan_ok=True)
        assert (g[~there] == -99).all()


@pytest.mark.parametrize("t,size,share", [(3, 8, 0.3), (16, 8, 0.02), (16, 32, 0.98), (5, 4, 0.0)])
def test_signed_distance_matches_a_loop(spark, t, size, share):
    rng = np.random.default_rng(4)
    all_ = [((rng.random((h, w)) < share).astype(float), rng.random((h, w)) >= 0.05) for h, w in ((21, 30), (5, 5))]
    got = as_arrays(chunks.signed_distance(as_chunks(spark, all_, size), K, "v", t, size=size), "distance", all_)
    for g, (m, there) in zip(got, all_):
        for y, x in zip(*np.nonzero(there)):
            other = [(i - y) ** 2 + (j - x) ** 2 for i, j in zip(*np.nonzero(there & (m != m[y, x]))) if abs(i - y) <= t and abs(j - x) <= t]
            assert g[y, x] == pytest.approx((1 if m[y, x] else -1) * min([t * t, *other]) ** 0.5 / t)


def test_lower_envelope_matches_brute_force():
    rng = np.random.default_rng(5)
    f = np.where(rng.random((40, 60)) < 0.5, 1e6, rng.integers(0, 300, (40, 60))).astype(float)
    x = np.arange(60)
    assert np.array_equal(chunks.lower_envelope(f), (f[:, None, :] + (x[:, None] - x) ** 2).min(axis=2))


def test_patch_scores_match_a_loop_over_the_scene(spark):
    rng = np.random.default_rng(6)
    all_ = [(rng.normal(size=(h, w)), np.ones((h, w), bool)) for h, w in ((20, 33), (11, 12))]
    patch, margin = 8, 3

    def model(a):
        b = np.pad(a[0], 1)
        return sum(b[i : i + patch, j : j + patch] for i in range(3) for j in range(3))

    got = as_arrays(chunks.score_patches(as_chunks(spark, all_, 6), K, ["v"], model, patch, margin, size=6), "p", all_)
    ramp = np.minimum(1, np.minimum(np.arange(8), np.arange(8)[::-1]) / 2)
    for g, (a, _) in zip(got, all_):
        total, weight = np.zeros_like(a), np.zeros_like(a)
        for y in range(0, a.shape[0], patch - margin):
            for x in range(0, a.shape[1], patch - margin):
                y, x = min(y, a.shape[0] - patch), min(x, a.shape[1] - patch)
                w = ramp[:, None] * ramp[None]
                total[y : y + patch, x : x + patch] += w * model(a[None, y : y + patch, x : x + patch])
                weight[y : y + patch, x : x + patch] += w
        assert np.allclose(g, np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0))
    with pytest.raises(Exception, match="smaller"):
        chunks.score_patches(as_chunks(spark, all_, 6), K, ["v"], model, 16, 3, size=6).collect()


def test_scored_scenes_keep_nodata_apart(spark):
    a = np.full((10, 10), 5.0)
    a[0, 0], a[2, 3], a[4, 4] = 0.0, np.nan, -5.0
    out = chunks.score_scenes(as_chunks(spark, [(a, np.ones((10, 10), bool))], 4), K, {"v": 2.0}, lambda x: x[0], 4, 2, size=4)
    got = {(r.y, r.x): (r.p, r.b) for r in chunks.to_pixels(out, K, ["p", "b"]).collect()}
    assert got[0, 0][1] == got[2, 3][1] == 255 and np.isnan(got[0, 0][0]) and np.isnan(got[2, 3][0])
    assert got[4, 4][1] == 0 and got[4, 4][0] < 0.5 and got[5, 5] == (pytest.approx(1 / (1 + np.exp(-2.5))), 1.0)


def test_no_single_pixel_is_shuffled(spark):
    """Between the first chunks and the last, all exchanges carry arrays."""
    c = as_chunks(spark, scenes_of(7), 8)
    path = spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/chunks-plan"
    c.write.mode("overwrite").parquet(path)
    plan = chunks.score_patches(spark.read.parquet(path), K, ["v"], lambda a: a[0], 1, 0, size=8)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "Generate explode" not in plan and "Window" not in plan


def test_zonal_sums_match_a_loop(spark):
    all_ = scenes_of(8)
    rng = np.random.default_rng(9)
    rows = [(i, k, int(rng.integers(0, 20)), int(x0), int(x0 + rng.integers(0, 15))) for k in range(12) for i in range(4) for x0 in rng.integers(-2, 30, 3)]
    runs = spark.createDataFrame([(i, 100 * i + k, y, x0, x1) for i, k, y, x0, x1 in rows], "scene_id long, id int, y int, x0 int, x1 int")
    got = {r.id: (r.n, r.there, r.total) for r in chunks.zonal_sums(runs, as_chunks(spark, all_, 8), K, "id", "v", 8).collect()}
    want = {}
    for i, k, y, x0, x1 in rows:
        a, there = all_[i]
        px = [a[y, x] for x in range(max(x0, 0), min(x1 + 1, a.shape[1])) if y < a.shape[0] and there[y, x]]
        n, m, t = want.get(100 * i + k, (0, 0, 0.0))
        want[100 * i + k] = (n + x1 - x0 + 1, m + len(px), t + sum(px))
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)


def test_band_runs_join_up_over_chunks(spark):
    all_ = scenes_of(10)
    got = {(r.scene_id, r.y, r.x0, r.x1) for r in chunks.band_runs(as_chunks(spark, all_, 4), K, "v", 0.0).collect()}
    want = set()
    for i, (a, there) in enumerate(all_):
        on = np.pad(there & (a >= 0), ((0, 0), (1, 1))).astype(int)
        for y in range(a.shape[0]):
            step = np.diff(on[y])
            want |= {(i, y, int(p), int(q) - 1) for p, q in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))}
    assert got == want


def test_nothing_gives_nothing(spark):
    empty = as_chunks(spark, [(np.zeros((3, 3)), np.ones((3, 3), bool))], 2).where(F.lit(False))
    assert chunks.focal_mean(empty, K, "v", 2, size=2).count() == 0 and chunks.score_patches(empty, K, ["v"], lambda a: a[0], 2, 1, size=2).count() == 0
