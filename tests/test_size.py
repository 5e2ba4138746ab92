"""What only showed on larger tables, on small ones: joins that would be broadcast, names that come twice, digits at a half."""

import glob
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe import streaming
from pixelframe.operators import resample
from pixelframe.plans import rasters, scenes

from .test_queries import text

QUERIES = {**scenes.QUERIES, **rasters.QUERIES}
ORACLES = {**scenes.ORACLES, **rasters.ORACLES}


def both(spark, name, d):
    """Sorted rows of a query and of its SQL over the tables in d."""
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from read_parquet('{f}/*.parquet')")
    cur = c.execute(ORACLES[name])
    at = [[x[0] for x in cur.description].index(n) for n in cols]
    return sorted(tuple(text(r[n]) for n in cols) for r in df.collect()), sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())


@pytest.fixture
def small_broadcasts(spark):
    """Tables over 64 kB can not be broadcast, as large ones can not in a small driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_cubic_resampling_broadcasts_no_grid(spark, tmp_path, small_broadcasts):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.1, 64).tolist(), 0) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = both(spark, "cubic_resampling", str(tmp_path))
    assert got == want and len(got) == 42 * 42 + 24 * 42


def test_cubic_resampling_with_gaps(spark):
    """Neighbours that are not there or have no value, and a grid that begins elsewhere."""
    rng = np.random.default_rng(4)
    a, there = rng.normal(size=(9, 8)), rng.random((9, 8)) >= 0.2
    there[4, 4] = True
    src = spark.createDataFrame([(0, y, x, None if (y, x) == (4, 4) else float(a[y, x])) for y in range(9) for x in range(8) if there[y, x]], "scene_id long, y int, x int, v double")
    target = spark.createDataFrame([(0, y, x) for y in range(5) for x in range(5) if (y, x) != (2, 2)], "scene_id long, y int, x int")
    got = {(r.y, r.x): r.v for r in resample.align_cubic(src, target, ["scene_id"], "v", (1.7, 1.3), (0.4, F.lit(0.9))).collect()}
    k = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else (-0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0)
    want = {}
    for y in range(5):
        for x in range(5):
            fy, fx = (y + 0.5) * 1.7 - 0.5 + 0.4, (x + 0.5) * 1.3 - 0.5 + 0.9
            near = [(i, j) for i in range(int(np.floor(fy)) - 1, int(np.floor(fy)) + 3) for j in range(int(np.floor(fx)) - 1, int(np.floor(fx)) + 3) if 0 <= i < 9 and 0 <= j < 8 and there[i, j]]
            w = {p: k(abs(fy - p[0])) * k(abs(fx - p[1])) for p in near}
            if (y, x) != (2, 2):
                want[y, x] = sum(w[p] * a[p] for p in near if p != (4, 4)) / sum(w.values())
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_matching_by_boundary_broadcasts_no_runs(spark, tmp_path, small_broadcasts):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.1, 64).tolist(), 0) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = both(spark, "instance_matching_by_boundary", str(tmp_path))
    assert got == want and len(got) == 3


@pytest.fixture(scope="module")
def same_names(spark, tmp_path_factory):
    """Orders of seven-digit keys, whose names are cut to six digits: five scenes share each."""
    import datetime

    d = str(tmp_path_factory.mktemp("orders"))
    day = datetime.datetime(1995, 1, 13)
    rows = [(1000000 + 10 * (i // 10) + i % 10, i // 10, day) for i in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{d}/orders.parquet")
    assert len({r.name for r in QUERIES["scene_catalog"](spark, d).select("name").collect()}) < 150
    return d


def test_file_roles_of_scenes_that_share_names(spark, same_names):
    got, want = both(spark, "file_roles", same_names)
    assert got == want and len(got) == 200


def test_ensemble_status_of_scenes_that_share_names(spark, same_names):
    got, want = both(spark, "ensemble_status", same_names)
    assert got == want and len(got) > 150


def test_running_statistics_to_the_last_digit(spark, tmp_path, monkeypatch):
    """Means whose seventh digit is a half, values that are null, and rows of several blocks. The SQL's own sums depend on where
    the rows of a type lie among others; so this is one type."""
    monkeypatch.setattr(streaming, "BLOCK", 256, raising=False)
    rng = np.random.default_rng(6)
    rows = [(i, "a", None if i < 2 or i % 11 == 0 else round(float(v), 2)) for i, v in enumerate(rng.exponential(50, 20000))]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["running_statistics"](spark, str(tmp_path)).select("event_id", "event_type", "mean", "std").collect()
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = c.execute(f"select event_id, event_type, mean, std from ({ORACLES['running_statistics']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == 20000


def test_running_parts_of_several_keys(spark, monkeypatch):
    monkeypatch.setattr(streaming, "BLOCK", 16, raising=False)
    rng = np.random.default_rng(7)
    rows = [(i, [None, "a", "b", "b"][i % 4], float(v) + 1e6) for i, v in enumerate(rng.normal(size=1500))] + [(2000, "c", None), (2001, "c", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double").repartition(3)
    got = {r.event_id: r for r in streaming.running_parts(df, ["event_type"], "value", "event_id").collect()}
    for kind in (None, "a", "b"):
        mine = [(i, v) for i, k, v in rows if k == kind]
        for n, (i, _) in enumerate(mine, 1):
            x = np.array([v for _, v in mine[:n]])
            assert (got[i].event_type, got[i].rows, got[i].n) == (kind, n, n) and got[i]["mean"] == pytest.approx(x.mean(), rel=1e-14) and got[i].m2 == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-6, abs=1e-6)
    assert (got[2000].n, got[2000]["mean"], got[2001].n, got[2001]["mean"], got[2001].m2) == (0, None, 1, 4.0, 0.0) and len(got) == 1502


def test_processing_stats_of_scenes_that_share_names(spark, same_names):
    got, want = both(spark, "processing_stats", same_names)
    assert got == want and len(got) == 1


def test_processing_status_of_scenes_that_share_names(spark, same_names):
    got, want = both(spark, "processing_status", same_names)
    assert got == want and len(got) == 200
