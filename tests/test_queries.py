"""Every query with an oracle against DuckDB on the smallest tables, and the registry without the optional parts."""

import glob
import hashlib
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from pixelframe.plans import rasters, scenes, streams

DATA = "/root/testdata/sf0.001"
ORACLES = {**scenes.ORACLES, **rasters.ORACLES, **streams.ORACLES}
QUERIES = {**scenes.QUERIES, **rasters.QUERIES, **streams.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def text(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([text(x) for x in v])
    try:
        return v if isinstance(v, str) else f"{float(v) + 0.0:.5f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_augmented_tiles_match_sql_to_the_sign_of_zero(spark, tmp_path):
    def level(i, wanted):
        """The pixel that brightness and contrast make wanted in copy 0 of tile i."""
        r = int(hashlib.md5(f"{i}:0:RandomBrightnessContrast:0".encode()).hexdigest()[:8], 16) / 2**32
        return (wanted - 0.2 * (r - 0.5)) / (0.8 + 0.4 * r)

    odd = [None, float("nan"), -1e-5, 5e-6, -5e-6, 1e6, -1e6, 0.5, -0.0]
    rows = [(1, 0, [level(1, -2e-6)] * 64), (2, 1, [level(2, 2e-6)] * 64), (3, 1, (odd * 8)[:64]), (4, 0, (odd[2:] * 10)[:64])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.vec_id, r.copy): repr((list(r.img), list(r.mask))) for r in QUERIES["augmented_tiles"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cur = c.execute(ORACLES["augmented_tiles"])
    at = [[x[0] for x in cur.description].index(n) for n in ("vec_id", "copy", "img", "mask")]
    want = {(r[at[0]], r[at[1]]): repr((r[at[2]], r[at[3]])) for r in cur.fetchall()}
    assert got == want and len(got) == 32 and "[-0.0, -0.0," in got[1, 0] and "[0.0, 0.0," in got[2, 0]


def test_entry_without_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    os.symlink(root / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "pixelframe").mkdir()
    for p in (root / "pixelframe").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "pixelframe" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clean_ensemble_objects' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
