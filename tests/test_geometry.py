"""Column algebra against NumPy, the float32 range test, and every query against its SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.operators import registration as reg

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def random_pose(rng):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = reg.rotation(rng.normal(size=3)), rng.normal(size=3)
    return m


def test_rotation_columns(spark):
    q = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.5**0.5, 0.5**0.5), (0.0, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(q, "qx double, qy double, qz double, qw double")
    rows = df.select(*[c.alias(k) for k, c in g.rotation_columns(*(F.col(c) for c in ("qx", "qy", "qz", "qw"))).items()]).collect()
    want = [np.eye(3), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], np.eye(3)]
    assert all(np.allclose(np.array(r).reshape(3, 3), w) for r, w in zip(rows, want))
    bad = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], df.schema)
    with pytest.raises(Exception, match="zero or non-finite"):
        bad.select(g.rotation_columns(*(F.col(c) for c in df.columns))["r00"]).collect()


def test_motion_algebra_equals_numpy(spark):
    rng = np.random.default_rng(0)
    pairs = [(random_pose(rng), random_pose(rng)) for _ in range(6)]
    flat = lambda m: [*map(float, m[:3, :3].ravel()), *map(float, m[:3, 3])]
    df = spark.createDataFrame([(k, *flat(a), *flat(b)) for k, (a, b) in enumerate(pairs)], "k int, " + ", ".join(f"{p}_{c} double" for p in "ab" for c in g.MATRIX))
    whole = lambda cols: [c.alias(k) for k, c in cols.items()]
    for cols, f in ((g.relative("a_", "b_"), reg.relative), (g.correction("a_", "b_"), lambda a, b: b @ np.linalg.inv(a)), (g.corrected("a_", "b_"), lambda a, b: b @ a), (g.tilt_restored("a_", "b_"), reg.tilt_restored)):
        for r, (a, b) in zip(df.select("k", *whole(cols)).orderBy("k").collect(), pairs):
            assert np.allclose(list(r)[1:], flat(f(a, b)))
    for r, (a, b) in zip(df.select("k", g.tilt_change_deg("a_", "b_"), g.angle_deg("a_"), g.shift_m("b_")).orderBy("k").collect(), pairs):
        assert np.allclose(list(r)[1:], [reg.tilt_change(a, b), reg.angle_deg(a), np.linalg.norm(b[:3, 3])])


def test_back_projection(spark):
    df = spark.createDataFrame([(2, 2, 2000), (4, 2, 1000)], "u int, v int, raw int")
    got = df.select(*g.back_projected(F.col("u"), F.col("v"), F.col("raw"), *map(g.lit, (100, 100, 2, 2)))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 2.0), (0.02, 0.0, 1.0)]


def test_range_bounds():
    assert g.raw_bounds(0.1, 5.0) == (100, 5000) and g.raw_bounds(70.0, 80.0) == (1, 0)


def test_scaled_intrinsics(spark):
    df = spark.createDataFrame([(1500.0, 1500.0, 960.0, 720.0)], "fx double, fy double, cx double, cy double")
    r = df.select(*[c.alias(k) for k, c in g.scaled_intrinsics((1920, 1440), (256, 192)).items()]).first()
    assert np.allclose(list(r), [200, 200, 128, 96])


def test_plane_columns(spark):
    r = spark.range(1).select(g.plane_tilt_deg(g.lit(0), g.lit(1)), *g.plane_equation(g.lit(0), g.lit(0), g.lit(2)), g.tukey_weight(g.lit(0), g.lit(1)), g.tukey_weight(g.lit(9), g.lit(1))).first()
    assert np.allclose(list(r), [45, 0, 1, 0, -2, 1, 0])


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def registered():
    from depthloom.plans.registry import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", registered())
def test_query_equals_sql(spark, oracle, name):
    from depthloom.plans.registry import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SMALL)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
