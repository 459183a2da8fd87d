"""Planes of synthetic rooms against what they were built from."""

import json

import numpy as np
import pytest

from depthloom.operators import planes
from depthloom.options import PlaneOptions
from depthloom.plans.planes import analysed, blocks
from depthloom.sources.sinks import rounded
from tests.captures import CAMERA, room


def analyse(points, **kw):
    return planes.analyse(points, CAMERA, PlaneOptions(**kw))


def test_floor_and_height():
    r = analyse(room()).report
    assert abs(r["floor"]["height_m"] + 1.4) < 0.005 and r["floor"]["tilt_deg"] < 0.3
    assert len(r["ceiling_levels"]) == 1 and abs(r["ceiling_height"]["value_m"] - 2.5) < 0.01 and not r["warnings"]
    low, high = r["ceiling_height"]["confidence_interval_m"]
    assert low < 2.5 < high and json.loads(json.dumps(rounded(r))) == rounded(r)


def test_no_ceiling_and_no_floor():
    r = analyse(room(ceiling=None)).report
    assert r["floor"]["observed"] and not r["ceiling"]["observed"] and r["ceiling_height"]["value_m"] is None
    high = room(ceiling=None)
    high[:, 1] += 3
    r = analyse(high).report
    assert not r["floor"]["observed"] and "no level plane below the camera" in r["floor"]["reject_reason"] and r["ceiling"]["reject_reason"] == "no floor to measure from"


def test_two_levels():
    r = analyse(room(levels=(1.0, 1.9))).report
    assert np.allclose(sorted(s["height"]["value_m"] for s in r["ceiling_levels"]), [2.4, 3.3], atol=0.02)
    assert any("2 ceiling levels" in w for w in r["warnings"])


def test_levels_close_together_are_one():
    assert len(analyse(room(levels=(1.1, 1.14))).report["ceiling_levels"]) == 1


@pytest.mark.parametrize(("tilt", "found"), [(2.0, True), (9.0, False)])
def test_tilt(tilt, found):
    r = analyse(room(noise=0.003, tilt_deg=tilt)).report
    assert r["floor"]["observed"] == found
    if found:
        assert abs(r["ceiling_height"]["value_m"] - 2.5) < 0.005 and abs(r["floor"]["tilt_deg"] - tilt) < 0.2


def test_interval_widens_with_noise():
    half = [analyse(room(noise=n)).report["ceiling_height"]["interval_halfwidth_m"] for n in (0.003, 0.04)]
    assert half[0] < 0.02 and half[1] > 2 * half[0]


def test_small_patch_is_no_ceiling():
    points = room(ceiling=None)
    x, z = (v.ravel() for v in np.meshgrid(np.arange(2, 2.8, 0.02), np.arange(2, 2.8, 0.02)))
    r = analyse(np.vstack([points, np.column_stack([x, np.full(len(x), 1.1), z])])).report
    assert not r["ceiling"]["observed"] and any("solid area" in (c["rejected"] or "") for c in r["ceiling_candidates"])


def test_erosion_and_guard():
    plan = planes.Plan(np.zeros((1, 3)), PlaneOptions())
    block = np.array([(0.05 + 0.1 * i, 0.0, 0.05 + 0.1 * k) for i in range(5) for k in range(4) for _ in range(3)])
    assert plan.solid(block) == {(i, k) for i in (1, 2, 3) for k in (1, 2)}
    with pytest.raises(ValueError, match="unreasonable"):
        plan.solid(np.array([[0.0, 0, 0], [1e6, 0, 1e6]]))


def test_grouped_by_capture(spark):
    rows = [(name, *map(float, p), k) for name, c in (("a", room()), ("b", room(ceiling=None))) for k, p in enumerate(c)]
    df = spark.createDataFrame(rows, "capture_id string, x double, y double, z double, o long")
    got = {r["capture_id"]: r for r in analysed(df, {"a": [0.0], "b": [0.0]}).collect()}
    alone = json.loads(json.dumps(rounded(analyse(room()).report)))
    report = json.loads(got["a"]["report"])
    assert report["floor"] == alone["floor"] and not json.loads(got["b"]["report"])["ceiling"]["observed"]
    assert [s["kind"] for s in json.loads(got["a"]["surfaces"])] == ["floor", "ceiling"]


def in_blocks(spark, points, most, copies=1):
    rows = [("a", *map(float, p), k) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "capture_id string, x double, y double, z double, o long").crossJoin(spark.range(copies).drop("id"))
    return df, analysed(df, {"a": CAMERA.tolist()}, most=most).first()


def test_large_capture_goes_in_blocks(spark):
    points = room()
    df, row = in_blocks(spark, points, 32_000, copies=4)
    assert blocks(df, 32_000, PlaneOptions()).count() < len(points) < df.count()  # what one process gets does not grow with the points
    whole, report = analyse(np.repeat(points, 4, axis=0)), json.loads(row["report"])
    assert report["point_count"] == 4 * len(points) and row["counts"] == whole.counts.tolist()
    assert report["ceiling_height"]["value_m"] == pytest.approx(whole.report["ceiling_height"]["value_m"], abs=5e-4)
    for name in ("height_m", "sigma_m", "residual_median_m", "residual_p90_m", "x_extent_m", "z_extent_m"):
        assert report["floor"][name] == pytest.approx(whole.report["floor"][name], abs=5e-4)
    assert report["floor"]["inlier_ratio"] == pytest.approx(whole.report["floor"]["inlier_ratio"], rel=5e-3)


def test_blocks_of_like_points_are_exact(spark):
    points = room(noise=0)
    points[:, [0, 2]] += np.random.default_rng(1).choice([0, 0.01, 0.02], (len(points), 2))
    df, row = in_blocks(spark, points, 30_000, copies=3)
    assert blocks(df, 30_000, PlaneOptions()).agg({"n": "sum"}).first()[0] == 3 * len(points)
    assert json.loads(row["report"])["floor"]["solid_area_m2"] == pytest.approx(analyse(np.repeat(points, 3, axis=0)).report["floor"]["solid_area_m2"])


def test_room_heights_in_blocks(spark, monkeypatch):
    from depthloom.plans import planes as plan
    from depthloom.plans.registry import QUERIES

    taken = []
    monkeypatch.setattr(plan, "MOST", 30_000)
    monkeypatch.setattr(plan, "blocks", lambda points, most, options, f=plan.blocks: taken.append(f(points, most, options)) or taken[0])
    row = QUERIES["room_heights"](spark, "/root/testdata/sf0.01").first()
    assert tuple(row) == ("room", -1.4, 2.5, True, True)
    assert taken[0].agg({"n": "max"}).first()[0] > 1 and taken[0].agg({"n": "sum"}).first()[0] == 60_000


def test_size_changes_no_result(spark):
    points = np.vstack([room(noise=0.02, seed=s) for s in range(2)])
    whole = json.loads(json.dumps(rounded(analyse(np.repeat(points, 2, axis=0)).report)))
    for most in (1_000_000, 500):  # far more points than a process may hold: every one counts singly all the same
        _, row = in_blocks(spark, points, most, copies=2)
        assert json.loads(row["report"]) == whole


@pytest.mark.parametrize("sizes", [(1000, 64, 300, 500), (777, 16, 50, 100)])
def test_chunks_change_no_result(monkeypatch, sizes):
    for points in (room(noise=0), np.repeat(room(levels=(1.0, 1.9)).round(2), 2, axis=0)):
        whole = rounded(analyse(points).report)
        with monkeypatch.context() as m:
            for name, size in zip(("CHUNK", "BINS", "HELD", "MOST"), sizes):
                m.setattr(planes, name, size)
            cloud = planes.Cloud(sizes[-1])
            for part in np.array_split(points, 40):
                cloud.add(np.vstack([part.T, np.ones(len(part))]))
            assert rounded(planes.analyse(cloud, CAMERA).report) == whole and cloud.file._rolled


def test_ranks_are_exact(monkeypatch):
    monkeypatch.setattr(planes, "BINS", 8)
    monkeypatch.setattr(planes, "HELD", 20)
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=900), rng.integers(0, 3, 900).astype(float), np.repeat([-1.0, 1.0], 450), np.full(900, 0.1), 1 + rng.random(900) * 1e-12):
        n = rng.integers(1, 5, 900).astype(float)
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert planes.quantile(values, n, share) == pytest.approx(np.quantile(np.repeat(values, n.astype(int)), share), rel=1e-15)


def test_weighted_quantiles():
    rng = np.random.default_rng(0)
    values, n = rng.normal(size=999), rng.integers(1, 9, 999).astype(float)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert planes.quantile(values, n, share) == pytest.approx(np.quantile(np.repeat(values, n.astype(int)), share))
    assert planes.quantile(np.ones(3), np.ones(3) * 2, 0.5) == 1


def test_one_height_is_an_error():
    with pytest.raises(ValueError, match="one height"):
        analyse(np.zeros((10, 3)))
