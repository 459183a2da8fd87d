"""Registration, loops, the pose graph, and the whole ablation."""

import json

import numpy as np
import pytest

from depthloom import cli
from depthloom.operators import metrics
from depthloom.operators import registration as reg
from depthloom.options import CaptureError, CloudOptions, DriftOptions
from depthloom.plans import drift, planes
from depthloom.sources import png
from tests.captures import HEADER, corner, tiny

OPTIONS = DriftOptions()


def pose(z=0.0, x=0.0, turn=0.0):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = reg.rotation(np.radians([0, turn, 0])), [x, 0, z]
    return m


def scan(at):
    p = (corner() - at[:3, 3]) @ at[:3, :3]
    return reg.Scan.of(p, OPTIONS)


def test_alignment_recovers_an_offset():
    a, b = pose(), pose(0.05)
    off = pose(0.03, 0.05, 1.5)
    found, fitness, rmse = reg.align(scan(a), scan(b), reg.relative(a, b) @ off, [0.25, 0.1])
    shift, turn = reg.motion(reg.rigid_inverse(reg.relative(a, b)) @ found)
    assert shift < 0.01 and turn < 0.3 and fitness > 0.8 and rmse < 0.03


def test_too_few_points_and_gates():
    few = reg.Scan(np.zeros((5, 3)), np.zeros((5, 3)))
    assert reg.register((0, 1), (few, few), (pose(), pose()), "sequential", OPTIONS).reason == "too few points"
    limits = {"min_fitness": 0.5, "max_rmse": 0.05, "max_translation": 0.15, "max_rotation_deg": 5.0}
    assert reg.verdict(0.4, 1, 1, 9, limits) == "fitness 0.40 < 0.5" and reg.verdict(0.9, 0.06, 1, 9, limits).startswith("inlier RMSE")
    assert reg.verdict(0.9, 0.01, 0.2, 9, limits) == "correction 0.200 m > 0.15" and reg.verdict(0.9, 0.01, 0.1, 9, limits) == "correction 9.0 deg > 5.0" and reg.verdict(0.9, 0.01, 0.1, 1, limits) == "ok"


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-1, 1, (200, 3)), rng.uniform(-1, 1, (300, 3))
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    query, point, dist = reg.Cells(b, 0.2).nearest(a)
    near = np.flatnonzero(d.min(axis=1) <= 0.2)
    assert query.tolist() == near.tolist() and np.allclose(dist, d.min(axis=1)[near]) and (point == d.argmin(axis=1)[near]).all()


def test_normals_face_the_camera():
    s = scan(pose())
    assert ((s.points * s.normals).sum(axis=1) <= 1e-9).all() and np.mean(np.abs(s.normals).max(axis=1) > 0.99) > 0.9


def test_level_keeps_tilt():
    a, b = pose(), pose(0.1, turn=3)
    tilted = np.eye(4)
    tilted[:3, :3] = reg.rotation(np.array([0.02, 0.01, -0.03]))
    edge = reg.level(reg.relative(a, b) @ tilted, a, b)
    implied = a @ reg.rigid_inverse(edge)
    assert reg.tilt_change(b, implied) < 1e-6


def test_loops(spark):
    out = [pose(x=0.3 * min(k, 29 - k)) for k in range(30)]
    found = drift.loop_pairs(spark, list(range(30)), out, OPTIONS)
    assert found and all(j - i >= 15 for i, j in found) and len({i for i, _ in found}) == len(found)
    back = [pose(x=0.3 * min(k, 29 - k), turn=0 if k < 15 else 180) for k in range(30)]
    assert drift.loop_pairs(spark, list(range(30)), back, OPTIONS) == []
    assert len(drift.loop_pairs(spark, list(range(200)), [pose(x=0.001 * k) for k in range(200)], OPTIONS)) == 20


def edges_of(poses, noise, loops=()):
    rng = np.random.default_rng(1)
    out = []
    for i, j, kind in [(k, k + 1, "sequential") for k in range(len(poses) - 1)] + list(loops):
        true = reg.relative(poses[i], poses[j])
        out.append(reg.Edge(i, j, kind, True, "ok", 1.0, 0.0, 0.0, 0.0, true, true @ pose(*(rng.normal(0, noise, 2) if noise else (0, 0))), np.eye(6) * 1000))
    return out


def test_neighbours_are_not_broadcast(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["neighbour_residual"](spark, entry.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # not even where the files are small


def test_graph_keeps_exact_poses_and_pulls_loops_shut():
    true = [pose(x=0.1 * k) for k in range(20)]
    index = {k: k for k in range(20)}
    same = reg.optimise(true, edges_of(true, 0), index, OPTIONS)
    assert max(np.abs(a - b).max() for a, b in zip(same, true)) < 1e-6
    drifted = [pose(x=0.1 * k + 0.002 * k) for k in range(20)]
    edges = edges_of(drifted, 0)
    target = reg.relative(true[0], true[19])
    edges.append(reg.Edge(0, 19, "loop", True, "ok", 1.0, 0.0, 0.0, 0.0, reg.relative(drifted[0], drifted[19]), target, np.eye(6) * 1000))
    fixed = reg.optimise(drifted, edges, index, OPTIONS)
    assert (fixed[0] == drifted[0]).all() and abs(fixed[19][0, 3] - 1.9) < abs(drifted[19][0, 3] - 1.9) / 2
    edges[-1].refined = reg.relative(pose(), pose(x=9.0))  # a false loop is pruned
    assert np.abs(reg.optimise(drifted, edges, index, OPTIONS)[19] - drifted[19]).max() < 0.02


def test_correction_of_exact_frames(spark):
    poses = [pose(0.05 * k) for k in range(6)]
    clouds = [scan(p) for p in poses]
    frame = spark.createDataFrame([(k, c.points.tobytes(), c.normals.tobytes()) for k, c in enumerate(clouds)], "frame_id int, points binary, normals binary")
    got = drift.estimate(spark, frame, list(range(6)), poses, OPTIONS)
    s = got.summary()
    assert len(got.edges) == 5 and all(e.accepted for e in got.edges) and s["max_translation_m"] < 0.002 and s["max_rotation_deg"] < 0.1 and s["max_tilt_change_deg"] < 0.05
    few = spark.createDataFrame([(k, c.points[:9].tobytes(), c.normals[:9].tobytes()) for k, c in enumerate(clouds)], frame.schema)
    none = drift.estimate(spark, few, list(range(6)), poses, OPTIONS)
    assert all((a == b).all() for a, b in zip(none.original, none.corrected)) and not any(e.accepted for e in none.edges)


def metric_values(**changed):
    return dict(overlap=0.5, neighbour_residual_median_m=0.02, floor_band_thickness_m=0.1, floor_peak_share=0.2, wall_slab_cells_per_1000_points=15.0, footprint_x_m=10.0, footprint_z_m=10.0) | changed


@pytest.mark.parametrize(
    ("after", "reason"),
    [(dict(overlap=0.55), None), (dict(), "no metric gains"), (dict(overlap=0.55, floor_peak_share=0.1), "worse: floor_peak_share"), (dict(overlap=0.55, footprint_x_m=11.0), "footprint_x_m off by over 5%")],
)
def test_judge(spark, after, reason):
    exact = reg.correct([0, 1], [pose(), pose(0.1)], [], 0, OPTIONS)
    good, why, _ = drift.judge(spark, metric_values(), metric_values(**after), exact, __import__("depthloom.options", fromlist=["x"]).AcceptanceRules())
    assert good == (reason is None) and (reason is None or why.startswith(reason))


def room_capture(root):
    """Five frames of a box-shaped room, ray-cast."""
    tiny(root, 0, rows=[])
    rows = [HEADER]
    h, w = 48, 64
    v, u = np.mgrid[:h, :w]
    rays = np.stack([(u - w / 2) / 50, (v - h / 2) / 50, np.ones((h, w))], -1)
    for k in range(5):
        at = np.array([0.03 * k, 0.0, 0.02 * k])
        low, high = np.array([-1.5, -1.2, -1.0]), np.array([1.7, 1.1, 2.6])
        with np.errstate(divide="ignore"):
            t = np.where(rays > 0, (high - at) / rays, np.where(rays < 0, (low - at) / rays, np.inf)).min(axis=-1)
        (root / "depth" / f"{k:06d}.png").write_bytes(png.encode(np.round(t * 1000).astype(np.uint16)))
        (root / "confidence" / f"{k:06d}.png").write_bytes(png.encode(np.full((h, w), 2, np.uint8)))
        rows.append(f"{k}, {k:06d}, {at[0]}, {at[1]}, {at[2]}, 0, 0, 0, 1, 500, 500, 320, 240, ,")
    (root / "odometry.csv").write_text("\n".join(rows) + "\n")
    return root


def test_ablation_and_planes_end_to_end(spark, tmp_path, capsys):
    root, out = room_capture(tmp_path / "cap" / "c"), tmp_path / "o"
    options = CloudOptions(frame_step=1, max_frames=400, source_size=(640, 480))
    report = drift.run(spark, root, out, options)
    assert json.loads((out / "drift_report.json").read_text()) == report and report["frames_used"] == 5 and report["sequential_edges"]["attempted"] == 4
    assert report["pose_correction"]["max_translation_m"] < 0.05 and report["before"]["points"] > 1000
    for name in ("before.ply", "after.ply", "trajectory_before.csv", "trajectory_after.csv", "before_topdown.png", "after_topdown.png"):
        assert (out / name).stat().st_size > 0
    assert (out / "trajectory_before.csv").read_text().splitlines()[1].startswith("0,0.000000,0.000000,0.000000,1.00000000")
    assert any(line.split() == ["sequential_edges.attempted", "4"] for line in cli.listing(report).splitlines())
    assert cli.main(["analyze-horizontal-planes", str(root), "--output-dir", str(out), "--source-size", "640x480"], spark) == 0
    said = capsys.readouterr().out
    assert "point_count" in said and (out / "horizontal_planes.json").is_file() and (out / "side_projection.png").is_file()
    with pytest.raises(CaptureError, match="at least 3"):
        drift.run(spark, root, out, CloudOptions(frame_step=3, source_size=(640, 480)))
    assert planes.SCHEMA and metrics.DIRECTIONS
