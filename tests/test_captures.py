"""Validation and reconstruction of capture folders."""

import math
import shutil

import numpy as np
import pytest

from depthloom import cli
from depthloom.operators import cloud, frames
from depthloom.options import CaptureError, CloudOptions
from depthloom.plans import reconstruct, validate
from depthloom.sources import png, sinks
from depthloom.sources.capture import camera_intrinsics, load_poses
from depthloom.sources.video import video_size
from tests.captures import HEADER, row, tiny, video

EVERY = CloudOptions(frame_step=1, source_size=(1920, 1440))


def test_a_sound_capture(spark, tmp_path):
    r = validate.validate(spark, tiny(tmp_path / "c"))
    assert (r.depth_frame_count, r.confidence_frame_count, r.pose_frame_count) == (4, 4, 4)
    assert r.status == "VALID" and not r.warnings and not r.errors
    assert r.metadata["depth_stats"]["min"] == 1000 and r.metadata["depth_stats"]["max"] == 1003
    assert r.metadata["confidence_histogram"] == {2: 192} and r.metadata["intrinsics"]["fx"] == 1500
    assert r.metadata["depth_resolution"].startswith("8x6") and r.metadata["odometry_fx_range"] == (1500.0, 1500.0)
    assert ["depth_frame_count", str(r.depth_frame_count)] in [x.split() for x in cli.listing(r).splitlines()]


def test_missing_parts(spark, tmp_path):
    root = tiny(tmp_path / "c")
    (root / "imu.csv").unlink()
    (root / "confidence" / "000002.png").unlink()
    r = validate.validate(spark, root)
    assert r.status == "VALID WITH WARNINGS" and r.missing_frames["depth frame(s) without confidence frame"] == [2] and not r.metadata["depth_confidence_aligned"]
    shutil.rmtree(root / "depth")
    assert validate.validate(spark, root).status == "INVALID"
    gone = validate.validate(spark, tmp_path / "nowhere")
    assert gone.status == "INVALID" and "not a folder" in gone.errors[0]


def test_bad_odometry_rows(spark, tmp_path):
    rows = [row(0), row(1), row(1), "broken, x, y", "  , ,", row(2), row(3).replace("1500.0, 1500.0", "oops, 1500.0")]
    r = validate.validate(spark, tiny(tmp_path / "c", rows=rows))
    assert r.duplicate_pose_frames == [1] and r.status == "INVALID" and r.pose_frame_count == 4
    assert any("2 malformed, on lines 5 8" in w for w in r.warnings)
    only = validate.validate(spark, tiny(tmp_path / "d", rows=["x, y", "z"]))
    assert any("malformed" in e for e in only.errors)
    root = tiny(tmp_path / "e")
    (root / "odometry.csv").write_text("frame,x\n1,2\n")
    assert any("no column named timestamp" in e for e in validate.validate(spark, root).errors)


def test_ids_past_32_bits_and_long_gaps_are_reported(spark, tmp_path):
    root = tiny(tmp_path / "c", n=4)
    (root / "depth" / "99999999999.png").write_bytes(b"")
    (root / "depth" / "2000000000.png").write_bytes(b"")
    (root / "odometry.csv").write_text((root / "odometry.csv").read_text() + "0.0,99999999999,0,0,0,0,0,0,1\n")
    r = validate.validate(spark, root)
    assert any("no frame number, such as 99999999999.png" in w for w in r.warnings) and any("1 malformed" in w for w in r.warnings)
    assert any("1999999996 ids" in w for w in r.warnings) and r.missing_frames[validate.HOLES] == list(range(4, 4 + validate.LISTED))


def test_gaps_nesting_and_exit_codes(spark, tmp_path, capsys):
    root = tiny(tmp_path / "outer" / "inner", n=6)
    for kind in ("depth", "confidence"):
        (root / kind / "000003.png").unlink()
    (root / "depth" / "thumb.png").write_bytes(b"")
    r = validate.validate(spark, tmp_path / "outer")
    assert r.metadata["note"].endswith("inner") and r.missing_frames["depth IDs missing inside sequence"] == [3]
    assert any("no frame number, such as thumb.png" in w for w in r.warnings) and r.missing_frames["pose row(s) without depth frame"] == [3]
    assert cli.main(["validate-lidar", str(tmp_path / "outer")], spark) == 0
    assert cli.main(["validate-lidar", str(tmp_path / "none")], spark) == 1
    assert "RESULT: INVALID" in capsys.readouterr().out


def test_python_numbers(spark):
    cells = ["1", " 2 ", "1_000", "1.5", "1e3", "nan", "-inf", ".5", "5.", "1.0d", "", "abc", "0x10", None, "1__0"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [(r[0], r[1]) for r in df.select(frames.is_float(frames.F.col("c")), frames.is_int(frames.F.col("c"))).collect()]

    def can(f, c):
        try:
            f(c)
        except (ValueError, TypeError):
            return False
        return True

    assert got == [(can(float, c), can(int, c)) for c in cells]


def test_last_pose_wins_and_intrinsics_are_all_or_none(spark, tmp_path):
    path = tmp_path / "o.csv"
    lines = [HEADER, row(0), row(0).replace("0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0", "7.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0"), row(1).replace("1500.0, 1500.0, 960.0, 720.0", "1500.0, , 960.0, 720.0"), "bad"]
    path.write_text("﻿" + "\n".join(lines), encoding="utf-8")
    poses = {r["frame_id"]: r for r in load_poses(spark, path).collect()}
    assert set(poses) == {0, 1} and poses[0]["x"] == 7.0 and poses[1]["fx"] is None and poses[0]["cx"] == 960.0
    assert camera_intrinsics(tmp_path / "no.csv") is None


def test_reconstruction(spark, tmp_path):
    root, out = tiny(tmp_path / "c"), tmp_path / "o" / "cloud.ply"
    r = reconstruct.reconstruct(spark, root, out, EVERY)
    assert (r.candidate_points, r.removed_by_depth, r.removed_by_confidence, r.points_after_filter) == (192, 4, 0, 188)
    points = sinks.read_ply(out)
    assert len(points) == r.points_after_downsample and points[:, 2].min() >= 0.99 and points[:, 2].max() <= 1.01
    first = out.read_bytes()
    assert reconstruct.reconstruct(spark, root, out, EVERY) and out.read_bytes() == first
    assert first.startswith(b"ply\nformat ascii 1.0\nelement vertex ")
    assert ["points_after_filter", "188"] in [x.split() for x in cli.listing(r).splitlines()]


@pytest.mark.parametrize(
    ("change", "options", "message"),
    [
        (lambda r: (r / "depth" / "000001.png").write_bytes(b"junk"), EVERY, "INVALID"),
        (lambda r: None, CloudOptions(frame_step=1), "--source-size"),
        (lambda r: None, CloudOptions(frame_step=1, source_size=(1920, 1080)), "aspect"),
        (lambda r: None, CloudOptions(frame_step=0, source_size=(1920, 1440)), "--frame-step"),
        (lambda r: None, CloudOptions(frame_step=1, min_range_m=3.0, source_size=(1920, 1440)), "no valid depth points"),
        (lambda r: (r / "confidence" / "000001.png").unlink(), EVERY, "confidence frame 1 is missing"),
        (lambda r: (r / "odometry.csv").write_text((r / "odometry.csv").read_text().replace("0.0, 0.0, 0.0, 1.0", "0.0, 0.0, 0.0, 0.0")), EVERY, "quaternion"),
    ],
)
def test_reconstruction_errors(spark, tmp_path, change, options, message):
    root = tiny(tmp_path / "c")
    change(root)
    with pytest.raises(CaptureError, match=message):
        reconstruct.reconstruct(spark, root, tmp_path / "x.ply", options)


def test_confidence_can_be_ignored_and_video_gives_the_size(spark, tmp_path):
    root = tiny(tmp_path / "c")
    shutil.rmtree(root / "confidence")
    (root / "rgb.mp4").write_bytes(video())
    assert reconstruct.reconstruct(spark, root, tmp_path / "x.ply", CloudOptions(frame_step=1, min_confidence=0)).points_after_filter == 188
    with pytest.raises(CaptureError, match="confidence/: not found"):
        reconstruct.reconstruct(spark, root, tmp_path / "x.ply", CloudOptions(frame_step=1))


def test_video_size(tmp_path):
    path = tmp_path / "v.mp4"
    path.write_bytes(video(640, 480))
    assert video_size(path) == (640, 480)
    path.write_bytes(b"fake")
    with pytest.raises(ValueError, match="no video track"):
        video_size(path)


def test_frame_selection(spark):
    pick = lambda n, step, most: [r["id"] for r in frames.select_frames(spark.range(n).withColumnRenamed("id", "frame_id"), step, most).orderBy("rank").collect()]
    assert pick(100, 1, 5) == [0, 25, 50, 74, 99] and pick(10, 3, None) == [0, 3, 6, 9] and pick(10, 1, 1) == [0] and pick(4, 1, 9) == [0, 1, 2, 3]
    spread = spark.createDataFrame([(i * 70000,) for i in range(5)], "frame_id int")
    assert [r["rank"] for r in frames.numbered(spread).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert frames.gaps(spread).count() == 4


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png_round_trip(dtype):
    a = np.random.default_rng(0).integers(0, np.iinfo(dtype).max, (7, 5), dtype=dtype)
    assert (png.decode(png.encode(a)) == a).all() and png.decode(png.encode(a)).dtype == dtype
    with pytest.raises(ValueError):
        png.decode(b"nope")


def test_png_filters():
    """Each row filter undone, from rows filtered by the published formulas."""
    import struct
    import zlib

    a = np.random.default_rng(3).integers(0, 255, (5, 9), dtype=np.uint8)
    left, up = np.pad(a, ((0, 0), (1, 0)))[:, :-1].astype(int), np.pad(a, ((1, 0), (0, 0)))[:-1].astype(int)
    corner = np.pad(a, ((1, 0), (1, 0)))[:-1, :-1].astype(int)

    def paeth(l, u, c):
        p = l + u - c
        return min(((abs(p - l), 0, l), (abs(p - u), 1, u), (abs(p - c), 2, c)))[2]

    guess = [0 * left, left, up, (left + up) // 2, np.vectorize(paeth)(left, up, corner)]
    body = b"".join(bytes([k]) + ((a[k].astype(int) - guess[k][k]) % 256).astype(np.uint8).tobytes() for k in range(5))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + bytes(4)
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (png.decode(data) == a).all()


def test_sanity_flags(tmp_path):
    r = reconstruct.Result(tmp_path, tmp_path, trajectory=np.zeros((2, 3)), extent=np.array([[0, 0, 0], [60.0, 1, 1]]))
    assert any("beyond a building" in f for f in reconstruct.sanity_flags(r, 5.0)) and math.isfinite(r.extent.max())


def test_first_point_per_voxel(spark):
    rows = [(0, 0, 1, 0.012, 0.0, 0.0), (0, 0, 0, 0.011, 0.0, 0.0), (1, 0, 0, 0.01, 0.0, 0.0), (0, 1, 0, 0.06, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame_id int, v int, u int, x float, y float, z float")
    got = sorted(r["x"] for r in cloud.first_per_voxel(df, 0.05).collect())
    assert np.allclose(got, [0.011, 0.06])
    with pytest.raises(ValueError):
        cloud.first_per_voxel(df, 0.0)
