"""Small synthetic captures and scenes."""

import struct
from pathlib import Path

import numpy as np

from depthloom.sources import png

HEADER = "timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy, distortion_center_x, distortion_center_y"


def row(i, frame=None):
    return f"{i}.0, {i:06d}, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1500.0, 1500.0, 960.0, 720.0, , " if frame is None else frame


def tiny(root: Path, n=4, rows=None) -> Path:
    for kind in ("depth", "confidence"):
        (root / kind).mkdir(parents=True)
    (root / "odometry.csv").write_text("\n".join([HEADER, *(rows if rows is not None else [row(i) for i in range(n)])]) + "\n")
    (root / "camera_matrix.csv").write_text("1500.0,0.0,960.0\n0.0,1500.0,720.0\n0.0,0.0,1.0\n")
    (root / "imu.csv").write_text("timestamp, a_x, a_y, a_z, alpha_x, alpha_y, alpha_z\n0,0,0,0,0,0,0\n")
    (root / "rgb.mp4").write_bytes(b"fake")
    for i in range(n):
        depth = np.full((6, 8), 1000 + i, np.uint16)
        depth[0, 0] = 0
        (root / "depth" / f"{i:06d}.png").write_bytes(png.encode(depth))
        (root / "confidence" / f"{i:06d}.png").write_bytes(png.encode(np.full((6, 8), 2, np.uint8)))
    return root


def video(width=1920, height=1440) -> bytes:
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", width << 16, height << 16))
    return box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", bytes(20)) + box(b"trak", tkhd))


def corner(step=0.02):
    """Three orthogonal planes."""
    a, b, c = np.arange(-1, 1.5, step), np.arange(1, 3, step), np.arange(-1, 2, step)
    flat = lambda x, y, z: np.column_stack([v.ravel() for v in np.broadcast_arrays(x, y, z)])
    return np.vstack([flat(2.0, a[:, None], b[None]), flat(c[:, None], 1.5, b[None]), flat(c[:, None], a[None], 3.0)])


def room(ceiling=1.1, noise=0.01, seed=0, tilt_deg=0.0, levels=None):
    """A 6 x 5 m floor at -1.4, walls, and a ceiling (or two, split along x)."""
    rng = np.random.default_rng(seed)
    x, z = (v.ravel() for v in np.meshgrid(np.arange(0, 6, 0.05), np.arange(0, 5, 0.05)))
    parts = [np.column_stack([x, np.full(len(x), -1.4), z])]
    if levels:
        parts.append(np.column_stack([x, np.where(x < 3, levels[0], levels[1]), z]))
    elif ceiling is not None:
        parts.append(np.column_stack([x, np.full(len(x), ceiling), z]))
    heights = np.arange(-1.4, 1.0, 0.05)
    for w in (0.0, 6.0):
        zz, yy = (v.ravel() for v in np.meshgrid(np.arange(0, 5, 0.05), heights))
        parts.append(np.column_stack([np.full(len(zz), w), yy, zz]))
    points = np.vstack(parts)
    points[:, 1] += rng.normal(0, noise, len(points))
    t = np.radians(tilt_deg)
    turn = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    return points @ turn.T


CAMERA = np.zeros(9)
