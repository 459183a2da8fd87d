"""Pinhole and rigid-motion algebra as Column expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.options import DEPTH_SCALE

AXES = range(3)
ROTATION = [f"r{i}{j}" for i in AXES for j in AXES]
MATRIX = [*ROTATION, "tx", "ty", "tz"]


def lit(x: float) -> Column:
    return F.lit(float(x))


def rotation_columns(qx: Column, qy: Column, qz: Column, qw: Column) -> dict[str, Column]:
    """The nine entries of a normalised quaternion's rotation; a zero or non-finite one is an error."""
    norm = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    sound = (norm >= 1e-9) & (norm < float("inf")) & ~F.isnan(norm)
    n = F.when(sound, norm).otherwise(F.raise_error(F.lit("quaternion has zero or non-finite length")).cast("double"))
    x, y, z, w = (c / n for c in (qx, qy, qz, qw))
    two = lit(2)
    rows = [
        [1 - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w)],
        [two * (x * y + z * w), 1 - two * (x * x + z * z), two * (y * z - x * w)],
        [two * (x * z - y * w), two * (y * z + x * w), 1 - two * (x * x + y * y)],
    ]
    return {f"r{i}{j}": rows[i][j] for i in AXES for j in AXES}


def with_matrices(poses: DataFrame) -> DataFrame:
    """Poses (x, y, z, qx, qy, qz, qw) with r00..r22 and tx, ty, tz."""
    rotation = rotation_columns(*(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    return poses.select("*", *[c.alias(k) for k, c in rotation.items()], F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))


def scaled_intrinsics(source: tuple[int, int], depth: tuple[int, int], prefix: str = "") -> dict[str, Column]:
    """fx, fy, cx, cy of the columns of that name, from the source's image size to the depth image's."""
    sx, sy = depth[0] / source[0], depth[1] / source[1]
    return {c: F.col(prefix + c) * lit(s) for c, s in (("fx", sx), ("fy", sy), ("cx", sx), ("cy", sy))}


def back_projected(u: Column, v: Column, raw: Column, fx: Column, fy: Column, cx: Column, cy: Column, scale: float = DEPTH_SCALE) -> tuple[Column, Column, Column]:
    """Camera-space metres of a depth pixel: +X right, +Y down, +Z forward."""
    z = raw.cast("double") * lit(scale)
    return (u - cx) * z / fx, (v - cy) * z / fy, z


def moved(x: Column, y: Column, z: Column, m: str = "") -> tuple[Column, Column, Column]:
    """R p + t with the matrix in columns r00.., tx.. under a prefix."""
    c = lambda name: F.col(m + name)
    return tuple(c(f"r{i}0") * x + c(f"r{i}1") * y + c(f"r{i}2") * z + c(t) for i, t in enumerate(("tx", "ty", "tz")))


def _m(prefix: str) -> tuple[list[list[Column]], list[Column]]:
    return [[F.col(f"{prefix}r{i}{j}") for j in AXES] for i in AXES], [F.col(prefix + t) for t in ("tx", "ty", "tz")]


def _product(a, b):
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in AXES] for i in AXES]


def _transposed(a):
    return [[a[j][i] for j in AXES] for i in AXES]


def _named(r, t) -> dict[str, Column]:
    return {f"r{i}{j}": r[i][j] for i in AXES for j in AXES} | dict(zip(("tx", "ty", "tz"), t))


def relative(source: str, target: str) -> dict[str, Column]:
    """inv(target) * source: from the source camera to the target camera."""
    (rs, ts), (rt, tt) = _m(source), _m(target)
    back = _transposed(rt)
    d = [a - b for a, b in zip(ts, tt)]
    return _named(_product(back, rs), [row[0] * d[0] + row[1] * d[1] + row[2] * d[2] for row in back])


def correction(original: str, optimised: str) -> dict[str, Column]:
    """The world-frame motion that takes the original pose to the optimised one."""
    (ro, to), (rn, tn) = _m(original), _m(optimised)
    r = _product(rn, _transposed(ro))
    return _named(r, [tn[i] - (r[i][0] * to[0] + r[i][1] * to[1] + r[i][2] * to[2]) for i in AXES])


def corrected(pose: str, motion: str) -> dict[str, Column]:
    """motion * pose."""
    (rp, tp), (rm, tm) = _m(pose), _m(motion)
    return _named(_product(rm, rp), [rm[i][0] * tp[0] + rm[i][1] * tp[1] + rm[i][2] * tp[2] + tm[i] for i in AXES])


def _degrees_of_cosine(c: Column) -> Column:
    return F.degrees(F.acos(F.greatest(lit(-1), F.least(lit(1), c))))


def angle_deg(m: str = "") -> Column:
    """Rotation angle of a matrix, from its trace."""
    return _degrees_of_cosine((F.col(f"{m}r00") + F.col(f"{m}r11") + F.col(f"{m}r22") - 1) / lit(2))


def shift_m(m: str = "") -> Column:
    return F.sqrt(F.col(f"{m}tx") * F.col(f"{m}tx") + F.col(f"{m}ty") * F.col(f"{m}ty") + F.col(f"{m}tz") * F.col(f"{m}tz"))


def tilt_change_deg(before: str, after: str) -> Column:
    """Change of roll and pitch: between where world-up points in the camera before and after."""
    return _degrees_of_cosine(sum((F.col(f"{before}r1{j}") * F.col(f"{after}r1{j}") for j in (1, 2)), F.col(f"{before}r10") * F.col(f"{after}r10")))


def tilt_restored(original: str, optimised: str) -> dict[str, Column]:
    """The optimised place and heading with the original roll and pitch."""
    (ro, _), (rn, tn) = _m(original), _m(optimised)
    d = _product(rn, _transposed(ro))
    theta = F.atan2(d[0][2] - d[2][0], d[0][0] + d[2][2])
    c, s = F.cos(theta), F.sin(theta)
    r = [[c * ro[0][j] + s * ro[2][j] for j in AXES], ro[1], [c * ro[2][j] - s * ro[0][j] for j in AXES]]
    return _named(r, tn)


@lru_cache(maxsize=64)
def raw_bounds(min_range_m: float, max_range_m: float, scale: float = DEPTH_SCALE) -> tuple[int, int]:
    """The raw 16-bit depths whose single-precision metres lie in the range; (1, 0) if none does."""
    raw = np.arange(1, 1 << 16, dtype=np.uint16)
    metres = raw.astype(np.float32) * np.float32(scale)
    good = raw[(metres >= np.float32(min_range_m)) & (metres <= np.float32(max_range_m))]
    return (int(good[0]), int(good[-1])) if len(good) else (1, 0)


def cell_index(x: Column, size: float, single: bool = False) -> Column:
    """floor(x / size) as BIGINT; single: x is FLOAT and the quotient is rounded to single precision first."""
    if single:
        return F.floor((x.cast("double") / lit(float(np.float32(size)))).cast("float")).cast("bigint")
    return F.floor(x / lit(size)).cast("bigint")


# Plane y = p x + q z + r
def plane_tilt_deg(p: Column, q: Column) -> Column:
    return _degrees_of_cosine(1 / F.sqrt(p * p + q * q + 1))


def plane_equation(p: Column, q: Column, r: Column) -> list[Column]:
    """a, b, c, d with the unit normal pointing up."""
    n = F.sqrt(p * p + q * q + 1)
    return [-p / n, 1 / n, -q / n, -r / n]


def tukey_weight(residual: Column, scale: Column) -> Column:
    u = residual / (lit(4.685) * scale)
    return F.when(F.abs(u) >= 1, lit(0)).otherwise((1 - u * u) * (1 - u * u))


def heading_limit(degrees: float) -> float:
    return math.cos(math.radians(degrees))
