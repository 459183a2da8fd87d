"""From depth pixels to a voxel-deduplicated world cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.options import CloudOptions


def range_ok(options: CloudOptions) -> Column:
    """Single-precision range test as bounds on the raw integer, which a scan can push down."""
    low, high = g.raw_bounds(options.min_range_m, options.max_range_m)
    return F.col("raw").between(low, high)


def filtered(pixels: DataFrame, options: CloudOptions) -> DataFrame:
    kept = pixels.filter(range_ok(options))
    return kept.filter(F.col("conf") >= options.min_confidence) if options.min_confidence > 0 else kept


def filter_counters(pixels: DataFrame, options: CloudOptions) -> DataFrame:
    """One row: candidate pixels, those removed by depth, and of the rest those removed by confidence."""
    ok = range_ok(options)
    unsure = ok & (F.col("conf") < options.min_confidence) if options.min_confidence > 0 else F.lit(False)
    return pixels.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(~ok).alias("removed_by_depth"), F.count_if(unsure).alias("removed_by_confidence"))


def camera_points(pixels: DataFrame, poses: DataFrame, options: CloudOptions, source: tuple[int, int], depth: tuple[int, int]) -> DataFrame:
    """Filtered pixels in camera space, with their frame's matrix. The poses' side, as small as the number of frames, is the one that is hashed, part by part: by the size of its files, the planner may have the driver broadcast the pixels."""
    intr = g.scaled_intrinsics(source, depth, "")
    poses = g.with_matrices(poses).select(F.col("frame_id").alias("pose_frame"), *g.MATRIX, *[c.alias(f"s_{k}") for k, c in intr.items()])
    met = filtered(pixels, options).join(poses.hint("shuffle_hash"), F.col("frame_id") == F.col("pose_frame"))
    x, y, z = g.back_projected(F.col("u"), F.col("v"), F.col("raw"), *(F.col(f"s_{k}") for k in ("fx", "fy", "cx", "cy")))
    return met.select("frame_id", "v", "u", *g.MATRIX, x.alias("cx_m"), y.alias("cy_m"), z.alias("cz_m"))


def world_points(camera: DataFrame) -> DataFrame:
    """(frame_id, v, u, x, y, z) in single precision."""
    moved = g.moved(F.col("cx_m"), F.col("cy_m"), F.col("cz_m"))
    return camera.select("frame_id", "v", "u", *[c.cast("float").alias(n) for n, c in zip("xyz", moved)])


def order_key(frame: str = "frame_id") -> Column:
    """Input order packed into one number: frames, then rows, then columns of the image (below 65536 each)."""
    return F.shiftleft(F.col(frame).cast("bigint"), 32) + F.shiftleft(F.col("v").cast("bigint"), 16) + F.col("u").cast("bigint")


def first_per_voxel(points: DataFrame, voxel: float, key: Column | None = None, keep: tuple[str, ...] = (), single: bool = True) -> DataFrame:
    """One point per occupied voxel, the first in input order: (keep..., ix, iy, iz, x, y, z).

    Minima by a packed number are partial aggregates of fixed width, so each
    task sends at most one row per voxel that it saw.
    """
    if voxel <= 0:
        raise ValueError("voxel_size must be positive")
    key = order_key() if key is None else key
    cells = points.select("*", *[g.cell_index(F.col(c), voxel, single).alias(f"i{c}") for c in "xyz"], key.alias("_k"))
    return cells.groupBy(*keep, "ix", "iy", "iz").agg(*[F.min_by(c, "_k").alias(c) for c in "xyz"])


def centroid_per_voxel(points: DataFrame, voxel: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mean point of each voxel, on a grid that begins half a voxel under the least coordinates."""
    least = points.agg(*[F.min(c).alias(f"m{c}") for c in "xyz"]).first()
    if least is None or least["mx"] is None:
        return points.select(*keep, *[F.lit(0).cast("bigint").alias(f"i{c}") for c in "xyz"], "x", "y", "z").limit(0)
    cell = lambda c: F.floor((F.col(c) - g.lit(least[f"m{c}"] - voxel / 2)) / g.lit(voxel)).cast("bigint")
    cells = points.select("*", *[cell(c).alias(f"i{c}") for c in "xyz"])
    return cells.groupBy(*keep, "ix", "iy", "iz").agg(*[F.avg(c).alias(c) for c in "xyz"])


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def all_finite(points: DataFrame) -> bool:
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    return points.filter(bad).isEmpty()


def every_third(cells: DataFrame) -> DataFrame:
    """Every third row of each frame, in order of its cells."""
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("ix", "iy", "iz")) - 1
    return cells.withColumn("_r", rank).filter(F.pmod("_r", F.lit(3)) == 0).drop("_r")
