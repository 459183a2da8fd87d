"""A capture folder as relations: listings, odometry rows, poses, pixels."""

from __future__ import annotations

import csv

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthloom.operators import frames
from depthloom.options import CaptureError
from depthloom.sources import png

INTRINSICS = ["fx", "fy", "cx", "cy"]


def capture_root(path: Path) -> Path:
    """The folder that holds the data: this one, or its only sub-folder."""
    holds = lambda p: (p / "depth").is_dir() or (p / "odometry.csv").is_file()
    below = [p for p in path.iterdir() if p.is_dir()]
    return below[0] if not holds(path) and len(below) == 1 and holds(below[0]) else path


def listing(spark: SparkSession, folder: Path) -> DataFrame:
    """file_name of a folder's files. Only names are read, on the driver."""
    return spark.createDataFrame([(p.name,) for p in sorted(folder.iterdir())], "file_name string")




def odometry_rows(spark: SparkSession, path: Path) -> tuple[list[str], DataFrame | None]:
    """The header's names, and rows: line_no and a text column c_<name> per name (the last of equal names; null where the row is short)."""
    with open(path, newline="", encoding="utf-8-sig") as file:
        lines = csv.reader(file)
        header = [h.strip().lower() for h in next(lines, [])]
        place = {name: i for i, name in enumerate(header)}
        rows = [(n, *[row[i] if i < len(row) else None for i in place.values()]) for n, row in enumerate(lines, start=2)]
    schema = ", ".join(["line_no bigint", *[f"`c_{name}` string" for name in place]])
    return header, spark.createDataFrame(rows, schema)


def load_poses(spark: SparkSession, path: Path) -> DataFrame:
    """frame_id, x, y, z, qx, qy, qz, qw and fx, fy, cx, cy (null unless all four are numbers); the last good row of a frame wins."""
    header, rows = odometry_rows(spark, path)
    needed = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    empty = spark.createDataFrame([], "frame_id int, " + ", ".join(f"{c} double" for c in needed + INTRINSICS))
    if rows is None or not {"frame", *needed} <= set(header):
        return empty
    value = {c: frames.to_double(F.col(f"c_{c}")) for c in needed}
    inner = {c: frames.to_double(F.col(f"c_{c}")) if c in header else F.lit(None).cast("double") for c in INTRINSICS}
    whole = F.lit(True)
    for c in inner.values():
        whole = whole & c.isNotNull()
    good = rows.select("line_no", frames.to_int(F.col("c_frame")).alias("frame_id"), *[c.alias(k) for k, c in value.items()], *[F.when(whole, c).alias(k) for k, c in inner.items()]).dropna(subset=["frame_id", *needed])
    packed = good.groupBy("frame_id").agg(F.max_by(F.struct(*needed, *INTRINSICS), "line_no").alias("s"))
    return packed.select("frame_id", "s.*")


def matrix_rows(path: Path, encoding: str) -> list[list[float]]:
    with open(path, newline="", encoding=encoding) as file:
        return [[float(c) for c in row] for row in csv.reader(file) if row and any(c.strip() for c in row)]


def camera_intrinsics(path: Path) -> dict[str, float] | None:
    """fx, fy, cx, cy of a camera matrix, if the four cells are there."""
    try:
        m = matrix_rows(path, "utf-8")
        return {"fx": m[0][0], "fy": m[1][1], "cx": m[0][2], "cy": m[1][2]}
    except (OSError, ValueError, IndexError):
        return None


def pixels(spark: SparkSession, root: Path, ids: list[int], size: tuple[int, int] | None, with_confidence: bool) -> DataFrame:
    """(frame_id, v, u, raw, conf) of the given frames; conf is 0 where none is read. Depth and confidence of a frame are decoded together, in the task that has the frame."""
    both = "depth", *(("confidence",) if with_confidence else ())
    for kind in both:
        for i in ids:
            if not (root / kind / f"{i:06d}.png").is_file():
                raise CaptureError(f"confidence frame {i} is missing, and --min-confidence 0 does without" if kind == "confidence" else f"depth frame {i} is missing")
    read = lambda kind: spark.read.format("binaryFile").load([str(root / kind / f"{i:06d}.png") for i in ids]).select(F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("int").alias("frame_id"), F.col("content").alias(kind))
    files = read("depth")
    if with_confidence:
        files = files.join(read("confidence"), "frame_id")
    else:
        files = files.withColumn("confidence", F.lit(None).cast("binary"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, depth, confidence in zip(*(c.to_pylist() for c in batch.columns)):
                raw = image(depth, f"{i:06d}.png")
                if size is not None and raw.shape != (size[1], size[0]):
                    raise CaptureError(f"depth frame {i} has shape {raw.shape}, expected {(size[1], size[0])}")
                conf = np.zeros(raw.shape, np.uint8) if confidence is None else image(confidence, f"{i:06d}.png")
                if conf.shape != raw.shape:
                    raise CaptureError(f"confidence frame {i} has shape {conf.shape}, expected {raw.shape}")
                v, u = np.divmod(np.arange(raw.size, dtype=np.int32), raw.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(raw.size, i, np.int32)), pa.array(v.astype(np.int32)), pa.array(u.astype(np.int32)), pa.array(raw.ravel().astype(np.int32)), pa.array(conf.ravel().astype(np.int32))], names=["frame_id", "v", "u", "raw", "conf"])

    return files.select("frame_id", "depth", "confidence").mapInArrow(unpack, "frame_id int, v int, u int, raw int, conf int")


def image(data: bytes, name: str) -> np.ndarray:
    try:
        return png.decode(data)
    except ValueError as error:
        raise CaptureError(f"could not read {name}: {error}") from error


