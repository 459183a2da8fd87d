"""Files that commands write: PLY clouds, trajectories, JSON reports, images."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from depthloom.options import CaptureError
from depthloom.sources import png


def write_ply(path: str | Path, cloud: DataFrame, order: list[str], count: int | None = None) -> None:
    """ASCII PLY of x, y, z in the given order. Rows stream through the driver one partition at a time."""
    path = Path(path)
    rows = cloud.count() if count is None else count
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", encoding="ascii", newline="\n") as file:
            file.write(f"ply\nformat ascii 1.0\nelement vertex {rows}\n" + "".join(f"property float {c}\n" for c in "xyz") + "end_header\n")
            for r in cloud.orderBy(*order).select("x", "y", "z").toLocalIterator():
                file.write("%.5f %.5f %.5f\n" % tuple(r))
    except OSError as error:
        raise CaptureError(f"cannot write {path}: {error}") from error


def read_ply(path: str | Path) -> np.ndarray:
    """The points of an ASCII PLY file as written here."""
    lines = Path(path).read_text().split("end_header\n", 1)[1].split("\n")
    return np.array([[float(x) for x in line.split()] for line in lines if line]).reshape(-1, 3)


def write_trajectory(path: str | Path, ids: list[int], poses: list[np.ndarray]) -> None:
    """CSV of camera positions and rotations, row by row."""
    names = ["frame", "x", "y", "z", *(f"r{i}{j}" for i in range(3) for j in range(3))]
    body = [",".join([str(i), *("%.6f" % v for v in m[:3, 3]), *("%.8f" % v for v in m[:3, :3].ravel())]) for i, m in zip(ids, poses)]
    with open(path, "w", newline="") as file:
        file.write("\r\n".join([",".join(names), *body, ""]))


def rounded(value, digits: int = 5):
    """A report with its numbers rounded, ready for JSON."""
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, digits) for v in value]
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), digits)
    return int(value) if isinstance(value, np.integer) else value


def write_json(path: str | Path, report: dict) -> None:
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def write_raster(path: str | Path, raster: DataFrame, width: int, height: int, margin: int = 70, line: np.ndarray | None = None) -> None:
    """PNG of a (row, col, gray) raster on a white margin, with a path of (col, row) places drawn in red."""
    canvas = np.full((height + 2 * margin, width + 2 * margin, 3), 255, np.uint8)
    seen = raster.select("row", "col", "gray").toArrow()  # as many cells as the picture has pixels
    canvas[np.array(seen.column("row")) + margin, np.array(seen.column("col")) + margin] = np.array(seen.column("gray"))[:, None]
    canvas[margin - 1, margin - 1 : margin + width + 1] = canvas[margin + height, margin - 1 : margin + width + 1] = 0
    canvas[margin - 1 : margin + height + 1, margin - 1] = canvas[margin - 1 : margin + height + 1, margin + width] = 0
    for a, b in zip(line, line[1:]) if line is not None else ():
        steps = int(max(abs(b - a).max(), 1)) + 1
        places = np.round(np.linspace(a, b, steps)).astype(int) + margin
        inside = (places >= 0).all(axis=1) & (places[:, 0] < canvas.shape[1]) & (places[:, 1] < canvas.shape[0])
        canvas[places[inside, 1], places[inside, 0]] = (220, 40, 40)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(png.encode(canvas))


def write_bars(path: str | Path, centres: np.ndarray, counts: np.ndarray, bands: list[tuple[float, float, tuple[int, int, int]]], per_metre: int = 220, width: int = 700) -> None:
    """PNG of a vertical profile: a bar per bin, over shaded bands (low, high, colour)."""
    low, high = np.floor(centres.min()), np.ceil(centres.max())
    height = max(1, int((high - low) * per_metre))
    canvas = np.full((height, width, 3), 255, np.uint8)
    row = lambda y: int(np.clip(height - 1 - (y - low) * per_metre, 0, height - 1))
    for a, b, colour in bands:
        canvas[row(b) : row(a) + 1] = (np.array(colour) * 0.25 + 191).astype(np.uint8)
    for y, n in zip(centres, counts):
        canvas[max(0, row(y) - 1) : row(y) + 1, : int(n / max(counts.max(), 1) * (width - 10))] = 70
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(png.encode(canvas))
