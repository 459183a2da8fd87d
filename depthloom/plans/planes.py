"""Floor and ceiling analysis of a capture's production cloud."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.operators import planes, profile
from depthloom.options import AcceptanceRules, CloudOptions, DriftOptions, PlaneOptions
from depthloom.plans import drift as drift_plan
from depthloom.sources import sinks

SCHEMA = "capture_id string, report string, surfaces string, centres array<double>, counts array<bigint>"


#: The rows that a process holds of a cloud; the rest lies in a file. PACKED: most points of a block. No result depends on them.
MOST, PACKED = 1_000_000, 256
BLOCKS = "capture_id string, layer bigint, i bigint, k bigint, place bigint, n bigint, points binary"
KEYS = ("layer", "i", "k")


def blocks(points: DataFrame, most: int, options: PlaneOptions) -> DataFrame:
    """(capture_id, layer, i, k, place, n, points): every point, packed by layers of height and strips of the plan.

    `points` holds x, y, z and how often the point occurs, as doubles; n counts
    all. Within a layer and strip the blocks follow by place, so that a cloud
    has one order, whatever the order of its table. The strips are as narrow
    as a cell of the coverage grid, so that a large surface is dealt widely.
    """
    wide = points.select("capture_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    cell = lambda c, size: F.floor(F.col(c) / g.lit(size)).cast("bigint")
    keyed = wide.withColumns({"layer": cell("y", 5 * options.hist_bin_m), "i": cell("x", options.cell_m), "k": cell("z", 1.0)})
    dealt = keyed.repartition("capture_id", *KEYS).sortWithinPartitions("capture_id", *KEYS, "y", "x", "z")
    rows = min(most, PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("capture_id").dictionary_encode()
            keys = np.stack([ids.indices.fill_null(-1).to_numpy(zero_copy_only=False), *[batch.column(k).to_numpy(zero_copy_only=False) for k in KEYS]])
            xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"])
            other = np.append(True, (np.diff(keys) != 0).any(axis=0))
            new = np.flatnonzero(other | np.append(True, (xyz[:, 1:] != xyz[:, :-1]).any(axis=0)))
            packed = np.vstack([xyz[:, new], np.diff(np.append(new, batch.num_rows))])
            of_key = np.flatnonzero(other[new])
            since = np.arange(len(new)) - np.repeat(of_key, np.diff(np.append(of_key, len(new))))
            first = np.flatnonzero(since % rows == 0)
            ends = np.append(first[1:], len(new))
            parts = [packed[:, a:b] for a, b in zip(first, ends)]
            head = batch.take(pa.array(new[first]))
            columns = [head.column(c) for c in ("capture_id", *KEYS)] + [pa.array(place + np.arange(len(first)), pa.int64()), pa.array([int(p[3].sum()) for p in parts], pa.int64()), pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())]
            place += len(first)
            yield pa.RecordBatch.from_arrays(columns, names=["capture_id", *KEYS, "place", "n", "points"])

    return dealt.mapInArrow(pack, BLOCKS)


def analysed(points: DataFrame, camera: dict[str, list[float]], options: PlaneOptions = PlaneOptions(), most: int | None = None) -> DataFrame:
    """One row per capture: its report as JSON, its surfaces' planes, its vertical profile.

    points: capture_id, x, y and z. Captures are analysed in parallel, each
    from every point by the same steps at any size; its process holds `most`
    rows of a cloud (MOST if not given) and reads the rest from a file.
    camera: heights of the camera path by capture.
    """
    most = MOST if most is None else most

    def row(name: str, cloud: planes.Cloud) -> pa.RecordBatch:
        a = planes.analyse(cloud, np.array(camera[name]), options)
        found = [("floor", a.floor)] * bool(a.floor) + [("ceiling", s) for s in a.levels]
        surfaces = [{"kind": k, "p": s.plane.p, "q": s.plane.q, "r": s.plane.r, "reach": s.plane.reach} for k, s in found]
        return pa.RecordBatch.from_pydict({"capture_id": [name], "report": [json.dumps(sinks.rounded(a.report))], "surfaces": [json.dumps(surfaces)], "centres": [a.centres.tolist()], "counts": [a.counts.tolist()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, cloud = None, None
        for batch in batches:
            for own, block in zip(batch.column("capture_id").to_pylist(), batch.column("points")):
                if cloud is None or own != name:
                    if cloud is not None:
                        yield row(name, cloud)
                    name, cloud = own, planes.Cloud(most)
                cloud.add(np.frombuffer(block.as_buffer()).reshape(4, -1).copy())
        if cloud is not None:
            yield row(name, cloud)

    packed = blocks(points, most, options).repartition("capture_id").sortWithinPartitions("capture_id", *KEYS, "place")
    return packed.select("capture_id", "points").mapInArrow(run, SCHEMA)


def on_plane(p: float, q: float, r: float, reach: float) -> Column:
    """Whether a point's perpendicular distance is within the plane's reach."""
    off = F.col("y").cast("double") - (g.lit(p) * F.col("x").cast("double") + g.lit(q) * F.col("z").cast("double") + g.lit(r))
    return F.abs(off / F.sqrt(g.lit(p * p + q * q + 1))) <= g.lit(reach)


def run(spark: SparkSession, path: str | Path, folder: str | Path, options: CloudOptions, plane_options: PlaneOptions = PlaneOptions(), drift: DriftOptions = DriftOptions(), rules: AcceptanceRules = AcceptanceRules()) -> dict:
    """The analysis with its files: inlier clouds, profile, side view, horizontal_planes.json. Returns the report."""
    began, out = time.perf_counter(), Path(folder)
    a = drift_plan.ablate(spark, path, out / "production.ply", options, drift, rules)
    points, name = a.production_cloud, a.capture.root.parent.name
    camera = [float(m[1, 3]) for m in a.production_poses]
    row = analysed(points.select(F.lit(name).alias("capture_id"), "x", "y", "z"), {name: camera}, plane_options).first()
    found, surfaces = json.loads(row["report"]), json.loads(row["surfaces"])
    out.mkdir(parents=True, exist_ok=True)
    for kind in ("floor", "ceiling"):
        own = [s for s in surfaces if s["kind"] == kind]
        parts = [points.filter(on_plane(s["p"], s["q"], s["r"], s["reach"])).withColumn("level", F.lit(k)) for k, s in enumerate(own)]
        if parts:
            union = parts[0]
            for p in parts[1:]:
                union = union.unionByName(p)
            sinks.write_ply(out / f"{kind}_inliers.ply", union, ["level", "ix", "iy", "iz"])
    bands = [(min(camera), max(camera), (255, 170, 60))]
    for s, f in zip(surfaces, [found["floor"]] * (surfaces[:1] != [] and surfaces[0]["kind"] == "floor") + found["ceiling_levels"]):
        bands.append((f["height_m"] - s["reach"], f["height_m"] + s["reach"], (30, 140, 60) if s["kind"] == "floor" else (30, 90, 200)))
    sinks.write_bars(out / "vertical_profile.png", np.array(row["centres"]), np.array(row["counts"]), bands)
    b = points.agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    box = (float(np.floor(b[0])), float(np.ceil(b[1])), float(np.floor(b[2])), float(np.ceil(b[3])))
    sinks.write_raster(out / "side_projection.png", profile.raster(points, "x", "y", box, 80, 40), int((box[1] - box[0]) * 80), int((box[3] - box[2]) * 80))
    report = {"capture": name, "pose_source": a.pose_source, "drift_fallback_reason": a.reason, "frames_used": len(a.capture.ids), "frames_available": a.base.frames_available, "runtime_s": round(time.perf_counter() - began, 2), **found}
    sinks.write_json(out / "horizontal_planes.json", report)
    return report
