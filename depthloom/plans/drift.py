"""Drift correction of a capture: registered pairs, corrected poses, clouds before and after, and the decision between them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.operators import cloud, metrics, profile
from depthloom.operators import registration as reg
from depthloom.options import AcceptanceRules, CaptureError, CloudOptions, DriftOptions
from depthloom.plans import reconstruct
from depthloom.sources import sinks

METHOD = (
    "odometry initial guess; point-to-plane ICP between consecutive sampled frames; conservative loop closures; pose-graph optimisation with odometry anchors; "
    "roll/pitch kept from the supplied poses; automatic fallback to the original poses when metrics do not support the correction"
)


def pose_matrices(spark: SparkSession, capture: reconstruct.Capture) -> list[np.ndarray]:
    """4x4 matrices of the selected frames in order: one small row each."""
    rows = {r["frame_id"]: r for r in g.with_matrices(capture.poses).collect()}
    out = []
    for i in capture.ids:
        m = np.eye(4)
        m[:3, :3] = np.array([rows[i][c] for c in g.ROTATION]).reshape(3, 3)
        m[:3, 3] = [rows[i][c] for c in ("tx", "ty", "tz")]
        out.append(m)
    return out


def scans(camera: DataFrame, options: DriftOptions) -> DataFrame:
    """Per frame: its registration cloud as bytes. A group is one image's pixels."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        scan = reg.Scan.of(group.sort_values(["v", "u"])[["cx_m", "cy_m", "cz_m"]].to_numpy(), options)
        return pd.DataFrame({"frame_id": [group["frame_id"].iloc[0]], "points": [scan.points.tobytes()], "normals": [scan.normals.tobytes()]})

    return camera.select("frame_id", "v", "u", "cx_m", "cy_m", "cz_m").groupBy("frame_id").applyInPandas(build, "frame_id int, points binary, normals binary")


def register(spark: SparkSession, clouds: DataFrame, ids: list[int], poses: list[np.ndarray], pairs: list[tuple[int, int, str]], options: DriftOptions) -> list[reg.Edge]:
    """All pairs (positions and kind) registered in the tasks; edges come back in the order of the pairs."""
    if not pairs:
        return []
    wanted = spark.createDataFrame([(k, ids[i], ids[j], kind, poses[i].tobytes(), poses[j].tobytes()) for k, (i, j, kind) in enumerate(pairs)], "k int, src int, tgt int, kind string, src_pose binary, tgt_pose binary")
    side = lambda p: clouds.select(F.col("frame_id").alias(f"{p}_id"), F.col("points").alias(f"{p}_points"), F.col("normals").alias(f"{p}_normals"))
    empty = F.lit(b"").cast("binary")
    met = wanted.join(side("a"), F.col("src") == F.col("a_id"), "left").join(side("b"), F.col("tgt") == F.col("b_id"), "left")
    met = met.select("k", "src", "tgt", "kind", "src_pose", "tgt_pose", *[F.coalesce(c, empty).alias(c) for c in ("a_points", "a_normals", "b_points", "b_normals")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = lambda b, *shape: np.frombuffer(b, np.float64).reshape(*shape)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                two = reg.Scan(array(r.a_points, -1, 3), array(r.a_normals, -1, 3)), reg.Scan(array(r.b_points, -1, 3), array(r.b_normals, -1, 3))
                e = reg.register((r.src, r.tgt), two, (array(r.src_pose, 4, 4), array(r.tgt_pose, 4, 4)), r.kind, options)
                out.append((r.k, e.source, e.target, e.kind, e.accepted, e.reason, e.fitness, e.inlier_rmse, e.translation_correction_m, e.rotation_correction_deg, e.initial.tobytes(), e.refined.tobytes(), e.weight.tobytes() if e.weight is not None else None))
            yield pd.DataFrame(out, columns=columns)

    columns = ["k", "source", "target", "kind", "accepted", "reason", "fitness", "inlier_rmse", "shift", "turn", "initial", "refined", "weight"]
    kinds = ["int", "int", "int", "string", "boolean", "string", "double", "double", "double", "double", "binary", "binary", "binary"]
    found = met.repartition(min(len(pairs), 4 * spark.sparkContext.defaultParallelism), "k").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in zip(columns, kinds)))
    whole = lambda b, n: np.frombuffer(bytes(b), np.float64).reshape(n, n).copy()
    return [reg.Edge(r["source"], r["target"], r["kind"], r["accepted"], r["reason"], r["fitness"], r["inlier_rmse"], r["shift"], r["turn"], whole(r["initial"], 4), whole(r["refined"], 4), whole(r["weight"], 6) if r["weight"] else None) for r in sorted(found.collect(), key=lambda r: r["k"])]


def matrix_frame(spark: SparkSession, ids: list[int], poses: list[np.ndarray]) -> DataFrame:
    rows = [(k, i, *map(float, m[:3, :3].ravel()), *map(float, m[:3, 3])) for k, (i, m) in enumerate(zip(ids, poses))]
    return spark.createDataFrame(rows, "pos bigint, frame_id int, " + ", ".join(f"{c} double" for c in g.MATRIX))


def loop_pairs(spark: SparkSession, ids: list[int], poses: list[np.ndarray], options: DriftOptions) -> list[tuple[int, int]]:
    found = metrics.loop_candidates(matrix_frame(spark, ids, poses), options).collect()
    return [(r["i"], r["j"]) for r in sorted(found, key=lambda r: (r["dist"], r["i"], r["j"]))]


def estimate(spark: SparkSession, clouds: DataFrame, ids: list[int], poses: list[np.ndarray], options: DriftOptions) -> reg.Correction:
    """Corrected poses from the frames' registration clouds."""
    loops = loop_pairs(spark, ids, poses, options) if options.enable_loop_closure else []
    pairs = [(k, k + 1, "sequential") for k in range(len(ids) - 1)] + [(i, j, "loop") for i, j in loops]
    return reg.correct(ids, poses, register(spark, clouds, ids, poses, pairs, options), len(loops), options)


def posed(camera: DataFrame, matrices: DataFrame) -> DataFrame:
    """Camera-space points under other matrices."""
    return camera.drop(*g.MATRIX).join(matrices.withColumnRenamed("frame_id", "_f").drop("pos"), F.col("frame_id") == F.col("_f")).drop("_f")


def measure(metric_points: DataFrame, matrices: DataFrame, points: DataFrame) -> dict:
    """All metrics of one set of poses: metric_points (frame_id, ix.., x.. in camera space, single precision), and the world cloud."""
    moved = posed(metric_points, matrices.withColumnRenamed("pos", "_pos")).select(F.col("_pos").cast("int").alias("frame_id"), "ix", "iy", "iz", *[c.alias(n) for n, c in zip("xyz", g.moved(*(F.col(c).cast("double") for c in "xyz")))])
    score = metrics.neighbour_overlap(moved).agg(F.avg("score")).first()[0]
    rest = metrics.neighbour_residual(moved.withColumn("pid", F.struct("ix", "iy", "iz"))).agg(F.avg("median").alias("m"), F.avg(F.col("near") / F.col("n_a")).alias("f")).first()
    floor = metrics.floor_band(points).first().asDict()
    wall = metrics.wall_slab(points, floor["floor_y_m"]).first().asDict()
    b = reconstruct.box(points)
    return {"overlap": score or 0.0, "neighbour_residual_median_m": rest["m"] or 0.0, "neighbour_inlier_fraction": rest["f"] or 0.0, **floor, **wall, "footprint_x_m": float(b[1, 0] - b[0, 0]), "footprint_z_m": float(b[1, 2] - b[0, 2]), "points": points.count()}


def judge(spark: SparkSession, before: dict, after: dict, correction: reg.Correction, rules: AcceptanceRules) -> tuple[bool, str | None, dict]:
    """Whether to use the corrected poses, why not, and the relative changes (positive: better)."""
    names = [*metrics.DIRECTIONS, "footprint_x_m", "footprint_z_m"]
    sequential = [e.accepted for e in correction.edges if e.kind == "sequential"]
    row = {f"{p}_{n}": float(d[n]) for p, d in (("before", before), ("after", after)) for n in names}
    row |= {"sequential_share": sum(sequential) / len(sequential) if sequential else 1.0} | {k: v for k, v in correction.summary().items() if k.startswith("max")}
    out = metrics.judged(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row)), rules).first()
    good = out["verdict"] == "accepted"
    return good, None if good else out["verdict"], {n: out[f"change_{n}"] for n in metrics.DIRECTIONS}


@dataclass
class Ablation:
    capture: reconstruct.Capture
    base: reconstruct.Result
    correction: reg.Correction
    clouds: tuple[DataFrame, DataFrame]
    before: dict
    after: dict
    accepted: bool
    reason: str | None
    changes: dict

    @property
    def production_cloud(self) -> DataFrame:
        return self.clouds[self.accepted]

    @property
    def production_poses(self) -> list[np.ndarray]:
        return self.correction.corrected if self.accepted else self.correction.original

    @property
    def pose_source(self) -> str:
        return "corrected" if self.accepted else "original"


def ablate(spark: SparkSession, path: str | Path, output: Path, options: CloudOptions, drift: DriftOptions, rules: AcceptanceRules) -> Ablation:
    """The same frames with the supplied and with the corrected poses. Filtered camera-space points are decoded once and kept for all branches."""
    capture, base = reconstruct.prepare(spark, path, output, options)
    if len(capture.ids) < 3:
        raise CaptureError("drift needs at least 3 frames; a smaller --frame-step gives more")
    pixels = capture.pixels(spark).cache()
    original = pose_matrices(spark, capture)
    camera = capture.camera(pixels).cache()
    before = reconstruct.checked_cloud(spark, capture, base, pixels)
    single = camera.select("frame_id", "v", "u", *[F.col(f"c{c}_m").cast("float").alias(c) for c in "xyz"])
    metric_points = cloud.first_per_voxel(single, drift.metric_voxel, keep=("frame_id",)).cache()
    correction = estimate(spark, scans(camera, drift).cache(), capture.ids, original, drift)
    old, new = matrix_frame(spark, capture.ids, original), matrix_frame(spark, capture.ids, correction.corrected)
    after = reconstruct.world_cloud(capture, posed(camera, new)).cache()
    measured = [measure(metric_points, m, c) for m, c in ((old, before), (new, after))]
    verdict = judge(spark, *measured, correction, rules)
    for kept in (pixels, camera, metric_points):
        kept.unpersist()
    return Ablation(capture, base, correction, (before, after), *measured, *verdict)


def edge_facts(spark: SparkSession, edges: list[reg.Edge]) -> dict:
    rows = [(e.accepted, e.reason, e.fitness, e.inlier_rmse, e.translation_correction_m, e.rotation_correction_deg) for e in edges]
    df = spark.createDataFrame(rows, "accepted boolean, reason string, fitness double, inlier_rmse double, translation_correction_m double, rotation_correction_deg double")
    stats = metrics.edge_stats(df).first().asDict()
    reasons = {r["category"]: r["n"] for r in metrics.rejection_reasons(df).orderBy("category").collect()}
    return {k: v for k, v in stats.items() if v is not None} | {"rejection_reasons": reasons}


def topdown(cloud_: DataFrame, bounds: tuple[float, float, float, float], poses: list[np.ndarray], path: Path) -> None:
    x0, x1, z0, z1 = bounds
    width, height = int((x1 - x0) * 100), int((z1 - z0) * 100)
    line = np.array([[(m[0, 3] - x0) * 100, height - 1 - (m[2, 3] - z0) * 100] for m in poses])
    sinks.write_raster(path, profile.raster(cloud_, "x", "z", bounds, 100, 20), width, height, line=line)


def run(spark: SparkSession, path: str | Path, folder: str | Path, options: CloudOptions, drift: DriftOptions = DriftOptions(), rules: AcceptanceRules = AcceptanceRules()) -> dict:
    """The ablation with its files: clouds, trajectories, views, drift_report.json. Returns the report."""
    began, out = time.perf_counter(), Path(folder)
    a = ablate(spark, path, out / "before.ply", options, drift, rules)
    poses = {"before": a.correction.original, "after": a.correction.corrected}
    bounds = tuple(profile.shared_bounds(list(a.clouds)).first())
    for name, points in zip(poses, a.clouds):
        sinks.write_ply(out / f"{name}.ply", points, ["ix", "iy", "iz"])
        sinks.write_trajectory(out / f"trajectory_{name}.csv", a.capture.ids, poses[name])
        topdown(points, bounds, poses[name], out / f"{name}_topdown.png")
    loops = [e for e in a.correction.edges if e.kind == "loop"]
    facts, moved, off = edge_facts(spark, loops), a.correction.summary(), "mean_translation_m_and_rotation_deg"
    listed = ("source", "target", "kind", "accepted", "reason", "fitness", "inlier_rmse", "translation_correction_m", "rotation_correction_deg")
    report = {
        "capture": a.capture.root.parent.name,
        "capture_path": str(a.capture.root),
        "frames_available": a.base.frames_available,
        "frames_used": len(a.capture.ids),
        "method": METHOD,
        "parameters": {"frame_step": options.frame_step, "max_frames": options.max_frames, "min_confidence": options.min_confidence, "output_voxel_m": options.voxel_size, "drift_options": asdict(drift), "acceptance_rules": asdict(rules)},
        "sequential_edges": edge_facts(spark, [e for e in a.correction.edges if e.kind == "sequential"]),
        "loop_closures": {"candidates": a.correction.loop_candidates, **{k: facts[k] for k in ("accepted", "rejected", "rejection_reasons")}, "edges": [{k: getattr(e, k) for k in listed} for e in loops]},
        "constraint_residual_before_after": {kind: {f"before_{off}": b, f"after_{off}": c} for kind, (b, c) in a.correction.residuals().items()},
        "before": a.before,
        "after": a.after,
        "relative_improvement": a.changes,
        "pose_correction": {k: v for k, v in moved.items() if "tilt" not in k} | {"max_roll_pitch_change_deg_before_gravity_constraint": a.correction.raw_tilt_deg, "max_roll_pitch_change_deg": moved["max_tilt_change_deg"]},
        "accepted": a.accepted,
        "fallback_reason": a.reason,
        "production_poses": a.pose_source,
        "runtime_s": time.perf_counter() - began,
    }
    report = sinks.rounded(report)
    sinks.write_json(out / "drift_report.json", report)
    return report
