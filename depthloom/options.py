"""Options of each command. Their defaults are part of the results."""

from __future__ import annotations

from dataclasses import dataclass

DEPTH_SCALE = 0.001  # metres per raw unit, an assumption
POSE_CONVENTION = "camera-to-world, camera axes +X right, +Y down, +Z forward; world +Y up"


@dataclass(frozen=True)
class CloudOptions:
    frame_step: int = 30
    max_frames: int | None = 60
    min_confidence: int = 2
    voxel_size: float = 0.02
    min_range_m: float = 0.1
    max_range_m: float = 5.0
    source_size: tuple[int, int] | None = None


@dataclass(frozen=True)
class DriftOptions:
    reg_voxel: float = 0.05
    normal_radius: float = 0.15
    normal_max_nn: int = 30
    min_points: int = 300
    seq_max_corr: float = 0.10
    seq_min_fitness: float = 0.50
    seq_max_rmse: float = 0.05
    seq_max_translation: float = 0.15
    seq_max_rotation_deg: float = 5.0
    loop_min_separation: int = 15
    loop_max_odom_distance: float = 1.5
    loop_max_heading_deg: float = 60.0
    loop_max_candidates: int = 20
    loop_coarse_corr: float = 0.25
    loop_max_corr: float = 0.10
    loop_min_fitness: float = 0.60
    loop_max_rmse: float = 0.04
    loop_max_translation: float = 0.40
    loop_max_rotation_deg: float = 8.0
    enable_loop_closure: bool = True
    odometry_edge_weight: float = 1.0
    icp_edge_weight: float = 0.02
    loop_edge_weight: float = 1.0
    constrain_gravity: bool = True
    metric_voxel: float = 0.03


@dataclass(frozen=True)
class AcceptanceRules:
    min_accepted_sequential_fraction: float = 0.5
    min_relative_improvement: float = 0.02
    max_relative_degradation: float = 0.03
    max_footprint_change: float = 0.05
    max_translation_m: float = 0.5
    max_rotation_deg: float = 5.0
    max_tilt_change_deg: float = 1.0


@dataclass(frozen=True)
class PlaneOptions:
    min_ceiling_height_m: float = 2.0
    max_ceiling_height_m: float = 4.5
    max_tilt_deg: float = 5.0
    hist_bin_m: float = 0.02
    peak_min_share: float = 0.0005
    peak_window_m: float = 0.20
    band_halfwidth_m: float = 0.15
    inlier_min_m: float = 0.03
    inlier_max_m: float = 0.08
    min_floor_clearance_m: float = 0.5
    min_ceiling_clearance_m: float = 0.3
    floor_relative_area: float = 0.5
    cell_m: float = 0.10
    cell_min_points: int = 3
    min_floor_area_m2: float = 2.0
    min_ceiling_area_m2: float = 3.0
    min_ceiling_area_ratio: float = 0.10
    max_ceiling_sigma_m: float = 0.06
    correlation_cell_m: float = 1.0
    subset_block_m: float = 1.0
    subset_count: int = 4
    min_interval_halfwidth_m: float = 0.01


class CaptureError(Exception):
    """A problem that the user can act on: a bad capture, missing data, an output that can't be written."""
