"""Before-and-after metrics of a cloud and its frames, loop candidates, and the rules that judge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.operators import profile
from depthloom.operators.cloud import every_third
from depthloom.options import AcceptanceRules, DriftOptions

#: Metrics that decide, and whether more is better.
DIRECTIONS = {
    "overlap": True,
    "neighbour_residual_median_m": False,
    "floor_band_thickness_m": False,
    "floor_peak_share": True,
    "wall_slab_cells_per_1000_points": False,
}


def neighbour_overlap(points: DataFrame, voxel: float = 0.05) -> DataFrame:
    """(a, hits, n_a, n_b, score) for each pair of consecutive frames: shared cells of every third point over the smaller set.

    points: frame_id (consecutive), x, y, z, and ix, iy, iz that order them.
    """
    thin = every_third(points)
    cells = thin.select("frame_id", *[g.cell_index(F.col(c), voxel).alias(f"c{c}") for c in "xyz"]).distinct()
    sizes = cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = cells.alias("a"), cells.select(*[F.col(c).alias(f"{c}_b") for c in cells.columns]).alias("b")
    met = a.join(b, (F.col("frame_id") + 1 == F.col("frame_id_b")) & (F.col("cx") == F.col("cx_b")) & (F.col("cy") == F.col("cy_b")) & (F.col("cz") == F.col("cz_b")))
    hits = met.groupBy(F.col("frame_id").alias("f")).agg(F.count(F.lit(1)).alias("hits"))
    after = sizes.select(F.col("frame_id").alias("f_b"), F.col("n").alias("n_b"))
    pairs = sizes.join(after, F.col("frame_id") + 1 == F.col("f_b")).join(hits, F.col("frame_id") == F.col("f"), "left")
    hit = F.coalesce("hits", F.lit(0))
    return pairs.select(F.col("frame_id").alias("a"), hit.alias("hits"), F.col("n").alias("n_a"), "n_b", (hit / F.greatest(F.lit(1), F.least("n", "n_b"))).alias("score"))


def nearest(a: DataFrame, b: DataFrame, radius: float, keep: list[str]) -> DataFrame:
    """For each row of a (keep..., key, x, y, z) that has one, the distance to its nearest point of b with the same key, under the radius.

    Points meet by cells of the radius' size; b enters its 27 neighbours. Both
    sides are shuffled: a planner that knows only the size of files takes b's
    copies for small, and would have the driver broadcast them all.
    """
    cell = lambda c: F.floor(F.col(c) / g.lit(radius)).cast("bigint")
    around = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("ijk", o)]) for o in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]])
    left = a.select(*keep, "key", "x", "y", "z", *[cell(c).alias(f"a{c}") for c in "xyz"])
    right = b.select(F.col("key").alias("key_b"), *[F.col(c).alias(f"b_{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"], F.explode(around).alias("o"))
    right = right.select("key_b", "b_x", "b_y", "b_z", *[(F.col(f"c{c}") + F.col(f"o.{n}")).alias(f"c{c}") for c, n in zip("xyz", "ijk")])
    met = left.join(right.hint("merge"), (F.col("key") == F.col("key_b")) & (F.col("ax") == F.col("cx")) & (F.col("ay") == F.col("cy")) & (F.col("az") == F.col("cz")))
    d2 = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in "yz"), (F.col("x") - F.col("b_x")) * (F.col("x") - F.col("b_x")))
    return met.groupBy(*keep).agg(F.sqrt(F.min(d2)).alias("d")).filter(F.col("d") < radius)


def neighbour_residual(points: DataFrame, radius: float = 0.3, near: float = 0.05) -> DataFrame:
    """(a, n_a, near, median) of nearest distances from each frame to the next, under the radius; frames without a near point have none.

    points: frame_id (consecutive), pid (unique in its frame), x, y, z. A
    match under `near` in cells of that size is the nearest there is; only
    the points without one look in the wide cells.
    """
    a = points.select(F.col("frame_id").alias("a"), "pid", (F.col("frame_id") + 1).alias("key"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    b = points.select(F.col("frame_id").alias("key"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    first = nearest(a, b, near, ["a", "pid"])
    rest = a.join(first.select(F.col("a").alias("fa"), F.col("pid").alias("fp")).hint("merge"), (F.col("a") == F.col("fa")) & (F.col("pid") == F.col("fp")), "left_anti")
    found = first.unionByName(nearest(rest, b, radius, ["a", "pid"]))
    sizes = points.groupBy(F.col("frame_id").alias("f")).agg(F.count(F.lit(1)).alias("n_a"))
    medians = found.groupBy("a").agg(F.count(F.lit(1)).alias("near"), F.percentile("d", 0.5).alias("median"))
    return medians.join(sizes.hint("merge"), F.col("a") == F.col("f")).select("a", "n_a", "near", "median")


def floor_band(cloud: DataFrame, size: float = 0.02, band: float = 0.15, half: float = 0.03) -> DataFrame:
    """One row: the fullest bin's middle, P90 - P10 of heights near it, and the share of all points close to it."""
    low, step, _ = profile.grid(cloud, size)
    top = profile.vertical_histogram(cloud, size).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("b")).first()["b"]
    floor_y = low + top * step + size / 2
    off = F.abs(F.col("y").cast("double") - g.lit(floor_y))
    tails = F.percentile(F.when(off <= band, F.col("y").cast("double")), F.array(F.lit(0.1), F.lit(0.9)))
    return cloud.agg(tails.alias("p"), F.avg((off <= half).cast("double")).alias("share")).select(g.lit(floor_y).alias("floor_y_m"), (F.col("p")[1] - F.col("p")[0]).alias("floor_band_thickness_m"), F.col("share").alias("floor_peak_share"))


def wall_slab(cloud: DataFrame, floor_y: float, cell: float = 0.05) -> DataFrame:
    """One row: points between 0.4 and 1.6 m over the floor, their plan cells, and cells per thousand points."""
    slab = cloud.filter(F.col("y").between(F.lit(floor_y + 0.4).cast(cloud.schema["y"].dataType), F.lit(floor_y + 1.6).cast(cloud.schema["y"].dataType)))
    single = cloud.schema["x"].dataType.simpleString() == "float"
    cells = slab.groupBy(*[g.cell_index(F.col(c), cell, single).alias(f"c{c}") for c in "xz"]).agg(F.count(F.lit(1)).alias("n"))
    out = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wall_slab_points"), F.count(F.lit(1)).alias("wall_slab_cells"))
    return out.withColumn("wall_slab_cells_per_1000_points", F.when(F.col("wall_slab_points") > 0, 1000 * F.col("wall_slab_cells") / F.col("wall_slab_points")).otherwise(0.0))


def loop_candidates(poses: DataFrame, options: DriftOptions = DriftOptions()) -> DataFrame:
    """(i, j, dist): for each frame position its closest partner far enough on in the sequence, near in space and heading alike; the closest few.

    poses: pos (0, 1, ...), tx, ty, tz, r02, r12, r22. Pairs meet by cells of
    the distance limit, so positions far apart are never compared.
    """
    size = options.loop_max_odom_distance
    cell = lambda c: F.floor(F.col(c) / g.lit(size)).cast("bigint")
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("pos", "tx", "ty", "tz", "r02", "r12", "r22")]
    a = poses.select(*side("a"), *[cell(c).alias(f"ac_{c}") for c in ("tx", "ty", "tz")])
    around = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("ijk", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    b = poses.select(*side("b"), *[cell(c).alias(f"c_{c}") for c in ("tx", "ty", "tz")], F.explode(around).alias("o"))
    met = a.join(b, (F.col("ac_tx") == F.col("c_tx") + F.col("o.i")) & (F.col("ac_ty") == F.col("c_ty") + F.col("o.j")) & (F.col("ac_tz") == F.col("c_tz") + F.col("o.k")))
    diff = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in ("tx", "ty", "tz")]
    dist = F.round(F.sqrt(diff[0] * diff[0] + diff[1] * diff[1] + diff[2] * diff[2]), 9)  # equal to a nanometre is a tie
    ahead = F.col("a_r02") * F.col("b_r02") + F.col("a_r12") * F.col("b_r12") + F.col("a_r22") * F.col("b_r22")
    good = met.filter((F.col("b_pos") - F.col("a_pos") >= options.loop_min_separation) & (dist <= size) & (ahead >= g.heading_limit(options.loop_max_heading_deg)))
    best = good.groupBy(F.col("a_pos").alias("i")).agg(F.min(F.struct(dist.alias("dist"), F.col("b_pos").alias("j"))).alias("m"))
    return best.select("i", F.col("m.j").alias("j"), F.col("m.dist").alias("dist")).orderBy("dist", "i", "j").limit(options.loop_max_candidates)


def fixed(x: Column | str, digits: int) -> Column:
    """A number with so many decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def edge_verdict(fitness: Column, rmse: Column, shift: Column, angle: Column, options: DriftOptions, loop: bool) -> Column:
    """The first gate that an edge fails, or 'ok'."""
    p = "loop" if loop else "seq"
    limit = lambda name: getattr(options, f"{p}_{name}")
    return (
        F.when(fitness < limit("min_fitness"), F.concat(F.lit("fitness "), fixed(fitness, 2), F.lit(f" < {limit('min_fitness')}")))
        .when(rmse > limit("max_rmse"), F.concat(F.lit("inlier RMSE "), fixed(rmse, 4), F.lit(f" > {limit('max_rmse')}")))
        .when(shift > limit("max_translation"), F.concat(F.lit("correction "), fixed(shift, 3), F.lit(f" m > {limit('max_translation')}")))
        .when(angle > limit("max_rotation_deg"), F.concat(F.lit("correction "), fixed(angle, 1), F.lit(f" deg > {limit('max_rotation_deg')}")))
        .otherwise("ok")
    )


#: How rejection reasons are named in reports, by their first word.
REASONS = {"fitness": "low ICP fitness", "inlier": "high inlier RMSE", "correction": "correction larger than allowed", "too": "too few points"}


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row over edges (accepted, fitness, inlier_rmse, translation_correction_m, rotation_correction_deg)."""
    ok = F.col("accepted")
    mid = lambda c: F.percentile(F.when(ok, F.col(c)), 0.5)
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return edges.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        mean("fitness").alias("accepted_mean_fitness"),
        mid("fitness").alias("accepted_median_fitness"),
        mean("inlier_rmse").alias("accepted_mean_inlier_rmse_m"),
        mid("inlier_rmse").alias("accepted_median_inlier_rmse_m"),
        mid("translation_correction_m").alias("accepted_median_translation_correction_m"),
        mid("rotation_correction_deg").alias("accepted_median_rotation_correction_deg"),
    )


def rejection_reasons(edges: DataFrame) -> DataFrame:
    first = F.split("reason", " ")[0]
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), first), F.col("reason"))
    return edges.filter(~F.col("accepted")).groupBy(named.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def judged(metrics: DataFrame, rules: AcceptanceRules = AcceptanceRules()) -> DataFrame:
    """`verdict` ('accepted' or why not) for rows of before_ and after_ metrics with sequential_share and the greatest corrections."""
    change = {}
    for name, more in DIRECTIONS.items():
        b, a = F.col(f"before_{name}"), F.col(f"after_{name}")
        change[name] = F.when(b == 0, 0.0).otherwise((a - b) / b * (1 if more else -1))
    worse = F.concat_ws(", ", *[F.when(c < -rules.max_relative_degradation, F.lit(n)) for n, c in change.items()])
    better = F.greatest(*change.values())
    foot = lambda c: F.when(F.col(f"before_{c}") == 0, F.raise_error(F.lit(f"{c} is zero"))).otherwise(F.abs(F.col(f"after_{c}") - F.col(f"before_{c}")) / F.col(f"before_{c}"))
    verdict = (
        F.when(F.col("sequential_share") < rules.min_accepted_sequential_fraction, "sequential edges: too small a share accepted")
        .when(worse != "", F.concat(F.lit("worse: "), worse))
        .when(better < rules.min_relative_improvement, "no metric gains enough")
        .when(foot("footprint_x_m") > rules.max_footprint_change, f"footprint_x_m off by over {rules.max_footprint_change:.0%}")
        .when(foot("footprint_z_m") > rules.max_footprint_change, f"footprint_z_m off by over {rules.max_footprint_change:.0%}")
        .when(F.col("max_translation_m") > rules.max_translation_m, F.concat(F.lit("poses moved by up to "), fixed("max_translation_m", 2), F.lit(" m")))
        .when(F.col("max_rotation_deg") > rules.max_rotation_deg, F.concat(F.lit("poses turned by up to "), fixed("max_rotation_deg", 1), F.lit(" deg")))
        .when(F.col("max_tilt_change_deg") > rules.max_tilt_change_deg, F.concat(F.lit("poses leant by up to "), fixed("max_tilt_change_deg", 1), F.lit(" deg")))
        .otherwise("accepted")
    )
    return metrics.select("*", *[c.alias(f"change_{n}") for n, c in change.items()], verdict.alias("verdict"))


def greedy_levels(candidates: DataFrame, apart: float = 0.15) -> DataFrame:
    """One row with `levels`, heights kept in order of area: each farther than `apart` from all kept before.

    candidates: height, area; a handful of accepted planes.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), F.col("height").alias("h")))), lambda x: x["h"])
    keep = lambda kept, h: F.when(F.forall(kept, lambda k: F.abs(k - h) > apart), F.concat(kept, F.array(h))).otherwise(kept)
    return candidates.agg(F.aggregate(ordered, F.array().cast("array<double>"), keep).alias("levels"))


def consecutive(poses: DataFrame) -> DataFrame:
    """Each position with the next one's matrix, as a_ and b_ columns."""
    a = poses.select(*[F.col(c).alias(f"a_{c}") for c in poses.columns])
    b = poses.select(*[F.col(c).alias(f"b_{c}") for c in poses.columns])
    return a.join(b, F.col("a_pos") + 1 == F.col("b_pos"))
