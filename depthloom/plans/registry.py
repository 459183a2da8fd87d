"""All queries of the capture operators over the fixture views, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.operators import cloud, frames, metrics, profile
from depthloom.options import AcceptanceRules, CloudOptions, DriftOptions, PlaneOptions
from depthloom.plans.fixtures import DEPTH, SOURCE, oracle, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
OPTIONS = CloudOptions()


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql, *views)
        return f

    return add


ROTATED = """rot AS (SELECT *, qx/n AS a, qy/n AS b, qz/n AS c, qw/n AS w FROM (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS n FROM fx_poses) p),
mat AS (SELECT frame_id, fx, fy, cx, cy, x AS tx, y AS ty, z AS tz,
 1-2.0D*(b*b+c*c) AS r00, 2.0D*(a*b-c*w) AS r01, 2.0D*(a*c+b*w) AS r02,
 2.0D*(a*b+c*w) AS r10, 1-2.0D*(a*a+c*c) AS r11, 2.0D*(b*c-a*w) AS r12,
 2.0D*(a*c-b*w) AS r20, 2.0D*(b*c+a*w) AS r21, 1-2.0D*(a*a+b*b) AS r22 FROM rot)"""
WORLD = (
    ROTATED
    + """,
cam AS (SELECT p.frame_id, v, u, m.*, (u-cx*(256.0D/1920))*(raw*0.001D)/(fx*(256.0D/1920)) AS px, (v-cy*(192.0D/1440))*(raw*0.001D)/(fy*(192.0D/1440)) AS py, raw*0.001D AS pz
 FROM fx_pixels p JOIN (SELECT frame_id AS f, * EXCLUDE (frame_id) FROM mat) m ON p.frame_id = m.f WHERE raw BETWEEN 100 AND 5000 AND conf >= 2),
world AS (SELECT frame_id, v, u, CAST(r00*px+r01*py+r02*pz+tx AS FLOAT) AS x, CAST(r10*px+r11*py+r12*pz+ty AS FLOAT) AS y, CAST(r20*px+r21*py+r22*pz+tz AS FLOAT) AS z FROM cam)"""
)
VOXEL = "CAST(floor(CAST(CAST({c} AS DOUBLE)/0.019999999552965164D AS FLOAT)) AS BIGINT)"
FIRST = (
    WORLD
    + f""",
cells AS (SELECT *, {', '.join(f'{VOXEL.format(c=c)} AS i{c}' for c in 'xyz')} FROM world),
first AS (SELECT ix, iy, iz, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY frame_id, v, u) AS rn FROM cells) c WHERE rn = 1)"""
)


def _poses(spark, d) -> DataFrame:
    return view(spark, d, "fx_poses")


def _matrices(spark, d) -> DataFrame:
    """Poses with matrices, and their position in the sequence."""
    return g.with_matrices(_poses(spark, d)).withColumn("pos", F.col("frame_id").cast("bigint")).select("pos", *g.MATRIX)


def _camera(spark, d) -> DataFrame:
    return cloud.camera_points(view(spark, d, "fx_pixels"), _poses(spark, d), OPTIONS, SOURCE, DEPTH)


def _cloud(spark, d) -> DataFrame:
    return cloud.first_per_voxel(cloud.world_points(_camera(spark, d)), OPTIONS.voxel_size)


def _room(spark, d) -> DataFrame:
    return view(spark, d, "fx_room_points")


def _odometry(spark, d) -> DataFrame:
    return frames.parsed_odometry(view(spark, d, "fx_odometry_raw"), "frame_txt", ["ts_txt", "x_txt"], "fx_txt")


def _ids(spark, d, name, any_case=True) -> DataFrame:
    return frames.listed(view(spark, d, name), any_case).filter("frame_id IS NOT NULL")


@query(FIRST + "\nSELECT ix, iy, iz, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM first", "fx_poses", "fx_pixels")
def world_cloud(spark: SparkSession, d: str) -> DataFrame:
    """Filter, project, move, first point per voxel."""
    return _cloud(spark, d).select("ix", "iy", "iz", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@query("SELECT CAST(count(*) AS BIGINT) AS candidates, CAST(sum(CASE WHEN raw BETWEEN 100 AND 5000 THEN 0 ELSE 1 END) AS BIGINT) AS removed_by_depth, CAST(sum(CASE WHEN raw BETWEEN 100 AND 5000 AND conf < 2 THEN 1 ELSE 0 END) AS BIGINT) AS removed_by_confidence FROM fx_pixels", "fx_pixels")
def filter_counters(spark, d):
    """F6-F8 A8."""
    return cloud.filter_counters(view(spark, d, "fx_pixels"), OPTIONS)


@query(FIRST + "\nSELECT " + ", ".join(f"CAST({f}({c}) AS DOUBLE) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM first", "fx_poses", "fx_pixels")
def cloud_bounds(spark, d):
    """A9 over the cloud."""
    return cloud.bounds(_cloud(spark, d).select(*[F.col(c).cast("double").alias(c) for c in "xyz"]))


@query("SELECT " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM fx_poses", "fx_poses")
def trajectory_bounds(spark, d):
    """A9 over the camera path."""
    return cloud.bounds(_poses(spark, d))


PARSED = r"""parsed AS (SELECT *, NOT (regexp_full_match(frame_txt, '\s*[+-]?\d+\s*') AND regexp_full_match(ts_txt, '\s*\d+\s*') AND regexp_full_match(x_txt, '\s*\d+\s*') AND (trim(fx_txt) = '' OR regexp_full_match(fx_txt, '\s*\d+\s*'))) AS malformed FROM fx_odometry_raw),
good AS (SELECT *, CAST(frame_txt AS INT) AS frame_id FROM parsed WHERE NOT malformed)"""


@query(PARSED + "\nSELECT line_no, frame_txt, x_txt FROM parsed WHERE malformed", "fx_odometry_raw")
def odometry_malformed(spark, d):
    """S3 F1 F2 A1."""
    return _odometry(spark, d).filter("malformed").select("line_no", "frame_txt", "x_txt")


@query(PARSED + "\nSELECT frame_id, CAST(count(*) AS BIGINT) AS n FROM good GROUP BY frame_id HAVING count(*) > 1", "fx_odometry_raw")
def odometry_duplicates(spark, d):
    """A2."""
    return frames.duplicates(_odometry(spark, d))


@query(PARSED + """
SELECT CAST((SELECT count(*) FROM parsed WHERE malformed) AS BIGINT) AS malformed,
 array_to_string((SELECT list(line_no ORDER BY line_no) FROM (SELECT line_no FROM parsed WHERE malformed ORDER BY line_no LIMIT 20) q), ',') AS first_lines,
 CAST(count(*) AS BIGINT) AS pose_count, min(CAST(NULLIF(fx_txt, '') AS DOUBLE)) AS fx_min, max(CAST(NULLIF(fx_txt, '') AS DOUBLE)) AS fx_max FROM good""", "fx_odometry_raw")
def odometry_summary(spark, d):
    """A1 A3 F4 T-6."""
    return frames.odometry_summary(_odometry(spark, d)).withColumn("first_lines", F.array_join(F.col("first_lines").cast("array<string>"), ","))


@query(PARSED + "\nSELECT frame_id, x_txt, line_no FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY line_no DESC) AS rn FROM good) q WHERE rn = 1", "fx_odometry_raw")
def last_pose_rows(spark, d):
    """The last row of a frame wins."""
    return frames.last_poses(_odometry(spark, d), ["x_txt", "line_no"])


LISTED = r"""dep AS (SELECT DISTINCT CAST(regexp_extract(file_name, '^([0-9]+)\.(png|PNG)$', 1) AS INT) AS id FROM fx_depth_files WHERE regexp_matches(file_name, '^[0-9]+\.(png|PNG)$'))"""


@query(r"SELECT file_name, CASE WHEN regexp_matches(file_name, '^[0-9]+\.(png|PNG)$') THEN CAST(regexp_extract(file_name, '^([0-9]+)\.', 1) AS INT) END AS frame_id FROM fx_depth_files", "fx_depth_files")
def frame_listing(spark, d):
    """Names in any case, non-numeric ones without an id."""
    return frames.listed(view(spark, d, "fx_depth_files"))


@query(r"SELECT file_name, CASE WHEN regexp_matches(file_name, '^[0-9]+\.png$') THEN CAST(regexp_extract(file_name, '^([0-9]+)\.', 1) AS INT) END AS frame_id FROM fx_depth_files WHERE file_name LIKE '%.png'", "fx_depth_files")
def frame_listing_exact_case(spark, d):
    """S13."""
    return frames.listed(view(spark, d, "fx_depth_files"), any_case=False)


def _aligned(a: str, b: str) -> str:
    return f"\nSELECT coalesce(a.id, b.id) AS frame_id, CASE WHEN b.id IS NULL THEN 'a' ELSE 'b' END AS side FROM {a} a FULL JOIN {b} b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL"


@query(LISTED + ",\n" + PARSED + ", pose AS (SELECT DISTINCT frame_id AS id FROM good)" + _aligned("dep", "pose"), "fx_depth_files", "fx_odometry_raw")
def depth_pose_alignment(spark, d):
    """J2 U1."""
    return frames.alignment(_ids(spark, d, "fx_depth_files"), _odometry(spark, d).filter("NOT malformed"))


@query(LISTED + r", conf AS (SELECT DISTINCT CAST(regexp_extract(file_name, '^([0-9]+)\.png$', 1) AS INT) AS id FROM fx_conf_files)" + _aligned("dep", "conf"), "fx_depth_files", "fx_conf_files")
def depth_confidence_alignment(spark, d):
    """J1 U1."""
    return frames.alignment(_ids(spark, d, "fx_depth_files"), _ids(spark, d, "fx_conf_files"))


@query(LISTED + "\nSELECT id, next_id, next_id - id - 1 AS missing FROM (SELECT id, lead(id) OVER (ORDER BY id) AS next_id FROM dep) q WHERE next_id > id + 1", "fx_depth_files")
def depth_gaps(spark, d):
    """A6."""
    return frames.gaps(_ids(spark, d, "fx_depth_files"))


@query(LISTED + """, step AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn FROM dep),
thin AS (SELECT id, rn // 30 AS rank, count(*) OVER () AS n FROM step WHERE rn % 30 = 0),
picks AS (SELECT DISTINCT CAST(round_even(i*(CAST(n AS DOUBLE)-1)/59.0D, 0) AS BIGINT) AS pick FROM (SELECT max(n) AS n FROM thin) q, range(60) r(i))
SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM thin WHERE n <= 60 OR rank IN (SELECT pick FROM picks)""", "fx_depth_files")
def select_frames(spark, d):
    """Every 30th, at most 60, evenly spaced, ties to even."""
    return frames.select_frames(_ids(spark, d, "fx_depth_files").select("frame_id").distinct(), OPTIONS.frame_step, OPTIONS.max_frames)


EIGHT = """eight AS (SELECT frame_id FROM (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS rn, count(*) OVER () AS n FROM fx_poses) q
 WHERE n <= 8 OR rn IN (SELECT CAST(round_even(i*((SELECT count(*) FROM fx_poses)-1)/7.0D, 0) AS BIGINT) FROM range(8) r(i)))"""


def _sampled(spark, d) -> DataFrame:
    ranked = frames.numbered(_poses(spark, d))
    return frames.evenly_spaced(ranked, frames.SAMPLED, ranked.count()).select(F.col("id").alias("picked"))


@query(EIGHT + "\nSELECT min(raw) AS min_raw, max(raw) AS max_raw, median(raw) AS median_raw, CAST(count(*) AS BIGINT) AS n FROM fx_pixels WHERE raw > 0 AND frame_id IN (SELECT frame_id FROM eight)", "fx_poses", "fx_pixels")
def depth_stats_sampled(spark, d):
    """Exact median over eight sampled frames."""
    pixels = view(spark, d, "fx_pixels").filter("raw > 0").join(_sampled(spark, d), F.col("frame_id") == F.col("picked"), "left_semi")
    return pixels.agg(F.min("raw").alias("min_raw"), F.max("raw").alias("max_raw"), F.percentile("raw", 0.5).alias("median_raw"), F.count(F.lit(1)).alias("n"))


@query(EIGHT + "\nSELECT conf, CAST(count(*) AS BIGINT) AS n FROM fx_pixels WHERE frame_id IN (SELECT frame_id FROM eight) GROUP BY conf", "fx_poses", "fx_pixels")
def confidence_histogram(spark, d):
    """W5 A5."""
    pixels = view(spark, d, "fx_pixels").join(_sampled(spark, d), F.col("frame_id") == F.col("picked"), "left_semi")
    return pixels.groupBy("conf").agg(F.count(F.lit(1)).alias("n"))


def _rounded(df: DataFrame, *keep: str, digits: int = 9) -> DataFrame:
    return df.select(*keep, *[(F.round(c, digits) + 0.0).alias(c) for c in df.columns if c not in keep])


@query(ROTATED + "\nSELECT frame_id, " + ", ".join(f"round({c}, 9) + 0.0D AS {c}" for c in g.MATRIX) + " FROM mat", "fx_poses")
def pose_matrix(spark, d):
    """M2 M3 M6."""
    return _rounded(g.with_matrices(_poses(spark, d)).select("frame_id", *g.MATRIX), "frame_id")


PAIRS = ROTATED + ", nx AS (SELECT a.frame_id, " + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in g.MATRIX) + " FROM mat a JOIN mat b ON a.frame_id + 1 = b.frame_id)"
DELTA = ", ".join([f"(b_tx-a_tx) AS d{0}", f"(b_ty-a_ty) AS d{1}", f"(b_tz-a_tz) AS d{2}"])


@query(
    PAIRS + "\nSELECT CAST(frame_id AS BIGINT) AS a_pos, "
    + ", ".join(f"round(b_r0{i}*a_r0{j} + b_r1{i}*a_r1{j} + b_r2{i}*a_r2{j}, 9) + 0.0D AS r{i}{j}" for i in range(3) for j in range(3)) + ", "
    + ", ".join(f"round(b_r0{i}*(a_tx-b_tx) + b_r1{i}*(a_ty-b_ty) + b_r2{i}*(a_tz-b_tz), 9) + 0.0D AS {t}" for i, t in enumerate(("tx", "ty", "tz"))) + " FROM nx",
    "fx_poses",
)
def relative_transform(spark, d):
    """J6 W8 M7."""
    pairs = metrics.consecutive(_matrices(spark, d))
    return _rounded(pairs.select("a_pos", *[c.alias(k) for k, c in g.relative("a_", "b_").items()]), "a_pos")


_MOTION = [[f"(b_r{i}0*a_r{j}0 + b_r{i}1*a_r{j}1 + b_r{i}2*a_r{j}2)" for j in range(3)] for i in range(3)]


@query(
    PAIRS + "\nSELECT CAST(frame_id AS BIGINT) AS a_pos, " + ", ".join(f"round({_MOTION[i][j]}, 9) + 0.0D AS r{i}{j}" for i in range(3) for j in range(3)) + ", "
    + ", ".join(f"round(b_t{t} - ({_MOTION[i][0]}*a_tx + {_MOTION[i][1]}*a_ty + {_MOTION[i][2]}*a_tz), 9) + 0.0D AS t{t}" for i, t in enumerate("xyz")) + " FROM nx",
    "fx_poses",
)
def correction_motion(spark, d):
    """M8: the motion of the world that takes a pose to the next."""
    pairs = metrics.consecutive(_matrices(spark, d))
    return _rounded(pairs.select("a_pos", *[c.alias(k) for k, c in g.correction("a_", "b_").items()]), "a_pos")


@query(PAIRS + "\nSELECT CAST(frame_id AS BIGINT) AS a_pos, " + ", ".join(f"round(b_{c}, 6) + 0.0D AS {c}" for c in g.MATRIX) + " FROM nx", "fx_poses")
def corrected_poses(spark, d):
    """M9: a pose after the motion to the next one is that next one."""
    pairs = metrics.consecutive(_matrices(spark, d))
    moved = pairs.select("a_pos", *[f"a_{c}" for c in g.MATRIX], *[c.alias(f"m_{k}") for k, c in g.correction("a_", "b_").items()])
    return _rounded(moved.select("a_pos", *[c.alias(k) for k, c in g.corrected("a_", "m_").items()]), "a_pos", digits=6)


@query(
    """pl AS (SELECT event_id, (event_id%17)/100.0D AS p, (event_id%23)/100.0D AS q, (event_id%7)/10.0D AS r FROM events)
SELECT event_id, round(degrees(acos(1/sqrt(p*p+q*q+1))), 9) + 0.0D AS tilt_deg, round(-p/sqrt(p*p+q*q+1), 9) + 0.0D AS a, round(1/sqrt(p*p+q*q+1), 9) + 0.0D AS b, round(-q/sqrt(p*p+q*q+1), 9) + 0.0D AS c, round(-r/sqrt(p*p+q*q+1), 9) + 0.0D AS d,
 round(CASE WHEN abs(q/(4.685D*0.03D)) >= 1 THEN 0 ELSE (1-(q/(4.685D*0.03D))*(q/(4.685D*0.03D)))*(1-(q/(4.685D*0.03D))*(q/(4.685D*0.03D))) END, 9) + 0.0D AS weight FROM pl""",
    "fx_conf_files",
)
def plane_algebra(spark, d):
    """Tilt and equation of planes, and the weights of residuals."""
    pl = spark.read.parquet(f"{d}/events.parquet").select("event_id", *[((F.col("event_id") % m) / k).alias(n) for n, m, k in (("p", 17, 100.0), ("q", 23, 100.0), ("r", 7, 10.0))])
    tilt, plane = g.plane_tilt_deg(F.col("p"), F.col("q")), g.plane_equation(F.col("p"), F.col("q"), F.col("r"))
    return _rounded(pl.select("event_id", tilt.alias("tilt_deg"), *[c.alias(n) for n, c in zip("abcd", plane)], g.tukey_weight(F.col("q"), g.lit(0.03)).alias("weight")), "event_id")


@query("SELECT CAST(count(*) AS BIGINT) AS candidates, CAST(sum(CASE WHEN raw BETWEEN 100 AND 5000 THEN 0 ELSE 1 END) AS BIGINT) AS removed_by_depth, CAST(0 AS BIGINT) AS removed_by_confidence FROM fx_pixels", "fx_pixels")
def filter_counters_without_confidence(spark, d):
    """F8: a least confidence of 0 removes nothing."""
    from dataclasses import replace

    return cloud.filter_counters(view(spark, d, "fx_pixels"), replace(OPTIONS, min_confidence=0))


@query(
    PAIRS + """, q AS (SELECT frame_id, b_r00*a_r00+b_r01*a_r01+b_r02*a_r02 + b_r10*a_r10+b_r11*a_r11+b_r12*a_r12 + b_r20*a_r20+b_r21*a_r21+b_r22*a_r22 AS tr,
 a_r10*b_r10+a_r11*b_r11+a_r12*b_r12 AS up, sqrt((b_tx-a_tx)*(b_tx-a_tx)+(b_ty-a_ty)*(b_ty-a_ty)+(b_tz-a_tz)*(b_tz-a_tz)) AS len FROM nx)
SELECT CAST(frame_id AS BIGINT) AS a_pos, round(len, 6) + 0.0D AS shift_m, round(degrees(acos(greatest(-1, least(1, (tr-1)/2)))), 5) + 0.0D AS angle_deg, round(degrees(acos(greatest(-1, least(1, up)))), 5) + 0.0D AS tilt_deg FROM q""",
    "fx_poses",
)
def pose_changes(spark, d):
    """Motion from each pose to the next."""
    pairs = metrics.consecutive(_matrices(spark, d))
    moved = pairs.select("*", *[c.alias(f"d_{k}") for k, c in g.relative("a_", "b_").items()])
    return moved.select("a_pos", (F.round(g.shift_m("d_"), 6) + 0.0).alias("shift_m"), (F.round(g.angle_deg("d_"), 5) + 0.0).alias("angle_deg"), (F.round(g.tilt_change_deg("a_", "b_"), 5) + 0.0).alias("tilt_deg"))


@query(
    PAIRS + ", dl AS (SELECT *, " + ", ".join(f"b_r{i}0*a_r{j}0+b_r{i}1*a_r{j}1+b_r{i}2*a_r{j}2 AS e{i}{j}" for i, j in ((0, 0), (0, 2), (2, 0), (2, 2))) + " FROM nx), "
    "yaw AS (SELECT *, cos(atan2(e02-e20, e00+e22)) AS c, sin(atan2(e02-e20, e00+e22)) AS s FROM dl)\nSELECT CAST(frame_id AS BIGINT) AS a_pos, "
    + ", ".join(f"round(c*a_r0{j}+s*a_r2{j}, 9) + 0.0D AS r0{j}, round(a_r1{j}, 9) + 0.0D AS r1{j}, round(c*a_r2{j}-s*a_r0{j}, 9) + 0.0D AS r2{j}" for j in range(3))
    + ", round(b_tx, 9) + 0.0D AS tx, round(b_ty, 9) + 0.0D AS ty, round(b_tz, 9) + 0.0D AS tz FROM yaw",
    "fx_poses",
)
def tilt_restored(spark, d):
    """The next pose's place and heading with this one's roll and pitch."""
    pairs = metrics.consecutive(_matrices(spark, d))
    return _rounded(pairs.select("a_pos", *[c.alias(k) for k, c in g.tilt_restored("a_", "b_").items()]), "a_pos")


@query(
    ROTATED + """, pairs AS (SELECT a.frame_id AS i, b.frame_id AS j, round(sqrt((a.tx-b.tx)*(a.tx-b.tx)+(a.ty-b.ty)*(a.ty-b.ty)+(a.tz-b.tz)*(a.tz-b.tz)), 9) AS dist FROM mat a JOIN mat b ON b.frame_id - a.frame_id >= 15
 WHERE a.r02*b.r02+a.r12*b.r12+a.r22*b.r22 >= 0.5000000000000001D),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rn FROM pairs WHERE dist <= 1.5D)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, dist FROM best WHERE rn = 1 ORDER BY dist, i, j LIMIT 20""",
    "fx_poses",
)
def loop_candidates(spark, d):
    """J7 T-2 T-3."""
    return metrics.loop_candidates(_matrices(spark, d))


def _frame_clouds(spark, d) -> DataFrame:
    """Per-frame world points of the metric voxel, in voxel order; the voxel is taken in camera space, in single precision."""
    camera = _camera(spark, d)
    single = camera.select("frame_id", "v", "u", *g.MATRIX, *[F.col(f"c{c}_m").cast("float").alias(c) for c in "xyz"])
    cells = cloud.first_per_voxel(single, DriftOptions().metric_voxel, keep=("frame_id", *g.MATRIX))
    moved = g.moved(*(F.col(c).cast("double") for c in "xyz"))
    return cells.select("frame_id", "ix", "iy", "iz", *[c.alias(n) for n, c in zip("xyz", moved)])


METRIC_VOXEL = "CAST(floor(CAST(CAST({c} AS DOUBLE)/0.029999999329447746D AS FLOAT)) AS BIGINT)"
FRAME_CLOUDS = (
    WORLD
    + ", sing AS (SELECT * EXCLUDE (px, py, pz), CAST(px AS FLOAT) AS px, CAST(py AS FLOAT) AS py, CAST(pz AS FLOAT) AS pz FROM cam), vox AS (SELECT *, "
    + ", ".join(METRIC_VOXEL.format(c=f"p{c}") + f" AS i{c}" for c in "xyz")
    + """ FROM sing), fc AS (SELECT frame_id, ix, iy, iz, r00*px+r01*py+r02*pz+tx AS x, r10*px+r11*py+r12*pz+ty AS y, r20*px+r21*py+r22*pz+tz AS z
 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, ix, iy, iz ORDER BY v, u) AS rn FROM vox) q WHERE rn = 1)"""
)


@query(
    FRAME_CLOUDS + """, thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY ix, iy, iz) - 1 AS r FROM fc) q WHERE r % 3 = 0),
cells AS (SELECT DISTINCT frame_id, floor(x/0.05D) AS a, floor(y/0.05D) AS b, floor(z/0.05D) AS c FROM thin),
sizes AS (SELECT frame_id, count(*) AS n FROM cells GROUP BY frame_id),
hits AS (SELECT p.frame_id, count(*) AS hits FROM cells p JOIN cells q ON p.frame_id + 1 = q.frame_id AND p.a = q.a AND p.b = q.b AND p.c = q.c GROUP BY p.frame_id)
SELECT s.frame_id AS a, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(s.n AS BIGINT) AS n_a, CAST(t.n AS BIGINT) AS n_b, round(coalesce(hits, 0) / CAST(greatest(1, least(s.n, t.n)) AS DOUBLE), 9) AS score
FROM sizes s JOIN sizes t ON s.frame_id + 1 = t.frame_id LEFT JOIN hits h ON s.frame_id = h.frame_id""",
    "fx_poses", "fx_pixels",
)
def neighbour_overlap(spark, d):
    """J8 W6 A16 U2 U3."""
    return metrics.neighbour_overlap(_frame_clouds(spark, d)).withColumn("score", F.round("score", 9))


@query(
    FRAME_CLOUDS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY ix, iy, iz) AS pid FROM fc),
dist AS (SELECT p.frame_id, p.pid, min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) AS d FROM numbered p JOIN numbered q ON p.frame_id + 1 = q.frame_id GROUP BY p.frame_id, p.pid)
SELECT frame_id AS a, CAST(count(*) AS BIGINT) AS n_a, CAST(count(*) FILTER (d < 0.3D) AS BIGINT) AS near, round(median(d) FILTER (d < 0.3D), 9) AS median FROM dist GROUP BY frame_id HAVING count(*) FILTER (d < 0.3D) > 0""",
    "fx_poses", "fx_pixels",
)
def neighbour_residual(spark, d):
    """J9 F13 A17."""
    points = _frame_clouds(spark, d).withColumn("pid", F.struct("ix", "iy", "iz"))
    return metrics.neighbour_residual(points).withColumn("median", F.round("median", 9))


HISTOGRAM = """lo AS (SELECT min(y) AS y0, max(y) AS y1, (min(y)+0.02D)-min(y) AS dl FROM fx_room_points),
edges AS (SELECT i, y0 + i*dl AS e0, y0 + (i+1)*dl AS e1, i = max(i) OVER () AS last FROM (SELECT *, unnest(range(CAST(ceil((y1+0.02D-y0)/0.02D) AS BIGINT)-1)) AS i FROM lo) q),
hist AS (SELECT e.i AS bin, count(p.y) AS n, any_value(e.e0) + 0.01D AS centre FROM edges e LEFT JOIN fx_room_points p ON p.y >= e.e0 AND (p.y < e.e1 OR (e.last AND p.y = e.e1)) GROUP BY e.i)"""


@query(HISTOGRAM + "\nSELECT CAST(bin AS BIGINT) AS bin, round(centre, 9) AS centre, CAST(n AS BIGINT) AS n FROM hist", "fx_room_points")
def vertical_histogram(spark, d):
    """A19."""
    return profile.vertical_histogram(_room(spark, d), PlaneOptions().hist_bin_m).withColumn("centre", F.round("centre", 9))


@query(
    HISTOGRAM + """, sm AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, sum(n) OVER () AS total FROM hist),
pk AS (SELECT *, max(s) OVER (ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS top, lag(s) OVER (ORDER BY bin) AS before FROM sm)
SELECT CAST(bin AS BIGINT) AS bin, round(centre, 9) AS centre, CAST(s AS BIGINT) AS strength FROM pk WHERE s = top AND s >= 0.0005D*total AND (before IS NULL OR s > before)""",
    "fx_room_points",
)
def histogram_peaks(spark, d):
    """W1-W3."""
    room = _room(spark, d)
    return profile.peaks(profile.vertical_histogram(room, PlaneOptions().hist_bin_m), room.count()).withColumn("centre", F.round("centre", 9))


@query(
    """og AS (SELECT min(x) AS ox, min(z) AS oz FROM fx_room_points),
dense AS (SELECT CAST(floor((x-ox)/0.1D) AS BIGINT) AS i, CAST(floor((z-oz)/0.1D) AS BIGINT) AS k FROM fx_room_points, og GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a.i, a.k FROM dense a JOIN dense b ON abs(a.i-b.i) <= 1 AND abs(a.k-b.k) <= 1 GROUP BY a.i, a.k HAVING count(*) = 9""",
    "fx_room_points",
)
def solid_cells(spark, d):
    """A20."""
    o = PlaneOptions()
    return profile.solid_cells(_room(spark, d), o.cell_m, o.cell_min_points)


@query(
    HISTOGRAM + """, fl AS (SELECT (SELECT y0 FROM lo) + bin*(SELECT dl FROM lo) + 0.01D AS f FROM hist ORDER BY n DESC, bin LIMIT 1)
SELECT round(any_value(f), 9) AS floor_y_m, round(quantile_cont(y, 0.9) FILTER (abs(y-f) <= 0.15D) - quantile_cont(y, 0.1) FILTER (abs(y-f) <= 0.15D), 9) AS floor_band_thickness_m, round(avg(CASE WHEN abs(y-f) <= 0.03D THEN 1.0D ELSE 0.0D END), 9) AS floor_peak_share FROM fx_room_points, fl""",
    "fx_room_points",
)
def floor_band(spark, d):
    """A14 F12."""
    return _rounded(metrics.floor_band(_room(spark, d)))


@query(
    """slab AS (SELECT * FROM fx_room_points WHERE y BETWEEN -1.4D+0.4D AND -1.4D+1.6D), c AS (SELECT DISTINCT floor(x/0.05D) AS a, floor(z/0.05D) AS b FROM slab)
SELECT CAST((SELECT count(*) FROM slab) AS BIGINT) AS wall_slab_points, CAST((SELECT count(*) FROM c) AS BIGINT) AS wall_slab_cells, round(1000.0D*(SELECT count(*) FROM c)/(SELECT count(*) FROM slab), 9) AS wall_slab_cells_per_1000_points""",
    "fx_room_points",
)
def wall_slab(spark, d):
    """A15 F11."""
    out = metrics.wall_slab(_room(spark, d), -1.4)
    return out.withColumn("wall_slab_cells_per_1000_points", F.round("wall_slab_cells_per_1000_points", 9))


@query(
    """og AS (SELECT min(x)-0.025D AS ox, min(y)-0.025D AS oy, min(z)-0.025D AS oz FROM fx_room_points)
SELECT CAST(floor((x-ox)/0.05D) AS BIGINT) AS ix, CAST(floor((y-oy)/0.05D) AS BIGINT) AS iy, CAST(floor((z-oz)/0.05D) AS BIGINT) AS iz, round(avg(x), 6) + 0.0D AS x, round(avg(y), 6) + 0.0D AS y, round(avg(z), 6) + 0.0D AS z FROM fx_room_points, og GROUP BY 1, 2, 3""",
    "fx_room_points",
)
def centroid_downsample(spark, d):
    """A10."""
    return _rounded(cloud.centroid_per_voxel(_room(spark, d), DriftOptions().reg_voxel), "ix", "iy", "iz", digits=6)


@query("SELECT CAST((((CAST(floor(x/1.0D) AS BIGINT)+2*CAST(floor(z/1.0D) AS BIGINT))%4)+4)%4 AS INT) AS subset, CAST(count(*) AS BIGINT) AS n FROM fx_room_points GROUP BY 1", "fx_room_points")
def subset_counts(spark, d):
    """M19."""
    return _room(spark, d).groupBy(profile.subset_id().alias("subset")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT x < cx AS west, z < cz AS south, CAST(count(*) AS BIGINT) AS n FROM fx_room_points, (SELECT median(x) AS cx, median(z) AS cz FROM fx_room_points WHERE y > 1) m GROUP BY 1, 2", "fx_room_points")
def quadrant_counts(spark, d):
    """Quadrants around the medians of the upper surface."""
    room = _room(spark, d)
    cx, cz = room.filter("y > 1").agg(F.percentile("x", 0.5), F.percentile("z", 0.5)).first()
    return room.groupBy((F.col("x") < g.lit(cx)).alias("west"), (F.col("z") < g.lit(cz)).alias("south")).agg(F.count(F.lit(1)).alias("n"))


BOX = "bx AS (SELECT floor(min(x)-0.5D) AS x0, ceil(max(x)+0.5D) AS x1, floor(min(z)-0.5D) AS z0, ceil(max(z)+0.5D) AS z1 FROM fx_room_points)"


@query(BOX + "\nSELECT x0 AS x_min, x1 AS x_max, z0 AS z_min, z1 AS z_max FROM bx", "fx_room_points")
def shared_bounds(spark, d):
    """A24 U4."""
    room = _room(spark, d)
    return profile.shared_bounds([room.filter("y < 0"), room.filter("y >= 0")])


def _raster_sql(box: str, up: str, low: str, high: str, ppm: int, contrast: int) -> str:
    return box + f""", px AS (SELECT CAST(({high}-{low})*{ppm} AS INT) - 1 - CAST(trunc(({up}-{low})*{ppm}) AS INT) AS row, CAST(trunc((x-x0)*{ppm}) AS INT) AS col, CAST((x1-x0)*{ppm} AS INT) AS w, CAST(({high}-{low})*{ppm} AS INT) AS h FROM fx_room_points, bx)
SELECT row, col, CAST(count(*) AS BIGINT) AS n, CAST(floor(255-255*least(1.0D, ln(1.0D+count(*))/ln(1.0D+{contrast}))) AS INT) AS gray FROM px WHERE row BETWEEN 0 AND h-1 AND col BETWEEN 0 AND w-1 GROUP BY row, col"""


@query(_raster_sql(BOX, "z", "z0", "z1", 100, 20), "fx_room_points")
def topdown_raster(spark, d):
    """A23 M23 M24 R7."""
    room = _room(spark, d)
    b = profile.shared_bounds([room]).first()
    return profile.raster(room, "x", "z", tuple(b), 100, 20)


@query(_raster_sql("bx AS (SELECT floor(min(x)) AS x0, ceil(max(x)) AS x1, floor(min(y)) AS y0, ceil(max(y)) AS y1 FROM fx_room_points)", "y", "y0", "y1", 80, 40), "fx_room_points")
def side_raster(spark, d):
    """A23 M23 M24 R6."""
    room = _room(spark, d)
    b = room.agg(F.floor(F.min("x")).cast("double"), F.ceil(F.max("x")).cast("double"), F.floor(F.min("y")).cast("double"), F.ceil(F.max("y")).cast("double")).first()
    return profile.raster(room, "x", "y", tuple(b), 80, 40)


EDGES = """edges AS (SELECT event_id, (event_id%100)/100.0D AS fitness, (event_id%7)/100.0D AS inlier_rmse, (event_id%19)/100.0D AS translation_correction_m, (event_id%13)/2.0D AS rotation_correction_deg FROM events)"""
JUDGED = """judged AS (SELECT *, CASE WHEN fitness < 0.5D THEN 'fitness ' || printf('%.2f', fitness) || ' < 0.5' WHEN inlier_rmse > 0.05D THEN 'inlier RMSE ' || printf('%.4f', inlier_rmse) || ' > 0.05'
 WHEN translation_correction_m > 0.15D THEN 'correction ' || printf('%.3f', translation_correction_m) || ' m > 0.15' WHEN rotation_correction_deg > 5 THEN 'correction ' || printf('%.1f', rotation_correction_deg) || ' deg > 5.0' ELSE 'ok' END AS reason FROM edges)"""


def _edges(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 100 / 100.0).alias("fitness"), (F.col("event_id") % 7 / 100.0).alias("inlier_rmse"), (F.col("event_id") % 19 / 100.0).alias("translation_correction_m"), (F.col("event_id") % 13 / 2.0).alias("rotation_correction_deg"))
    reason = metrics.edge_verdict(F.col("fitness"), F.col("inlier_rmse"), F.col("translation_correction_m"), F.col("rotation_correction_deg"), DriftOptions(), loop=False)
    return e.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")


def _with(body: str) -> str:
    from depthloom.plans.fixtures import duck

    return duck("WITH " + body)


def judge_edge(spark, d):
    """D2."""
    return _edges(spark, d).select("event_id", "reason")


def edge_stats(spark, d):
    """A11."""
    return _rounded(metrics.edge_stats(_edges(spark, d)), "attempted", "accepted", "rejected")


def rejection_reasons(spark, d):
    """A25."""
    return metrics.rejection_reasons(_edges(spark, d))


def judge_correction(spark, d):
    """D3 over metric pairs made from events."""
    e = F.col("event_id")
    made = {n: 1.0 + (e % (3 + i)) / 100.0 for i, n in enumerate(metrics.DIRECTIONS)}
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", *[F.lit(1.0).alias(f"before_{n}") for n in made], *[c.alias(f"after_{n}") for n, c in made.items()], F.lit(10.0).alias("before_footprint_x_m"), (10 + (e % 11) / 10.0).alias("after_footprint_x_m"), F.lit(8.0).alias("before_footprint_z_m"), F.lit(8.1).alias("after_footprint_z_m"), ((e % 10) / 10.0 + 0.2).alias("sequential_share"), ((e % 17) / 20.0).alias("max_translation_m"), ((e % 23) / 4.0).alias("max_rotation_deg"), ((e % 5) / 3.0).alias("max_tilt_change_deg"))
    return metrics.judged(rows, AcceptanceRules()).select("event_id", "verdict")


_CHANGES = {n: f"(event_id%{3 + i})/100.0D{' * -1' if not up else ''}" for i, (n, up) in enumerate(metrics.DIRECTIONS.items())}
for _f, _sql in (
    (judge_edge, EDGES + ", " + JUDGED + "\nSELECT event_id, reason FROM judged"),
    (edge_stats, EDGES + ", " + JUDGED + """
SELECT CAST(count(*) AS BIGINT) AS attempted, CAST(count(*) FILTER (reason = 'ok') AS BIGINT) AS accepted, CAST(count(*) FILTER (reason <> 'ok') AS BIGINT) AS rejected, """ + ", ".join(f"round({a}({c}) FILTER (reason = 'ok'), 9) + 0.0D AS accepted_{n}_{o}" for a, n, c, o in (("avg", "mean", "fitness", "fitness"), ("median", "median", "fitness", "fitness"), ("avg", "mean", "inlier_rmse", "inlier_rmse_m"), ("median", "median", "inlier_rmse", "inlier_rmse_m"), ("median", "median", "translation_correction_m", "translation_correction_m"), ("median", "median", "rotation_correction_deg", "rotation_correction_deg"))) + " FROM judged"),
    (rejection_reasons, EDGES + ", " + JUDGED + "\nSELECT CASE split_part(reason, ' ', 1) WHEN 'fitness' THEN 'low ICP fitness' WHEN 'inlier' THEN 'high inlier RMSE' ELSE 'correction larger than allowed' END AS category, CAST(count(*) AS BIGINT) AS n FROM judged WHERE reason <> 'ok' GROUP BY 1"),
    (judge_correction, "c AS (SELECT event_id, " + ", ".join(f"((1.0D + (event_id%{3 + i})/100.0D) - 1.0D)/1.0D{'' if up else ' * -1'} AS c{i}" for i, up in enumerate(metrics.DIRECTIONS.values())) + """ FROM events)
SELECT event_id, CASE WHEN (event_id%10)/10.0D+0.2D < 0.5D THEN 'sequential edges: too small a share accepted'
 WHEN least(c0,c1,c2,c3,c4) < -0.03D THEN 'worse: ' || concat_ws(', ', """ + ", ".join(f"CASE WHEN c{i} < -0.03D THEN '{n}' END" for i, n in enumerate(metrics.DIRECTIONS)) + """)
 WHEN greatest(c0,c1,c2,c3,c4) < 0.02D THEN 'no metric gains enough'
 WHEN abs(10+(event_id%11)/10.0D-10.0D)/10.0D > 0.05D THEN 'footprint_x_m off by over 5%'
 WHEN (event_id%17)/20.0D > 0.5D THEN 'poses moved by up to ' || printf('%.2f', (event_id%17)/20.0D) || ' m'
 WHEN (event_id%23)/4.0D > 5 THEN 'poses turned by up to ' || printf('%.1f', (event_id%23)/4.0D) || ' deg'
 WHEN (event_id%5)/3.0D > 1 THEN 'poses leant by up to ' || printf('%.1f', (event_id%5)/3.0D) || ' deg' ELSE 'accepted' END AS verdict FROM c"""),
):
    QUERIES[_f.__name__] = _f
    ORACLE_SQL[_f.__name__] = _with(_sql)


@query(
    """dense AS (SELECT CAST(floor(y/0.1D) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS area, avg(y) AS height FROM fx_room_points GROUP BY 1),
ranked AS (SELECT round(height, 6) AS h, row_number() OVER (ORDER BY area DESC, round(height, 6)) AS rn FROM dense),
fold AS (SELECT list_reduce(list_prepend(CAST([] AS DOUBLE[]), list([h] ORDER BY rn)), lambda kept, h: CASE WHEN len(list_filter(kept, lambda k: abs(k - h[1]) <= 0.15D)) = 0 THEN list_concat(kept, h) ELSE kept END) AS levels FROM ranked)
SELECT array_to_string(list_transform(levels, lambda x: printf('%.6f', x)), ',') AS levels FROM fold""",
    "fx_room_points",
)
def greedy_levels(spark, d):
    """W9 T-5: heights of the slices, fullest first, each apart from those kept before."""
    slices = _room(spark, d).groupBy(F.floor(F.col("y") / 0.1).cast("bigint").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("area"), F.avg("y").alias("height"))
    return metrics.greedy_levels(slices.select("area", F.round("height", 6).alias("height"))).select(F.array_join(F.transform("levels", lambda x: F.format_string("%.6f", x)), ",").alias("levels"))


CHECKS = (
    LISTED + ",\n" + PARSED + r""", pose AS (SELECT DISTINCT frame_id AS id FROM good), conf AS (SELECT DISTINCT CAST(regexp_extract(file_name, '^([0-9]+)\.png$', 1) AS INT) AS id FROM fx_conf_files),
checks AS (
 SELECT 'malformed_rows' AS code, 'warning' AS severity, count(*) AS n FROM parsed WHERE malformed
 UNION ALL SELECT 'duplicate_frames', 'error', count(*) FROM (SELECT frame_id FROM good GROUP BY frame_id HAVING count(*) > 1) q
 UNION ALL SELECT 'depth_gaps', 'warning', (SELECT max(id)-min(id)+1-count(*) FROM dep)
 UNION ALL SELECT 'depth_without_confidence', 'warning', count(*) FROM dep WHERE id NOT IN (SELECT id FROM conf)
 UNION ALL SELECT 'depth_without_pose', 'warning', count(*) FROM dep WHERE id NOT IN (SELECT id FROM pose)
 UNION ALL SELECT 'odd_names', 'warning', count(*) FROM fx_depth_files WHERE NOT regexp_matches(file_name, '^[0-9]+\.(png|PNG)$'))"""
)


@query(CHECKS + "\nSELECT code, severity, CAST(n AS BIGINT) AS n, (SELECT CASE WHEN sum(CASE WHEN severity = 'error' AND n > 0 THEN 1 ELSE 0 END) > 0 THEN 'INVALID' WHEN sum(n) > 0 THEN 'VALID WITH WARNINGS' ELSE 'VALID' END FROM checks) AS status FROM checks", "fx_depth_files", "fx_odometry_raw", "fx_conf_files")
def validation_status(spark, d):
    """Each check's count and severity, and the verdict over all."""
    parsed, listed_ = _odometry(spark, d), frames.listed(view(spark, d, "fx_depth_files"))
    depth_ids, good = listed_.filter("frame_id IS NOT NULL"), parsed.filter("NOT malformed")
    conf = frames.alignment(depth_ids, _ids(spark, d, "fx_conf_files")).filter("side = 'a'")
    parts = [
        ("malformed_rows", "warning", parsed.filter("malformed").select(F.lit(1).alias("n"))),
        ("duplicate_frames", "error", frames.duplicates(good).select(F.lit(1).alias("n"))),
        ("depth_gaps", "warning", frames.gaps(depth_ids).select(F.col("missing").alias("n"))),
        ("depth_without_confidence", "warning", conf.select(F.lit(1).alias("n"))),
        ("depth_without_pose", "warning", frames.alignment(depth_ids, good).filter("side = 'a'").select(F.lit(1).alias("n"))),
        ("odd_names", "warning", listed_.filter("frame_id IS NULL").select(F.lit(1).alias("n"))),
    ]
    checks = None
    for code, severity, rows in parts:
        one = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")
        checks = one if checks is None else checks.unionByName(one)
    from pyspark.sql import Window

    every = Window.partitionBy()  # six rows
    errors, any_ = F.sum(F.when((F.col("severity") == "error") & (F.col("n") > 0), 1).otherwise(0)).over(every), F.sum("n").over(every)
    return checks.withColumn("status", F.when(errors > 0, "INVALID").when(any_ > 0, "VALID WITH WARNINGS").otherwise("VALID"))


@query()
def plane_analysis(spark, d):
    """Floor and ceiling of the room; iterative fits, so rows only."""
    from depthloom.plans.planes import analysed

    room = _room(spark, d).select(F.lit("room").alias("capture_id"), "x", "y", "z", F.struct("x", "y", "z").cast("string").alias("o"))
    out = analysed(room, {"room": [-0.1, 0.2]})
    return out.select("capture_id", *[F.get_json_object("report", f"$.{p}").alias(n) for n, p in (("floor_m", "floor.height_m"), ("floor_tilt_deg", "floor.tilt_deg"), ("floor_area_m2", "floor.solid_area_m2"), ("height_m", "ceiling_height.value_m"), ("halfwidth_m", "ceiling_height.interval_halfwidth_m"))], F.size("counts").alias("bins"))


@query(
    """SELECT 'room' AS capture_id, CASE WHEN n >= 20000 THEN -1.4D END AS floor_m, CASE WHEN n >= 20000 THEN 2.5D END AS height_m, CASE WHEN n >= 20000 THEN TRUE END AS level, CASE WHEN n >= 20000 THEN TRUE END AS narrow
FROM (SELECT count(*) AS n FROM fx_room_points) c""",
    "fx_room_points",
)
def room_heights(spark, d):
    """N1-N4 D5-D8 D11 against what the room was built with: its floor and ceiling to a centimetre, level to 0.3 degrees, the interval within 5 cm; a room of a few thousand points has no solid floor, and nothing is measured."""
    r = plane_analysis(spark, d)
    number = lambda c: F.col(c).cast("double")
    return r.select("capture_id", F.round(number("floor_m"), 2).alias("floor_m"), F.round(number("height_m"), 2).alias("height_m"), (number("floor_tilt_deg") < 0.3).alias("level"), (number("halfwidth_m") < 0.05).alias("narrow"))


@query()
def registration_edges(spark, d):
    """Consecutive frames registered; iterative, so rows only."""
    from dataclasses import replace

    from depthloom.plans import drift

    options = replace(DriftOptions(), min_points=50)
    camera = _camera(spark, d)
    rows = {r["pos"]: r for r in _matrices(spark, d).collect()}  # a pose for each 64 orders; a capture's poses are the driver's to order
    ids = sorted(rows)
    import numpy as np

    poses = []
    for i in ids:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = np.array([rows[i][c] for c in g.ROTATION]).reshape(3, 3), [rows[i][c] for c in ("tx", "ty", "tz")]
        poses.append(m)
    edges = drift.register(spark, drift.scans(camera, options), ids, poses, [(k, k + 1, "sequential") for k in range(len(ids) - 1)], options)
    return spark.createDataFrame([(e.source, e.target, e.kind, e.accepted, e.reason, round(e.fitness, 5), round(e.inlier_rmse, 5)) for e in edges], "source int, target int, kind string, accepted boolean, reason string, fitness double, inlier_rmse double")
