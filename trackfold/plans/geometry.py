"""Queries of projections and court predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import court, geometry
from . import adapter
from .registry import query

_H = "1.1, 0.2, 5.0, 0.1, 0.9, 3.0, 0.0001, 0.0002, 1.0"
_HS = [float(x) for x in _H.split(", ")]


def _h():
    return F.array(*[F.lit(x) for x in _HS])


def r4(column, name: str):
    """Rounded to four places."""
    return F.round(column, 4).alias(name)


_W = "(0.0001 * x + 0.0002 * y + 1.0 + 1e-6)"


@query(f"SELECT clip_id, frame_idx, slot, round((1.1 * x + 0.2 * y + 5.0) / {_W}, 4) AS px, round((0.1 * x + 0.9 * y + 3.0) / {_W}, 4) AS py FROM det")
def prj_01_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.project(F.col("x"), F.col("y"), _h())
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", r4(p["x"], "px"), r4(p["y"], "py"))


@query(
    "SELECT clip_id, frame_idx, slot, CASE WHEN abs(w0) >= 1e-6 THEN round((1.1 * x + 0.2 * y + 5.0) / w0, 4) END AS px, CASE WHEN abs(w0) >= 1e-6 THEN round((0.1 * x + 0.9 * y + 3.0) / w0, 4) END AS py FROM (SELECT *, x - 100.0 AS w0 FROM det)"
)
def prj_02_floor_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.array(*[F.lit(x) for x in [*_HS[:6], 1.0, 0.0, -100.0]])
    p = geometry.floor_point(F.col("x"), F.col("y"), h)
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", r4(p["x"], "px"), r4(p["y"], "py"))


_STEP = """u{n} AS (SELECT clip_id, frame_idx, slot, x0, y0,
    (x0 - (2 * 0.001 * ux * uy + 0.002 * (ux * ux + uy * uy + 2 * ux * ux))) / (1 + 0.1 * (ux * ux + uy * uy) + 0.01 * (ux * ux + uy * uy) * (ux * ux + uy * uy)) AS ux,
    (y0 - (0.001 * (ux * ux + uy * uy + 2 * uy * uy) + 2 * 0.002 * ux * uy)) / (1 + 0.1 * (ux * ux + uy * uy) + 0.01 * (ux * ux + uy * uy) * (ux * ux + uy * uy)) AS uy
    FROM u{p})"""


@query(
    "SELECT clip_id, frame_idx, slot, round(ux * 1000.0 + 320.0, 4) AS px, round(uy * 1000.0 + 240.0, 4) AS py FROM u5",
    "u0 AS (SELECT clip_id, frame_idx, slot, (x - 320.0) / 1000.0 AS x0, (y - 240.0) / 1000.0 AS y0, (x - 320.0) / 1000.0 AS ux, (y - 240.0) / 1000.0 AS uy FROM det)," + ",".join(_STEP.format(n=n, p=n - 1) for n in range(1, 6)),
)
def prj_03_undistort(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.undistort(F.col("x"), F.col("y"), {"k1": 0.1, "k2": 0.01, "p1": 0.001, "p2": 0.002}, 1000.0, 1000.0, 320.0, 240.0)
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", r4(p["x"], "px"), r4(p["y"], "py"))


def _joints():
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.array(F.col("x") + j * 3, F.col("y") + j * j))


_JOINT = ["clip_id", "frame_idx", "slot", "j"]


def _by_joint(rows: DataFrame, joints) -> DataFrame:
    """A row for each joint; of a named column Spark would first filter by its size, and work it out for each test again."""
    return rows.select(*_JOINT[:3], F.posexplode(joints).alias("j", "p")).withColumn("j", F.col("j").cast("long"))


_JOINTS = "(SELECT *, unnest(range(17)) AS j FROM det)"


@query(
    f"""SELECT clip_id, frame_idx, slot, j, round((1.1 * jx + 0.2 * jy + 5.0) / w0, 4) AS jx, round((0.1 * jx + 0.9 * jy + 3.0) / w0, 4) AS jy, round(abs((0.1 * jx + 0.9 * jy + 3.0) / w0 - (0.1 * fx + 0.9 * fy + 3.0) / w1) * 0.75, 4) AS jz
        FROM (SELECT *, 0.0001 * jx + 0.0002 * jy + 1.0 + 1e-6 AS w0, 0.0001 * fx + 0.0002 * fy + 1.0 + 1e-6 AS w1 FROM (SELECT *, x + j * 3 AS jx, y + j * j AS jy, x + 46.5 AS fx, y + 240.5 AS fy FROM {_JOINTS}))"""
)
def prj_04_lift_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_joint(adapter.detections(spark, sf_dir), geometry.lift_joints(_joints(), _h())).select(*_JOINT, r4(F.col("p")[0], "jx"), r4(F.col("p")[1], "jy"), r4(F.col("p")[2], "jz"))


@query(
    f"SELECT clip_id, frame_idx, slot, j, round((1.1 * fx + 0.2 * fy + 5.0) / w0, 4) AS jx, round((0.1 * fx + 0.9 * fy + 3.0) / w0, 4) AS jy, round(abs(fy - jy) * 0.5, 4) AS jz FROM (SELECT *, (0.0001 * fx + 0.0002 * fy + 1.0) AS w0 FROM (SELECT *, x + 46.5 AS fx, y + 240.5 AS fy, y + j * j AS jy FROM {_JOINTS}))"
)
def prj_05_lift_on_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_joint(adapter.detections(spark, sf_dir), geometry.lift_joints_on_floor(_joints(), _h())).select(*_JOINT, r4(F.col("p")[0], "jx"), r4(F.col("p")[1], "jy"), r4(F.col("p")[2], "jz"))


@query("SELECT clip_id, frame_idx, slot, d AS determinant, abs(d) > 1e-6 AS invertible FROM (SELECT *, v % 5 * (v % 7) - v % 3 * (v % 4) + 0.0::DOUBLE AS d FROM det)")
def prj_06_homography_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.detections(spark, sf_dir)
    z, one = F.lit(0.0), F.lit(1.0)
    h = F.array(*[(F.col("v") % m).cast("double") for m in (5, 3)], z, *[(F.col("v") % m).cast("double") for m in (4, 7)], z, z, z, one)
    s = geometry.homography_sanity(h)
    return d.select("clip_id", "frame_idx", "slot", s["determinant"].alias("determinant"), s["invertible"].alias("invertible"))


_P = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{k}', '{f}', {p[0][0]}, {p[0][1]}, {p[1][0] if k == 'line' else 'NULL'}, {p[1][1] if k == 'line' else 'NULL'}, {p[1][0] if k == 'arc' else 'NULL'}, {p[2][0] if k == 'arc' else 'NULL'}, {p[2][1] if k == 'arc' else 'NULL'})" for n, (k, f, p) in geometry.PRIMITIVES.items()
) + ") t(primitive_id, kind, family, x0, y0, x1, y1, radius, a0, a1))"


@query(
    f"""SELECT clip_id, frame_idx, slot, primitive_id,
        round(CASE kind WHEN 'point' THEN x0 WHEN 'line' THEN x0 + (x1 - x0) * a ELSE x0 + radius * cos(radians(a0 + (a1 - a0) * a)) END, 3) AS wx,
        round(CASE kind WHEN 'point' THEN y0 WHEN 'line' THEN y0 + (y1 - y0) * a ELSE y0 + radius * sin(radians(a0 + (a1 - a0) * a)) END, 3) AS wy
        FROM (SELECT *, greatest(0.0, least(1.0, conf * 1.2 - 0.1)) AS a FROM det) d JOIN (SELECT *, row_number() OVER (ORDER BY primitive_id) - 1 AS n FROM {_P}) p ON d.v % 12 = p.n"""
)
def prj_11_primitive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted(geometry.PRIMITIVES)
    d = adapter.detections(spark, sf_dir).withColumn("primitive_id", F.element_at(F.array(*map(F.lit, names)), (F.col("v") % 12).cast("int") + 1))
    d = d.join(F.broadcast(geometry.primitive_rows(spark)), "primitive_id")  # twelve rows
    p = geometry.world_point(F.col("conf") * 1.2 - 0.1)
    return d.select("clip_id", "frame_idx", "slot", "primitive_id", F.round(p["x"], 3).alias("wx"), F.round(p["y"], 3).alias("wy"))


@query(
    """SELECT clip_id, frame_idx, slot,
        CASE v % 4 WHEN 0 THEN x + 1 WHEN 1 THEN x WHEN 2 THEN (x - w / 2 + x + w / 2) / 2 ELSE 0.0 END AS cx, CASE v % 4 WHEN 0 THEN y + 1 WHEN 1 THEN y WHEN 2 THEN (y - h / 2 + y + h / 2) / 2 ELSE 0.0 END AS cy,
        greatest(1.0, CASE v % 4 WHEN 0 THEN w - 30 WHEN 1 THEN w WHEN 2 THEN (x + w / 2) - (x - w / 2) ELSE 1.0 END) AS bw, greatest(1.0, CASE v % 4 WHEN 0 THEN h - 60 WHEN 1 THEN h WHEN 2 THEN (y + h / 2) - (y - h / 2) ELSE 1.0 END) AS bh
        FROM det"""
)
def prj_12_13_box_centre_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h, m = *map(F.col, "xywh"), F.col("v") % 4
    box = {
        "smoothed": F.when(m == 0, F.array(x + 1, y + 1)),
        "smoothed_xywh": F.when(m == 0, F.array(x, y, w - 30, h - 60)),
        "xywh": F.when(m <= 1, F.array(x, y, w, h)),
        "xyxy": F.when(m <= 2, F.array(x - w / 2, y - h / 2, x + w / 2, y + h / 2)),
    }
    c, s = geometry.box_centre(box), geometry.box_size(box)
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", c["x"].alias("cx"), c["y"].alias("cy"), s["w"].alias("bw"), s["h"].alias("bh"))


@query(
    "SELECT clip_id, frame_idx, slot, round(x + (y - x) * conf, 4) AS mid, round(greatest(0.0, least(1.0, x / 400.0)), 4) AS share, round(sqrt(vx * vx + vy * vy), 4) AS speed2, CASE WHEN v % 2 = 0 THEN round(x + (w - x) * conf, 4) END AS px FROM det"
)
def prj_14_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.array("x", "y"))
    b = F.when(F.col("v") % 2 == 0, F.array(F.array("w", "h"))).otherwise(F.array(F.array("w", "h"), F.array("w", "h")))
    p = geometry.lerp_points(a, b, F.col("conf"))
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", r4(geometry.lerp(F.col("x"), F.col("y"), F.col("conf")), "mid"), r4(geometry.clip01(F.col("x") / 400.0), "share"), r4(geometry.norm2(F.col("vx"), F.col("vy")), "speed2"), r4(p[0][0], "px"))


@query("SELECT DISTINCT clip_id, frame_idx, CAST(trunc((frame_idx + 1) / 30.0::DOUBLE * 1000) AS BIGINT) AS t_inference, CAST(trunc(frame_idx / 30.0::DOUBLE * 1000) AS BIGINT) AS t_review FROM det")
def prj_15_frame_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("frame_idx")
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", geometry.frame_time(f, 30.0, 1).alias("t_inference"), geometry.frame_time(f, 30.0).alias("t_review")).distinct()


@query(
    """SELECT clip_id, track_id, i AS step, s[CAST(floor(CASE WHEN len(s) <= 30 THEN i ELSE i * (len(s) - 1) / 29.0 END) AS BIGINT) + 1] AS frame_idx
       FROM (SELECT *, unnest(range(least(30, len(s)))) AS i FROM (SELECT clip_id, track_id, list(frame_idx ORDER BY frame_idx) AS s FROM ply GROUP BY ALL))"""
)
def prj_24_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = adapter.players(spark, sf_dir).groupBy("clip_id", "track_id").agg(F.sort_array(F.collect_list("frame_idx")).alias("s"))
    return tracks.select("clip_id", "track_id", F.posexplode(geometry.resampled(F.col("s"))).alias("step", "frame_idx")).select("clip_id", "track_id", F.col("step").cast("long").alias("step"), "frame_idx")


@query("SELECT clip_id, frame_idx, slot, j, round(j * 3 / (48 + 1e-6), 4) AS nx, round(j * j / (256 + 1e-6), 4) AS ny FROM " + _JOINTS)
def prj_23_box_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_joint(adapter.detections(spark, sf_dir), geometry.box_normalised(_joints())).select(*_JOINT, r4(F.col("p")[0], "nx"), r4(F.col("p")[1], "ny"))


_FLT = "SELECT clip_id, frame_idx, slot, "
_DR = "sqrt((cx - {rim}) * (cx - {rim}) + (cy - 762.0) * (cy - 762.0))"
_C = "(SELECT *, v % 2865 + 0.0::DOUBLE AS cx, v * 7 % 1524 + 0.0::DOUBLE AS cy, v * 3 % 400 + 0.0::DOUBLE AS cz, v % 2 = 0 AS lft FROM det)"


def _court(spark, sf_dir):
    d = adapter.detections(spark, sf_dir)
    return d.selectExpr("*", "v % 2865 + 0.0D AS cx", "v * 7 % 1524 + 0.0D AS cy", "v * 3 % 400 + 0.0D AS cz", "v % 2 = 0 AS lft")


@query(
    _FLT
    + f"""abs(cz - 304.8) < 10 AND ({_DR.format(rim='160.0')} < 22.86 OR {_DR.format(rim='2705.0')} < 22.86) AS in_rim,
    coalesce(court_x < 0 OR court_x > 2865 OR court_y < 0 OR court_y > 1524, false) AS out_of_bounds,
    {_DR.format(rim='(CASE WHEN lft THEN 160.0 ELSE 2705.0 END)')} > 675 AS three, abs(cz - 304.8) < 50 AS rebound,
    sqrt((x - w) * (x - w) + (y - h) * (y - h) + (cz - 100) * (cz - 100)) < 20 AND cz >= 90 AS blocking, abs(vy - vx) > 100 AND cz > 150 AS release
    FROM {_C}"""
)
def flt_06_to_13_court_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z, c = F.col("cx"), F.col("cy"), F.col("cz"), F.col
    return _court(spark, sf_dir).select(
        "clip_id",
        "frame_idx",
        "slot",
        court.in_rim(x, y, z).alias("in_rim"),
        F.coalesce(court.out_of_bounds(c("court_x"), c("court_y")), F.lit(False)).alias("out_of_bounds"),
        court.three_point_attempt(x, y, c("lft")).alias("three"),
        court.rebound_opportunity(z).alias("rebound"),
        court.blocking_path((c("x"), c("y"), z), (c("w"), c("h"), F.lit(100.0))).alias("blocking"),
        court.shot_release(c("vx"), c("vy"), z).alias("release"),
    )


@query(
    f"""SELECT lft AS target_left, zone, count(*) AS n, sum(v) AS total FROM (SELECT *, CASE WHEN fb > 1432.5 THEN 'Backcourt' WHEN fb < 580 AND abs(cy - 762) < 245 THEN 'Paint'
        WHEN dr > 675 AND fb < 300 THEN CASE WHEN cy < 762 THEN 'CornerLeft' ELSE 'CornerRight' END WHEN dr > 675 AND abs(cy - 762) < 300 THEN 'TopOfKey' WHEN cy < 762 THEN 'WingLeft' ELSE 'WingRight' END AS zone
        FROM (SELECT *, CASE WHEN lft THEN cx ELSE 2865 - cx END AS fb, {_DR.format(rim='(CASE WHEN lft THEN 160.0 ELSE 2705.0 END)')} AS dr FROM {_C})) GROUP BY ALL"""
)
def flt_09_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _court(spark, sf_dir).withColumn("zone", court.zone(F.col("cx"), F.col("cy"), F.col("lft")))
    return d.groupBy(F.col("lft").alias("target_left"), "zone").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT clip_id, frame_idx, slot FROM det WHERE v % 40 = 32 OR replace(lower(CASE WHEN v % 5 = 0 THEN 'Sports Ball' WHEN v % 5 = 1 THEN 'sports_ball' ELSE 'person' END), ' ', '_') = 'sports_ball'")
def flt_01_02_ball_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("v") % 5 == 0, "Sports Ball").when(F.col("v") % 5 == 1, "sports_ball").otherwise("person")
    return adapter.detections(spark, sf_dir).where(court.is_ball(F.col("v") % 40, name)).select("clip_id", "frame_idx", "slot")


@query("SELECT clip_id, count(*) AS n, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM ply WHERE abs(t_ms - 800) < 100 GROUP BY clip_id")
def flt_03_04_time_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.players(spark, sf_dir).where(F.abs(F.col("t_ms") - 800) < 100)
    return d.groupBy("clip_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


@query("SELECT clip_id, frame_idx, v, x AS px, y AS py, 50.0 AS pz, CAST(trunc(conf * 10000) AS INTEGER) AS confidence_bps FROM ball")
def prj_16_ball_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapter.balls(spark, sf_dir)
    return b.select("clip_id", "frame_idx", "v", F.col("x").alias("px"), F.col("y").alias("py"), F.lit(50.0).alias("pz"), (F.col("conf") * 10000).cast("int").alias("confidence_bps"))
