"""Queries of the operators on poses, group ids and the order of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import poses
from . import adapter
from .registry import query

_JOINTS = 5
_POSES = f"""bx AS (SELECT clip_id, frame_idx, slot, CASE WHEN slot % 2 = 0 THEN x / 640 ELSE x END AS x, CASE WHEN slot % 2 = 0 THEN y / 480 ELSE y END AS y, CASE WHEN slot % 2 = 0 THEN w / 640 ELSE w END AS w, CASE WHEN slot % 2 = 0 THEN h / 480 ELSE h END AS h FROM det),
jt AS (SELECT clip_id, frame_idx, slot AS pose_no, ((v * 37 % 500) + (v * (j + 3) % 61) - 30) / 640.0::DOUBLE AS jx, ((v * 61 % 400) + (v * (j + 5) % 97) - 48) / 480.0::DOUBLE AS jy FROM det, range({_JOINTS}) r(j)),
sh AS (SELECT b.clip_id, b.frame_idx, b.slot, pose_no,
    count(*) FILTER (jx BETWEEN (x - w / 2) / sx AND (x + w / 2) / sx AND jy BETWEEN (y - h / 2) / sy AND (y + h / 2) / sy) / count(*)::DOUBLE AS share
    FROM (SELECT *, CASE WHEN greatest(x, y, w, h) <= 1.1 THEN 1.0::DOUBLE ELSE 640 END AS sx, CASE WHEN greatest(x, y, w, h) <= 1.1 THEN 1.0::DOUBLE ELSE 480 END AS sy FROM bx) b JOIN jt USING (clip_id, frame_idx)
    WHERE jx > 0 AND jy > 0 GROUP BY ALL)"""


@query(
    "SELECT b.clip_id, b.frame_idx, b.slot, s.pose_no, round(s.share, 6) AS share FROM bx b LEFT JOIN (SELECT * FROM sh WHERE share > 0.3 QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx, slot ORDER BY share DESC, pose_no) = 1) s USING (clip_id, frame_idx, slot)",
    _POSES,
)
def joi_05_pose_of_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.detections(spark, sf_dir)
    # every other box is in shares of the frame
    scaled = {c: F.when(F.col("slot") % 2 == 0, F.col(c) / n).otherwise(F.col(c)).alias(c) for c, n in (("x", adapter.WIDTH), ("y", adapter.HEIGHT), ("w", adapter.WIDTH), ("h", adapter.HEIGHT))}
    boxes = d.select("clip_id", "frame_idx", "slot", *scaled.values())
    v = F.col("v")
    joint = lambda j: F.struct(((v * 37 % 500 + v * (j + 3) % 61 - 30) / float(adapter.WIDTH)).alias("x"), ((v * 61 % 400 + v * (j + 5) % 97 - 48) / float(adapter.HEIGHT)).alias("y"))
    made = d.select("clip_id", "frame_idx", F.col("slot").alias("pose_no"), F.array(*[joint(j) for j in range(_JOINTS)]).alias("joints"))
    found = poses.poses_of_boxes(boxes, made, float(adapter.WIDTH), float(adapter.HEIGHT))
    return found.select("clip_id", "frame_idx", "slot", "pose_no", F.round("share", 6).alias("share"))


@query(
    """SELECT f.clip_id, f.frame_idx, coalesce(string_agg(DISTINCT g.group_id::VARCHAR, ',' ORDER BY g.group_id::VARCHAR), '') AS group_ids FROM (SELECT DISTINCT clip_id, frame_idx FROM ev) f
       LEFT JOIN (SELECT clip_id, 10 + track_id AS group_id, min(frame_idx) AS a, min(frame_idx) + 4 + track_id AS b FROM det GROUP BY clip_id, track_id) g ON g.clip_id = f.clip_id AND f.frame_idx BETWEEN g.a AND g.b GROUP BY f.clip_id, f.frame_idx"""
)
def sco_07_set_05_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapter.events(spark, sf_dir).select("clip_id", "frame_idx").distinct()
    d = adapter.detections(spark, sf_dir)
    groups = d.groupBy("clip_id", (F.col("track_id") + 10).alias("group_id")).agg(F.min("frame_idx").alias("start_frame")).withColumn("end_frame", F.col("start_frame") + F.col("group_id") - 6)
    tagged = poses.with_group_ids(frames, groups, "ids")
    return tagged.select("clip_id", "frame_idx", F.array_join("ids", ",").alias("group_ids"))


@query(
    """SELECT clip_id, frame_idx, slot, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY identity_id NULLS LAST, track NULLS LAST, NOT synthesized, slot)::INTEGER AS position
       FROM (SELECT *, CASE WHEN v % 3 <> 0 THEN track_id % 5 END AS identity_id, CASE WHEN v % 5 <> 0 THEN track_id END AS track FROM det)"""
)
def srt_02_detection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.detections(spark, sf_dir).withColumn("identity_id", F.when(F.col("v") % 3 != 0, F.col("track_id") % 5)).withColumn("track_id", F.when(F.col("v") % 5 != 0, F.col("track_id")))
    return poses.detection_order(d).select("clip_id", "frame_idx", "slot", "position")
