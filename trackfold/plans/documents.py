"""Queries of rule files, reports, file hashes, pose sequences, and camera poses; written files go to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import attribution, behaviour, features, ledger, review
from ..sources import hashes, jsonl, mocap, reports, rules
from ..sources.storage import saved, shared_folder
from . import adapter, game, people, reviews
from .registry import query


def _written(spark: SparkSession, document: dict) -> dict:
    """A document after its way through a file."""
    path = f"{shared_folder(spark)}/rules"
    reports.write_document(spark, path, document)
    return rules.read_document(spark, path)


@query(
    f"SELECT event_type, count(*) AS n, sum(CASE event_type WHEN 'turnover' THEN 3 WHEN 'steal' THEN 1 ELSE 0 END) AS total FROM (SELECT *, {game._violations_sql()} AS bad FROM cases) WHERE CASE WHEN event_type = 'catch' THEN actor_id IS NOT NULL ELSE bad = '' END GROUP BY ALL",
    game._case_sql(),
)
def src_08_set_03_event_rules_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = rules.event_rules_document()
    # rules of one's own: a catch outside live play counts, a turnover counts three times
    document["events"]["catch"]["prerequisites"] = ["actor_identity_known"]
    document["events"]["turnover"]["counting"]["stat_deltas"] = {"TOs": 3}
    own = rules.event_rules(_written(spark, document))
    d = game.rule_cases(spark, sf_dir)
    d = d.withColumn("rule_validation", attribution.violations(own.rules)).where(F.size("rule_validation") == 0).withColumn("stat_deltas", attribution.stat_deltas(own.stat_deltas))
    total = F.coalesce(F.try_element_at("stat_deltas", F.lit("TOs")), F.lit(0)) + F.coalesce(F.try_element_at("stat_deltas", F.lit("Steals")), F.lit(0))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


_HIP_X = "((ps[{i}][12][1] + ps[{i}][13][1]) / 2)"
_HIP_Y = "((ps[{i}][12][2] + ps[{i}][13][2]) / 2)"
_MOVED = {k: f"({t.format(i='len(ps)')} - {t.format(i='1')})" for k, t in (("x", _HIP_X), ("y", _HIP_Y))}


@query(
    f"SELECT clip_id, track_id, frame_idx, CASE WHEN len(ps) < 15 THEN 'idle_bystander' WHEN {_MOVED['y']} < -0.02 THEN 'rise' WHEN {_MOVED['x']} < -0.01 AND possession THEN 'drive' WHEN {_MOVED['y']} > 0.01 THEN 'sink' ELSE 'idle_bystander' END AS label FROM win",
    reviews.WINDOWS,
)
def src_11_kinematic_rules_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    hips = lambda metric, operator, threshold: [("hips", metric, operator, threshold)]
    # the kinematic rules come first, as their kind is seen first
    own = [("rise", "kinematic", False, hips("velocity_z", ">", 0.02)), ("sink", "violation", False, hips("velocity_y", "<", 0.01)), ("drive", "kinematic", True, hips("velocity_x", "<", 0.01))]
    read = rules.kinematic_rules(_written(spark, rules.kinematic_rules_document(own)))
    return behaviour.with_labels(reviews.poses(spark, sf_dir), rules=read).select("clip_id", "track_id", "frame_idx", "label")


@query("SELECT clip_id, frame_idx, slot, CASE WHEN v % 7 <> 0 THEN x * 2 END AS court_x, CASE WHEN v % 7 <> 0 THEN y * 3 END AS court_y, CASE WHEN v % 7 <> 0 THEN 0.0 END AS court_z FROM det")
def snk_06_enriched_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/enriched"
    d = adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", F.when(F.col("v") % 7 != 0, F.col("x")).alias("x"), "y")
    reports.write_enriched(d, F.array(*[F.lit(a) for a in (2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0)]), path)
    return spark.read.schema("clip_id long, frame_idx long, slot long, court_x double, court_y double, court_z double").json(path)


@query("SELECT 'adapter' AS dataset_id, sum(n)::BIGINT AS sample_count, max(CASE WHEN l = 'error' THEN n END) AS errors, 'fail' AS validation_status, sum(bad)::BIGINT AS n_errors FROM (SELECT event_type AS l, count(*) AS n, count(*) FILTER (v % 3 = 0) AS bad FROM ev GROUP BY ALL)")
def snk_08_manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.transform(F.sequence(F.lit(1), F.lit(72)), lambda k: (F.col("v") * k % 10).cast("double"))
    short = F.col("v") % 3 == 0
    s = adapter.events(spark, sf_dir).select(F.col("event_type").alias("label"), F.when(short, F.array_repeat(row, 29)).otherwise(F.array_repeat(row, 30)).alias("features"))
    path = reports.write_manifest(features.manifest(s, "adapter"), f"{shared_folder(spark)}/dataset")
    m = spark.read.schema("dataset_id string, sample_count long, class_distribution map<string,long>, validation_status string, n_errors long").json(path)
    return m.select("dataset_id", "sample_count", F.col("class_distribution")["error"].alias("errors"), "validation_status", "n_errors")


@query(
    """SELECT category, count(*) AS case_count, sum(found) AS found, max(n_cases) AS n_cases FROM (SELECT *, CAST(artifact_found AS INTEGER) AS found, count(*) OVER () AS n_cases FROM rp) r, unnest(CASE WHEN len(categories) > 0 THEN categories ELSE ['uncategorized'] END) u(category) GROUP BY category""",
    reviews._REPORT,
)
def snk_09_srt_06_audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    report = saved(reviews._report(spark, sf_dir))  # three files are made of it, two of them sorted, which reads it twice
    reports.write_fixture(report.select("case_id", "clip_id", "frame_idx", "categories", "scene_context"), "events", f"{path}/fixture")
    reports.write_audit(report, review.category_rollup(report), f"{path}/fixture", "artifacts", f"{path}/audit")
    n = reports.read_document(spark, f"{path}/fixture/report")["case_count"]
    audit = reports.read_document(spark, f"{path}/audit/report")
    assert audit["case_count"] == n
    back = spark.read.schema("category string, case_count long, artifact_found_count long").json(f"{path}/audit/categories")
    return back.select("category", "case_count", F.col("artifact_found_count").alias("found"), F.lit(n).cast("long").alias("n_cases"))


@query(
    "SELECT game_id, 'Final Score: [' || coalesce(sum(points) FILTER (kind = 'MadeBasket' AND is_official AND team_id = 1), 0)::BIGINT || ', ' || coalesce(sum(points) FILTER (kind = 'MadeBasket' AND is_official AND team_id <> 1), 0)::BIGINT || ']' AS line FROM lg GROUP BY game_id",
    people._LEDGER,
)
def snk_11_score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_lines(ledger.summary(people.ledger_events(spark, sf_dir)))


@query("SELECT clip_id, sha256(string_agg(event_id || ',' || v, chr(10) ORDER BY event_id) || chr(10)) AS sha256 FROM ev GROUP BY clip_id")
def agg_14_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/hashed"
    e = adapter.events(spark, sf_dir).select("clip_id", F.struct("event_id", F.concat_ws(",", "event_id", "v").alias("t")).alias("s"))
    # a file for each clip of 500 events
    e.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("value")).write.partitionBy("clip_id").text(path)
    return hashes.file_hashes(spark, path).select(F.regexp_extract("path", r"clip_id=(\d+)", 1).cast("long").alias("clip_id"), "sha256")


@query("SELECT frame_idx % 2 AS sequence, count(DISTINCT clip_id * 1000 + frame_idx) AS steps, count(*) AS points, sum(x) AS total FROM det GROUP BY ALL")
def src_17_pose_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/sequences"
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value])
    d = adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", F.array("x", "y").alias("xy"))
    steps = d.groupBy("clip_id", "frame_idx").agg(ordered("slot", "xy").alias("step"))
    both = steps.groupBy("clip_id", (F.col("frame_idx") % 2).alias("part")).agg(ordered("frame_idx", "step").alias("poses"))
    clips = both.groupBy("clip_id").agg(ordered("part", "poses").alias("sequences"))
    # every other file is an object, the others are lists
    text = F.when(F.col("clip_id") % 2 == 0, F.to_json("sequences")).otherwise(F.to_json(F.struct("sequences")))
    clips.select("clip_id", text.alias("value")).write.partitionBy("clip_id").text(path)
    back = jsonl.pose_sequences(spark, path).select(F.col("sequence").cast("long").alias("sequence"), F.explode("poses").alias("step"))
    summed = F.aggregate("step", F.lit(0.0), lambda a, p: a + p[0])
    return back.groupBy("sequence").agg(F.count("*").alias("steps"), F.sum(F.size("step")).alias("points"), F.sum(summed).alias("total"))


@query("SELECT clip_id, frame_idx, round(cos(radians(v % 360)), 6) + 0.0 AS r00, round(sin(radians(v % 360)), 6) + 0.0 AS r10, 1.0 AS r22, v % 10 + 0.0::DOUBLE AS tx, v % 7 + 0.0::DOUBLE AS ty, 30.0 + v % 5 AS tz FROM ev".replace("30.0 + v % 5", "30.0::DOUBLE + v % 5"))
def prj_09_10_camera_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = np.array([[1000.0, 0, 320], [0, 1000, 240], [0, 0, 1]])
    v = F.col("v")
    c, s, scale = F.cos(F.radians(v % 360)), F.sin(F.radians(v % 360)), 1.0 + v % 3
    tx, ty, tz = v % 10, v % 7, 30 + v % 5
    h = F.array(*[x * scale for x in (1000 * c, -1000 * s, 1000 * tx + 320 * tz, 1000 * s, 1000 * c, 1000 * ty + 240 * tz, F.lit(0.0), F.lit(0.0), tz.cast("double"))])
    d = adapter.events(spark, sf_dir).select("clip_id", "frame_idx", geometry.camera_poses(h, k).alias("p"))
    r, t = F.col("p.rotation"), F.col("p.translation")
    six = lambda x, name: (F.round(x, 6) + 0.0).alias(name)
    return d.select("clip_id", "frame_idx", six(r[0], "r00"), six(r[3], "r10"), six(r[8], "r22"), six(t[0], "tx"), six(t[1], "ty"), six(t[2], "tz"))


_BONES = [("head", "0 0 1", 60), ("lhumerus", "1 0 0", 10), ("rhumerus", "-1 0 0", 10)] + [(b, "0 0 -1", 10 * i) for i, b in enumerate(mocap.COCO_BONES[2:], 1)]
_STICKS = (
    ":root\norder TX TY TZ RX RY RZ\naxis XYZ\nposition 0 0 0\norientation 0 0 0\n:bonedata\n"
    + "".join(f"begin\nname {b}\ndirection {d}\nlength {n}\naxis 0 0 0 XYZ\nend\n" for b, d, n in _BONES)
    + f":hierarchy\nbegin\nroot {' '.join(b for b, _, _ in _BONES)}\nend\n"
)


@query("SELECT frame, 0.0 AS nose_x, 249.0 AS nose_y, round(z + 152.4, 3) AS nose_z, -5.0 AS ear_x, 252.0 AS ear_y, round(z + 153.4, 3) AS ear_z, -25.4 AS right_shoulder_x, round(z - 254.0, 3) AS right_foot_z FROM (SELECT event_id + 1 AS frame, 2.54 * (v % 10) AS z FROM ev)")
def prj_22_joints_of_bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/capture"
    e = adapter.events(spark, sf_dir).select("clip_id", F.struct("event_id", F.concat_ws("\n", F.col("event_id") + 1, F.concat(F.lit("root 0 "), F.col("v") % 10, F.lit(" 100 0 0 0"))).alias("f")).alias("s"))
    e.groupBy("clip_id").agg(F.concat_ws("\n", F.lit(":DEGREES"), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"])).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file, but no folder, for each clip of 500 frames
    joints = mocap.solved_poses(mocap.read_motion(spark, path), mocap.parse_skeleton(_STICKS))
    j = lambda k, axis: F.get("joints", F.lit(k))[axis]
    at = {"nose_x": j(0, 0), "nose_y": j(0, 1), "nose_z": j(0, 2), "ear_x": j(3, 0), "ear_y": j(3, 1), "ear_z": j(3, 2), "right_shoulder_x": j(6, 0), "right_foot_z": j(16, 2)}
    return joints.select("frame", *[(F.round(c, 3) + 0.0).alias(n) for n, c in at.items()])


# The moves in SQL: all joints, the joints that differ, and the ball.
