"""Queries of sources, sinks, cameras and motion capture; written files go to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import appearance
from ..sources import jsonl, mocap
from ..sources.storage import shared_folder
from . import adapter
from .registry import query


@query("SELECT CASE WHEN slot = 0 THEN 'ball' ELSE 'player' END AS kind, count(*) AS n, sum(t_ms) AS t_total, count(*) FILTER (slot <> 0 AND v % 3 = 0) AS tracked FROM ev GROUP BY ALL")
def src_01_snk_01_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/stream"
    rows = adapter.events(spark, sf_dir).select(F.when(F.col("slot") == 0, "ball").otherwise("player").alias("kind"), "t_ms", F.when((F.col("slot") != 0) & (F.col("v") % 3 == 0), F.col("user_id")).alias("track_id"))
    jsonl.write_lines(rows, path)
    back = jsonl.read_lines(spark, path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum("t_ms").alias("t_total"), F.count("track_id").alias("tracked"))


@query("SELECT clip_id::VARCHAR AS clip_id, count(DISTINCT frame_idx) AS frames, count(*) AS detections, sum(track_id) AS tracks FROM det GROUP BY ALL")
def src_05_14_snk_02_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/artifacts"
    d = adapter.detections(spark, sf_dir)
    frames = d.groupBy("clip_id", "frame_idx", "t_ms").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("track_id").cast("int").alias("track_id"), F.col("conf").alias("confidence")))).alias("detections"))
    documents = frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "t_ms", "detections"))).alias("frames")).withColumn("schema_version", F.lit("1.0.0"))
    jsonl.write_artifacts(documents, path)
    back = jsonl.detections(jsonl.frames(jsonl.read_artifacts(spark, path)))
    return back.groupBy("clip_id").agg(F.countDistinct("frame_idx").alias("frames"), F.count("*").alias("detections"), F.sum("track_id").alias("tracks"))


#: Clips whose calibrations are together in a document, so that no document grows with their number.
CLIPS_PER_DOCUMENT = 64


@query("SELECT clip_id::VARCHAR AS clip_id, CASE WHEN clip_id % 2 = 0 THEN 7 END AS frame_idx, clip_id + 0.5::DOUBLE AS h0 FROM (SELECT DISTINCT clip_id FROM ev)")
def src_06_07_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/calibration"
    m = F.array(F.array(F.col("clip_id") + 0.5, F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    even = F.col("clip_id") % 2 == 0
    c = adapter.events(spark, sf_dir).select("clip_id").distinct().select(F.col("clip_id").cast("string").alias("k"), F.struct(F.when(even, F.create_map(F.lit("7"), m)).alias("h_sequence"), F.when(~even, m).alias("h_matrix")).alias("c"))
    c = c.withColumn("document", F.floor(F.col("k").cast("long") / CLIPS_PER_DOCUMENT))
    documents = c.groupBy("document").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "c")))).alias("value"))
    documents.write.partitionBy("document").text(path)
    return jsonl.read_calibration(spark, path).select("clip_id", "frame_idx", F.col("h")[0].alias("h0"))


@query("SELECT part, count(*) AS n FROM (SELECT event_id % 2 AS part FROM ev WHERE slot < 5 UNION ALL SELECT 2 FROM ev WHERE slot >= 5) GROUP BY ALL")
def snk_03_04_07_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/log"
    e = adapter.events(spark, sf_dir)
    jsonl.write_lines(e.where("slot < 5").select((F.col("event_id") % 2).alias("part")), path)
    jsonl.write_lines(e.where("slot >= 5").select(F.lit(2).alias("part")), path, append=True)
    return spark.read.schema("part long").json(path).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM (SELECT CASE WHEN v % 5 = 0 THEN 'track_id' WHEN v % 3 = 0 THEN 'x' END AS problem FROM ev) GROUP BY ALL")
def flt_18_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"t_ms": '), "t_ms", F.when(F.col("v") % 5 != 0, F.lit(', "track_id": 3')).otherwise(""), F.when(F.col("v") % 3 == 0, F.lit(', "x": "far"')).otherwise(F.concat(F.lit(', "x": '), "v")), F.lit("}"))
    rows = adapter.events(spark, sf_dir).select(text.alias("value"))
    return jsonl.contract_errors(rows, {"t_ms": "int", "track_id": "int", "x": "float"}).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS clip_id, k AS slice, k * 10.0::DOUBLE AS start_s FROM (SELECT *, unnest(range(CAST(ceil(d / 10.0) AS BIGINT))) AS k FROM (SELECT event_id, v % 700 / 10.0::DOUBLE AS d FROM ev)) WHERE d > 0 AND least(k * 10.0 + 10.0, d) - k * 10.0 >= 8.0")
def flt_20_clip_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = adapter.events(spark, sf_dir).select(F.col("event_id").alias("clip_id"), (F.col("v") % 700 / 10.0).alias("duration"))
    return jsonl.clip_slices(clips, 10.0).select("clip_id", F.col("slice").cast("long").alias("slice"), F.col("start").alias("start_s"))


@query(
    "SELECT clip_id, round(sum(dx), 4) AS hx, round(sum(dy), 4) AS hy, count(*) FILTER (sqrt(dx * dx + dy * dy) > 0.05) AS panning, round(pow(0.99::DOUBLE, count(*) FILTER (sqrt(dx * dx + dy * dy) > 0.05)), 6) AS confidence FROM (SELECT clip_id, v % 10 / 100.0::DOUBLE AS dx, v % 7 / 100.0::DOUBLE AS dy FROM ev) GROUP BY ALL"
)
def prj_07_camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    d = adapter.events(spark, sf_dir).select("clip_id", (F.col("frame_idx") * 10 + F.col("slot")).alias("frame_idx"), F.array(one, zero, F.col("v") % 10 / 100.0, zero, one, F.col("v") % 7 / 100.0, zero, zero, one).alias("delta"))
    return geometry.motion_states(d).select("clip_id", F.round(F.col("h")[2], 4).alias("hx"), F.round(F.col("h")[5], 4).alias("hy"), F.col("panning").cast("long").alias("panning"), F.round("confidence", 6).alias("confidence"))


_K = np.array([[1000.0, 0, 320], [0, 1000, 240], [0, 0, 1]])
_R = geometry.look_at([0.0, -600.0, 250.0], [250.0, 200.0, 100.0])
_T = -_R @ np.array([0.0, -600.0, 250.0])
_PM = _K @ np.concatenate([_R, _T.reshape(3, 1)], 1)
_dot = lambda r: f"({_PM[r][0]!r}::DOUBLE * x + {_PM[r][1]!r}::DOUBLE * y + {_PM[r][2]!r}::DOUBLE * h + {_PM[r][3]!r}::DOUBLE)".replace("np.float64(", "(")


@query(f"SELECT clip_id, frame_idx, slot, round({_dot(0)} / ({_dot(2)} + 1e-6), 3) AS u, round({_dot(1)} / ({_dot(2)} + 1e-6), 3) AS pv FROM det")
def prj_19_camera_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.pinhole(F.col("x"), F.col("y"), F.col("h"), _K, _R, _T)
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", F.round(p["u"], 3).alias("u"), F.round(p["v"], 3).alias("pv"))


@query("SELECT clip_id, frame_idx, slot, CASE WHEN x IS NOT NULL THEN x * 2 END AS court_x, CASE WHEN y IS NOT NULL THEN y * 3 END AS court_y, 0.0 AS court_z FROM det")
def prj_29_snk_06_enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.floor_point(F.col("x"), F.col("y"), F.array(*[F.lit(a) for a in (2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0)]))
    return adapter.detections(spark, sf_dir).select("clip_id", "frame_idx", "slot", p["x"].alias("court_x"), p["y"].alias("court_y"), p["z"].alias("court_z"))


@query("SELECT clip_id, frame_idx, slot, track_id AS identity_track_id, 'tracker' AS identity_track_source, false AS synthesized FROM det")
def sco_08_identity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance.with_identity_fields(adapter.detections(spark, sf_dir).drop("synthesized")).select("clip_id", "frame_idx", "slot", "identity_track_id", "identity_track_source", "synthesized")


#: A small skeleton for the motion-capture query.
SKELETON = """:root
order TX TY TZ RX RY RZ
axis XYZ
position 0 0 100
orientation 0 0 0
:bonedata
begin
name spine
direction 0 0 1
length 20
axis 0 0 0 XYZ
dof rx ry rz
end
begin
name arm
direction 1 0 0
length 12
axis 0 0 0 XYZ
dof rz
end
:hierarchy
begin
root spine
spine arm
end
"""


@query(
    """SELECT frame, bone, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM (
         SELECT event_id + 1 AS frame, unnest(['root', 'spine', 'arm']) AS bone, unnest([0.0, 0.0, 30.48 * cos(radians(v % 360))]) AS x, unnest([2.54 * 100, 254.0, 254.0 + 30.48 * sin(radians(v % 360))]) AS y, unnest([2.54 * (v % 10), 2.54 * (v % 10) + 50.8, 2.54 * (v % 10) + 50.8]) AS z FROM ev)"""
)
def src_15_16_prj_20_21_motion_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/motion"
    frame = F.concat_ws("\n", F.col("event_id") + 1, F.concat(F.lit("root 0 "), F.col("v") % 10, F.lit(" 100 0 0 0")), F.concat(F.lit("spine 0 0 "), F.col("v") % 360), F.lit("arm 0"))
    e = adapter.events(spark, sf_dir).select("clip_id", "event_id", frame.alias("f"))
    e.groupBy("clip_id").agg(F.concat_ws("\n", F.lit(":DEGREES"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "f"))), lambda s: s["f"])).alias("value")).write.partitionBy("clip_id").text(path)  # a file for each clip of 500 frames
    solved = mocap.solved(mocap.read_motion(spark, path), mocap.parse_skeleton(SKELETON))
    return solved.select("frame", "bone", *[F.round(c, 3).alias(c) for c in "xyz"])


@query("SELECT 'move_' || v % 10 AS label, count(*) AS n, sum(v) AS total FROM ev GROUP BY ALL")
def src_19_20_training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    older = adapter.events(spark, sf_dir).select(F.concat(F.lit("move_"), F.col("v") % 10).alias("label"), "v")
    jsonl.write_lines(older, f"{folder}/v2")
    samples = jsonl.first_that_exists(spark, [f"{folder}/v3", f"{folder}/v2"], "label string, v long")
    return samples.groupBy("label").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT DISTINCT clip_id, user_id % 4 AS domain FROM ev WHERE clip_id IN (SELECT clip_id FROM ball WHERE conf > 0.98)")
def joi_21_src_18_listed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = adapter.events(spark, sf_dir).select("clip_id", (F.col("user_id") % 4).alias("domain")).distinct()
    return jsonl.listed_clips(clips, adapter.balls(spark, sf_dir).where("conf > 0.98"))
