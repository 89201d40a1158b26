"""Queries of review, calibration, behaviour and feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import behaviour, calibration, features, review
from . import adapter
from .registry import query

_BOX = "bx AS (SELECT *, x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2 FROM det)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with boxes and what a frame summary reads."""
    return adapter.detections(spark, sf_dir).selectExpr("*", "x - w / 2 AS x1", "y - h / 2 AS y1", "x + w / 2 AS x2", "y + h / 2 AS y2", "v % 4 <> 0 AS active", "CASE WHEN v % 3 = 0 THEN NULL ELSE track_id % 5 END AS identity_id")


_IOU = """ov AS (SELECT clip_id, frame_idx, a.slot AS slot_a, b.slot AS slot_b, iw * ih / (a.w * a.h + b.w * b.h - iw * ih) AS iou FROM (
    SELECT a, b, a.clip_id AS clip_id, a.frame_idx AS frame_idx, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS iw, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS ih FROM bx a JOIN bx b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.slot < b.slot)
    WHERE iw * ih / (a.w * a.h + b.w * b.h - iw * ih) >= 0.2)"""


@query("SELECT clip_id, frame_idx, slot_a, slot_b, round(iou, 4) AS iou FROM ov", f"{_BOX}, {_IOU}")
def joi_08_sco_14_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.overlapping_pairs(boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 4))


_SUMMARY = f"""{_BOX}, {_IOU},
fs AS (SELECT clip_id, frame_idx, count(*) AS detections, string_agg(track_id::VARCHAR, ',' ORDER BY track_id::VARCHAR) AS track_ids, count(DISTINCT coalesce(CASE WHEN v % 3 = 0 THEN NULL ELSE track_id % 5 END, track_id)) AS canonical_tracks, count(*) FILTER (v % 4 <> 0) AS active,
       count(*) FILTER (synthesized) AS synthesized, count(*) FILTER (speed < 6) AS low_motion, count(*) FILTER (speed <= 0.5) AS zero_motion, round(min(speed), 3) AS speed_min, round(median(speed), 3) AS speed_median, round(max(speed), 3) AS speed_max,
       {", ".join(f"count(*) FILTER (uniform = '{u}') AS {u}, count(*) FILTER (uniform = '{u}' AND v % 4 <> 0) AS active_{u}" for u in ("dark", "light", "unknown"))} FROM bx GROUP BY ALL),
fo AS (SELECT fs.*, coalesce(n, 0) AS overlaps FROM fs LEFT JOIN (SELECT clip_id, frame_idx, count(*) AS n FROM ov GROUP BY ALL) USING (clip_id, frame_idx))"""


@query("SELECT * FROM fo", _SUMMARY)
def agg_08_frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.frame_summary(boxes(spark, sf_dir))


_NOTES = ["two spectators on the bench", "A Spectator, seated", "bystanders near the ref", "missed 3 players in the cluster", "players merged into one", "same player becomes 7", "dark uniform seen as light", "dribbling forward, live play", "out of bounds, dead ball", "", None, "referee at the sideline", "merge of a clustered group, missed"]
_ISSUES = review.ISSUE_TYPES
_NOTE_SQL = "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in _NOTES) + "]"
_ISSUE_SQL = "[" + ", ".join(f"'{i}'" for i in _ISSUES) + "]"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review notes on frames."""
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("v") % len(xs)).cast("int") + 1).alias(c)
    e = adapter.events(spark, sf_dir)
    return e.select("clip_id", (F.col("frame_idx") % 20).alias("frame_idx"), "t_ms", pick(_ISSUES, "issue_type"), pick(_NOTES, "note"), F.when(F.col("v") % 4 != 0, F.col("user_id") % 12).alias("track_id"), F.when(F.col("v") % 9 != 0, F.concat(F.lit("at "), "t_ms")).alias("timestamp"), F.col("event_id").alias("seq"))


#: Words of a note by what they speak of.
_NOTE_PATTERNS = {
    "spectator": r"\bspectator\b|\bseated\b|\bbench\b",
    "bystander": r"\bbystander",
    "referee": r"\bref\b|\breferee\b|\bsideline\b",
    "cluster": r"\bcluster",
    "merged": r"\bmerged\b",
    "missed_players": r"\bmissed \d+ players?\b",
    "missed": r"\bmissed\b",
    "merge": r"\bmerged\b|\bmerge\b",
    "identity": r"\bsame\b|\bbecomes\b|\bkeep changing\b|\bid switch\b|\bnumbers keep changing\b",
    "uniform": r"\bdark\b|\blight\b|\buniform\b",
    "live": r"\bdribbling\b|\bdribbler\b|\bbringing the ball forward\b|\blive play\b",
    "dead": r"\bsubbed out\b|\bsubstitution\b|\bout of bounds\b|\bstopped the play\b|\bdead ball\b|\binbound\b|\bno actual play\b",
}
_W = {k: f"regexp_matches(t, '{p}')" for k, p in _NOTE_PATTERNS.items()}
_AWAY, _MISS = f"({_W['bystander']} OR {_W['referee']})", f"({_W['cluster']} OR {_W['merged']} OR {_W['missed_players']})"
_TESTS = {
    "spectator_false_positive": _W["spectator"],
    "bystander_false_positive": _AWAY,
    "false_positive_generic": f"issue_type = 'false_positive' AND NOT {_W['spectator']} AND NOT {_AWAY}",
    "cluster_miss": f"(issue_type = 'false_negative' AND {_MISS}) OR ({_W['missed']} AND {_W['cluster']})",
    "false_negative_generic": f"issue_type = 'false_negative' AND NOT {_MISS}",
    "cluster_merge": f"issue_type = 'merge_error' OR {_W['merge']}",
    "id_switch": f"issue_type = 'track_error' OR {_W['identity']}",
    "uniform_confusion": _W["uniform"],
    "live_play_context": f"issue_type = 'live_play' OR {_W['live']}",
    "dead_ball_context": f"issue_type = 'dead_ball' OR {_W['dead']}",
    "scene_context": "issue_type = 'uncertain_play_state'",
}
_FEEDBACK = (
    f"fb AS (SELECT clip_id, frame_idx % 20 AS frame_idx, t_ms, {_ISSUE_SQL}[v % {len(_ISSUES)} + 1] AS issue_type, {_NOTE_SQL}[v % {len(_NOTES)} + 1] AS note, CASE WHEN v % 4 <> 0 THEN user_id % 12 END AS track_id, CASE WHEN v % 9 <> 0 THEN 'at ' || t_ms END AS timestamp, event_id AS seq FROM ev),"
    + "fc AS (SELECT *, CASE WHEN issue_type = 'general_note' AND len(c0) = 0 THEN ['scene_context'] ELSE list_sort(c0) END AS c FROM (SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _TESTS.items())
    + "], lambda x: x IS NOT NULL) AS c0 FROM (SELECT *, lower(trim(coalesce(note, ''))) AS t FROM fb)))"
)


@query("SELECT seq, array_to_string(c, ',') AS categories FROM fc", _FEEDBACK)
def evt_07_note_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feedback(spark, sf_dir)
    return f.select("seq", F.array_join(review.categories(F.col("issue_type"), F.col("note")), ",").alias("categories"))


_CASES = (
    _FEEDBACK
    + """,
cg AS (SELECT clip_id, frame_idx, min(t_ms) AS t_ms_min, max(t_ms) AS t_ms_max, list_sort(list(DISTINCT issue_type)) AS issue_types, list_sort(list_distinct(flatten(list(c)))) AS categories, list_sort(coalesce(list(DISTINCT track_id::VARCHAR) FILTER (track_id IS NOT NULL), [])) AS track_ids,
              coalesce(list(trim(note) ORDER BY seq) FILTER (length(trim(note)) > 0), []) AS notes, count(*) AS source_count FROM fc GROUP BY ALL)"""
)


@query(
    """SELECT clip_id || ':' || frame_idx AS case_id, t_ms_min, t_ms_max, array_to_string(issue_types, ',') AS issue_types, array_to_string(categories, ',') AS categories, array_to_string(track_ids, ',') AS track_ids, array_to_string(notes, '|') AS notes, source_count,
       CASE WHEN list_contains(categories, 'dead_ball_context') THEN 'dead_ball' WHEN list_contains(categories, 'live_play_context') THEN 'live_play' END AS scene_context FROM cg""",
    _CASES,
)
def agg_10_evt_08_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = lambda c, s=",": F.array_join(c, s).alias(c)
    return review.cases(feedback(spark, sf_dir)).select("case_id", "t_ms_min", "t_ms_max", j("issue_types"), j("categories"), j("track_ids"), j("notes", "|"), "source_count", "scene_context")


_REPORT = f"{_CASES}, {_SUMMARY}, " + """
rp AS (SELECT cg.*, cg.clip_id % 3 <> 0 AS artifact_found, fo.clip_id IS NOT NULL AS frame_found, detections, active, synthesized, speed_max FROM cg LEFT JOIN (SELECT * FROM fo WHERE clip_id % 3 <> 0 AND frame_idx % 4 <> 0) fo USING (clip_id, frame_idx))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = review.frame_summary(boxes(spark, sf_dir)).where("clip_id % 3 <> 0")
    cases = review.cases(feedback(spark, sf_dir)).drop("track_ids")
    return review.case_report(cases, frames.select("clip_id").distinct(), frames.where("frame_idx % 4 <> 0"))


@query("SELECT case_id, artifact_found, frame_found, detections, active FROM (SELECT *, clip_id || ':' || frame_idx AS case_id FROM rp)", _REPORT)
def joi_09_case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("case_id", "artifact_found", "frame_found", "detections", "active")


@query(
    """SELECT category, count(*) AS case_count, count(*) FILTER (artifact_found) AS artifact_found_count, count(*) FILTER (frame_found) AS frame_found_count, sum(coalesce(detections, 0)) AS detection_total, sum(coalesce(active, 0)) AS active_total, sum(coalesce(synthesized, 0)) AS synthesized_total,
       coalesce(max(speed_max), 0.0) AS speed_max_seen, round(sum(coalesce(detections, 0)) / count(*), 3) AS avg_detections, round(sum(coalesce(active, 0)) / count(*), 3) AS avg_active
       FROM (SELECT *, unnest(CASE WHEN len(categories) > 0 THEN categories ELSE ['uncategorized'] END) AS category FROM rp) GROUP BY category""",
    _REPORT,
)
def agg_09_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.category_rollup(_report(spark, sf_dir))


#: Category, place and signal.
_SIG = """(VALUES
    ('spectator_false_positive', 0, 'detection_count'), ('spectator_false_positive', 1, 'active_candidate_count'), ('spectator_false_positive', 2, 'low_motion_detection_count'), ('spectator_false_positive', 3, 'zero_motion_detection_count'), ('spectator_false_positive', 4, 'track_ids'),
    ('bystander_false_positive', 0, 'detection_count'), ('bystander_false_positive', 1, 'active_candidate_count'), ('bystander_false_positive', 2, 'low_motion_detection_count'), ('bystander_false_positive', 3, 'zero_motion_detection_count'), ('bystander_false_positive', 4, 'track_ids'),
    ('false_positive_generic', 0, 'detection_count'), ('false_positive_generic', 1, 'active_candidate_count'), ('false_positive_generic', 2, 'track_ids'),
    ('cluster_miss', 0, 'detection_count'), ('cluster_miss', 1, 'overlap_pair_count'), ('cluster_miss', 2, 'synthesized_detection_count'), ('cluster_miss', 3, 'track_ids'),
    ('cluster_merge', 0, 'detection_count'), ('cluster_merge', 1, 'overlap_pair_count'), ('cluster_merge', 2, 'synthesized_detection_count'), ('cluster_merge', 3, 'track_ids'),
    ('false_negative_generic', 0, 'detection_count'), ('false_negative_generic', 1, 'synthesized_detection_count'), ('false_negative_generic', 2, 'track_ids'),
    ('id_switch', 0, 'track_ids'), ('id_switch', 1, 'canonical_track_ids'), ('id_switch', 2, 'canonical_track_count'), ('id_switch', 3, 'motion_speed_max'), ('id_switch', 4, 'motion_speed_median'), ('id_switch', 5, 'synthesized_detection_count'),
    ('uniform_confusion', 0, 'uniform_bucket_counts'), ('uniform_confusion', 1, 'active_uniform_bucket_counts'), ('uniform_confusion', 2, 'track_ids'),
    ('live_play_context', 0, 'live_play_label'), ('live_play_context', 1, 'live_play_score'), ('live_play_context', 2, 'live_play_segment_label'), ('live_play_context', 3, 'live_play_segment_duration_ms'), ('live_play_context', 4, 'ball_signal_present'), ('live_play_context', 5, 'ball_confidence'), ('live_play_context', 6, 'active_candidate_count'), ('live_play_context', 7, 'motion_speed_max'), ('live_play_context', 8, 'motion_speed_median'), ('live_play_context', 9, 'track_ids'),
    ('dead_ball_context', 0, 'live_play_label'), ('dead_ball_context', 1, 'live_play_score'), ('dead_ball_context', 2, 'live_play_segment_label'), ('dead_ball_context', 3, 'live_play_segment_duration_ms'), ('dead_ball_context', 4, 'ball_signal_present'), ('dead_ball_context', 5, 'ball_confidence'), ('dead_ball_context', 6, 'active_candidate_count'), ('dead_ball_context', 7, 'low_motion_detection_count'), ('dead_ball_context', 8, 'zero_motion_detection_count'), ('dead_ball_context', 9, 'track_ids'),
    ('scene_context', 0, 'detection_count'), ('scene_context', 1, 'active_candidate_count'), ('scene_context', 2, 'track_ids')
) s(category, place, signal)"""


@query(
    f"""SELECT case_id, coalesce(string_agg(signal, ',' ORDER BY k), 'detection_count,active_candidate_count,track_ids') AS signals FROM (
         SELECT case_id, signal, min(n * 100 + place) AS k FROM (SELECT clip_id || ':' || frame_idx AS case_id, unnest(CASE WHEN len(categories) = 0 THEN [NULL] ELSE categories END) AS category, unnest(range(greatest(1, len(categories)))) AS n FROM cg) LEFT JOIN {_SIG} USING (category) GROUP BY ALL) GROUP BY case_id""",
    _CASES,
)
def joi_18_category_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cases(feedback(spark, sf_dir)).select("case_id", F.array_join(review.category_signals(F.col("categories")), ",").alias("signals"))


def reviewed_frames(detections: DataFrame) -> DataFrame:
    """The frames that have a document."""
    return detections.where("clip_id % 7 <> 0 AND frame_idx % 5 <> 0")


#: Why feedback is refused, in order, with the issue types written out.
_PROBLEM = """CASE WHEN timestamp IS NULL THEN 'missing_field'
    WHEN issue_type NOT IN ('false_positive', 'false_negative', 'merge_error', 'track_error', 'live_play', 'dead_ball', 'uncertain_play_state', 'general_note', 'pose_error') THEN 'issue_type'
    WHEN clip_id % 7 = 0 THEN 'clip' WHEN frame_idx % 5 = 0 THEN 'frame' WHEN track_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM det d WHERE d.clip_id = fb.clip_id AND d.frame_idx = fb.frame_idx AND d.track_id = fb.track_id) THEN 'track' END"""


@query(
    f"SELECT seq, {_PROBLEM} AS problem FROM fb",
    _FEEDBACK,
)
def flt_15_feedback_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.detections(spark, sf_dir)
    frames = reviewed_frames(d)
    return review.validated_feedback(feedback(spark, sf_dir), frames, d).select("seq", "problem")


@query(
    """SELECT clip_id, frame_idx, track_id, f.slot AS found_slot FROM (SELECT p.clip_id, p.frame_idx, p.track_id, d AS f FROM ply p JOIN det d ON p.track_id = d.track_id AND p.clip_id = d.clip_id AND abs(p.t_ms - (d.t_ms + d.v % 40)) < 33
       QUALIFY row_number() OVER (PARTITION BY p.clip_id, p.frame_idx, p.track_id ORDER BY d.frame_idx * 10 + d.slot) = 1)"""
)
def joi_01_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = adapter.players(spark, sf_dir).select("clip_id", "frame_idx", (F.col("track_id") + F.col("clip_id") * 100).alias("track_id"), "t_ms")
    found = adapter.detections(spark, sf_dir).select((F.col("track_id") + F.col("clip_id") * 100).alias("track_id"), (F.col("t_ms") + F.col("v") % 40).alias("t_ms"), (F.col("frame_idx") * 10 + F.col("slot")).alias("ord"), "slot")
    m = review.first_match(truth, found).where(F.col("f").isNotNull())
    return m.select("clip_id", "frame_idx", (F.col("track_id") - F.col("clip_id") * 100).alias("track_id"), F.col("f.slot").alias("found_slot"))


@query(
    """SELECT clip_id, count(*) AS n, round(avg(pck), 4) AS mean_pck, round(count(*) FILTER (v % 3 = 0) / count(*), 4) AS id_accuracy FROM (SELECT *, list_avg(list_transform(range(17), lambda j: CASE WHEN abs(((v * j) % 13) / 100.0) < 0.05 THEN 1.0 ELSE 0.0 END)) AS pck FROM det) GROUP BY clip_id"""
)
def agg_15_16_pck(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.sequence(F.lit(0), F.lit(16))
    zero = F.transform(j, lambda k: F.array(F.lit(0.0), F.lit(0.0)))
    moved = F.transform(j, lambda k: F.array((F.col("v") * k % 13) / 100.0, F.lit(0.0)))
    d = adapter.detections(spark, sf_dir).withColumn("pck", review.correct_joints(zero, moved))
    return d.groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.avg("pck"), 4).alias("mean_pck"), F.round(F.count_if(F.col("v") % 3 == 0) / F.count("*"), 4).alias("id_accuracy"))


@query(
    """SELECT m.clip_id, m.moment_id, m.t_ms, f.frame_idx FROM (SELECT clip_id, event_id AS moment_id, v % 1700 AS t_ms FROM ev) m JOIN (SELECT DISTINCT clip_id, frame_idx, t_ms FROM ball) f ON f.clip_id = m.clip_id
       QUALIFY row_number() OVER (PARTITION BY m.moment_id ORDER BY abs(f.t_ms - m.t_ms), f.frame_idx) = 1"""
)
def joi_12_nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = adapter.events(spark, sf_dir).select("clip_id", F.col("event_id").alias("moment_id"), (F.col("v") % 1700).alias("t_ms"))
    return review.nearest_frames(moments, adapter.balls(spark, sf_dir).select("clip_id", "frame_idx", "t_ms"))


_CAL = """cal AS (SELECT clip_id, frame_idx, v + 0.5::DOUBLE AS h0 FROM ev WHERE slot = 0 AND v % 3 = 0 UNION ALL SELECT clip_id, NULL, clip_id + 0.25::DOUBLE FROM ev WHERE event_id % 500 = 0 AND clip_id % 2 = 0)"""


@query("SELECT f.clip_id, f.frame_idx, coalesce(a.h0, b.h0, 1.0) AS h0, coalesce(a.h0, b.h0) AS h0_or_null FROM (SELECT DISTINCT clip_id, frame_idx FROM ev) f LEFT JOIN cal a ON a.clip_id = f.clip_id AND a.frame_idx = f.frame_idx LEFT JOIN cal b ON b.clip_id = f.clip_id AND b.frame_idx IS NULL", _CAL)
def joi_02_03_homography_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapter.events(spark, sf_dir)
    rest = [F.lit(x) for x in geometry.IDENTITY[1:]]
    own = e.where("slot = 0 AND v % 3 = 0").select("clip_id", "frame_idx", F.array(F.col("v") + 0.5, *rest).alias("h"))
    whole = e.where("event_id % 500 = 0 AND clip_id % 2 = 0").select("clip_id", F.lit(None).cast("long").alias("frame_idx"), F.array(F.col("clip_id") + 0.25, *rest).alias("h"))
    frames = e.select("clip_id", "frame_idx").distinct()
    cal = own.union(whole)
    a = calibration.with_homography(frames, cal).select("clip_id", "frame_idx", F.col("h")[0].alias("h0"))
    b = calibration.with_homography(frames, cal, None).select("clip_id", "frame_idx", F.col("h")[0].alias("h0_or_null"))
    return a.join(b, ["clip_id", "frame_idx"])


_NAMES = sorted(geometry.PRIMITIVES)
_PRIM = "(VALUES " + ", ".join(f"('{n}', '{geometry.PRIMITIVES[n][0]}', '{geometry.PRIMITIVES[n][1]}')" for n in _NAMES) + ") p(primitive_id, kind, family)"
_POINTS = f"""pn AS (SELECT clip_id, frame_idx, slot, event_id, x0 AS u, y0 AS v2, coalesce(CASE WHEN v % 5 <> 0 THEN nm END, CASE WHEN v % 7 <> 0 THEN nm ELSE 'nowhere' END) AS primitive_id
    FROM (SELECT *, v * 37 % 500 + 0.0::DOUBLE AS x0, v * 61 % 400 + 0.0::DOUBLE AS y0, [{", ".join(f"'{n}'" for n in _NAMES)}][v % 12 + 1] AS nm FROM ev)),
kp AS (SELECT * FROM pn LEFT JOIN {_PRIM} USING (primitive_id))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked points of court features."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("v") % 12).cast("int") + 1)
    e = adapter.events(spark, sf_dir)
    p = e.select("clip_id", "frame_idx", "slot", F.col("event_id").alias("sample_order"), (F.col("v") * 37 % 500 + 0.0).alias("u"), (F.col("v") * 61 % 400 + 0.0).alias("v"), F.when(F.col("v") % 5 != 0, name).alias("primitive_id"), F.when(F.col("v") % 7 != 0, name).otherwise("nowhere").alias("landmark_id"))
    return calibration.known_points(p, geometry.primitive_rows(spark))


@query(
    """SELECT clip_id, frame_idx, n_points, n_primitives, n_families, n_unknown, CASE WHEN n_unknown > 0 THEN 'unknown_primitive' WHEN n_points < 4 THEN 'too_few_points' WHEN n_primitives < 2 THEN 'too_few_primitives' WHEN n_families < 2 THEN 'too_few_families' END AS problem, n_points >= 4 AND n_families >= 2 AS calibrates
       FROM (SELECT clip_id, frame_idx, count(*) AS n_points, count(DISTINCT primitive_id) AS n_primitives, count(DISTINCT family) AS n_families, count(*) FILTER (family IS NULL) AS n_unknown FROM kp GROUP BY ALL)""",
    _POINTS,
)
def agg_17_flt_14_19_point_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calibration.point_summary(points(spark, sf_dir), "clip_id", "frame_idx")
    return s.withColumn("calibrates", calibration.calibrates(F.col("n_points"), F.col("n_families")))


@query(
    """SELECT clip_id, primitive_id, event_id AS sample_order, row_number() OVER (PARTITION BY clip_id, primitive_id ORDER BY CASE WHEN coalesce(kind, '') <> 'line' AND kind IS NOT NULL THEN event_id::DOUBLE WHEN wide THEN u ELSE v2 END, event_id) - 1 AS place
       FROM (SELECT *, max(u) OVER w - min(u) OVER w >= max(v2) OVER w - min(v2) OVER w AS wide FROM kp WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY clip_id, primitive_id))""",
    _POINTS,
)
def srt_05_agg_18_ordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = calibration.ordered_samples(points(spark, sf_dir).where("kind IS NOT NULL"), "clip_id")
    return p.select("clip_id", "primitive_id", "sample_order", F.col("place").cast("long").alias("place"))


@query(
    "SELECT clip_id, frame_idx, n FROM (SELECT clip_id, frame_idx, count(*) AS n FROM (SELECT DISTINCT clip_id, frame_idx, x, y FROM ply) GROUP BY ALL) WHERE n >= 4"
)
def prj_08_agg_19_fit_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of points under a known homography: frames whose fit returns every point to within 0.01."""
    truth = F.array(*[F.lit(x) for x in [2.0, 0.1, 30.0, 0.05, 1.5, 20.0, 0.0001, 0.0002, 1.0]])
    p = adapter.players(spark, sf_dir).select("clip_id", "frame_idx", "x", "y").distinct()
    t = geometry.floor_point(F.col("x"), F.col("y"), truth)
    c = p.select("clip_id", "frame_idx", F.col("x").alias("u"), F.col("y").alias("v"), t["x"].alias("x"), t["y"].alias("y"))
    b = geometry.floor_point(F.col("u"), F.col("v"), F.col("h"))
    back = c.join(calibration.fits(c), ["clip_id", "frame_idx"]).withColumn("away", F.sqrt((b["x"] - F.col("x")) ** 2 + (b["y"] - F.col("y")) ** 2))
    return back.groupBy("clip_id", "frame_idx").agg(F.count("*").alias("n"), F.max("away").alias("away")).where("away < 0.01").drop("away")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player rows with 17 joints around a slowly moving centre."""
    p = adapter.players(spark, sf_dir)
    pose = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.array(((F.col("v") * (j + 3)) % 100) / 1000.0 + 0.3, ((F.col("v") * (j + 7)) % 140) / 1000.0 + j / 40.0))
    return p.withColumn("pose", pose).withColumn("possession", F.col("v") % 3 == 0)


#: Joints that a name means, and the rules in order of evaluation.
_JOINTS = {"hips": [11, 12], "wrists": [9, 10], "head": [0], "shoulders": [5, 6], "ankles": [15, 16]}
_RULES = [
    ("idle_bystander", "kinematic", False, [("hips", "velocity_z", "<", 0.001)]),
    ("crossover", "kinematic", False, [("wrists", "velocity_x", ">", 0.05)]),
    ("jump_shot", "kinematic", True, [("hips", "velocity_z", ">", 0.02), ("wrists", "pos_y", "<", "head")]),
    ("dunk", "kinematic", False, [("wrists", "pos_y", "<", "head"), ("hips", "velocity_y", "<", -0.05)]),
    ("layup", "kinematic", False, [("wrists", "pos_y", "<", "head")]),
    ("euro_step_left", "kinematic", False, [("hips", "velocity_x", "<", -0.02)]),
    ("euro_step_right", "kinematic", False, [("hips", "velocity_x", ">", 0.02)]),
    ("pass_chest", "kinematic", False, [("wrists", "velocity_z", ">", 0.05)]),
    ("block", "kinematic", False, [("wrists", "pos_y", "<", "head")]),
    ("steal", "kinematic", False, [("wrists", "velocity_x", ">", 0.02)]),
    ("rebound", "kinematic", False, [("wrists", "pos_y", "<", "head"), ("hips", "velocity_y", "<", -0.05)]),
    ("step_back", "kinematic", False, [("hips", "velocity_y", "<", -0.05)]),
    ("travel", "violation", False, [("ankles", "steps_since_dribble", ">", 2)]),
]


def _joint(joint: str, axis: int, p: str) -> str:
    at = _JOINTS[joint]
    return "((" + " + ".join(f"{p}[{k + 1}][{axis + 1}]" for k in at) + f") / {len(at)})"


def _rule_sql(rule: tuple) -> str:
    tests = ["len(ps) >= 15"] + (["possession"] if rule[2] else [])
    for joint, metric, op, value in rule[3]:
        if metric in ("velocity_z", "velocity_y"):
            v = f"({_joint(joint, 1, 'ps[len(ps)]')} - {_joint(joint, 1, 'ps[1]')})"
            tests.append(f"{v} < {-value}" if op == ">" else f"{v} > {value}")
        elif metric == "velocity_x":
            v = f"({_joint(joint, 0, 'ps[len(ps)]')} - {_joint(joint, 0, 'ps[1]')})"
            tests.append(f"{v} > {value}" if op == ">" else f"{v} < {-value}")
        elif metric == "pos_y":
            tests.append(f"len(list_filter(ps, lambda q: {_joint(joint, 1, 'q')} < {_joint(value, 1, 'q')})) / len(ps)::DOUBLE > 0.6")
    return " AND ".join(tests)


WINDOWS = """po AS (SELECT clip_id, track_id, frame_idx, v % 3 = 0 AS possession, list_transform(range(17), lambda j: [((v * (j + 3)) % 100) / 1000.0::DOUBLE + 0.3, ((v * (j + 7)) % 140) / 1000.0::DOUBLE + j / 40.0::DOUBLE]) AS pose FROM ply),
    win AS (SELECT clip_id, track_id, frame_idx, possession, list(pose) OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ps FROM po)"""


@query(
    "SELECT clip_id, track_id, frame_idx, CASE " + " ".join(f"WHEN {_rule_sql(r)} THEN '{r[0]}'" for r in _RULES) + " ELSE 'idle_bystander' END AS label FROM win",
    WINDOWS,
)
def dsl_01_09_behaviour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.with_labels(poses(spark, sf_dir)).select("clip_id", "track_id", "frame_idx", "label")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses(spark, sf_dir)
    wrists = F.array(F.array("x", "y", F.lit(90.0)), F.array(F.col("x") + 10, F.col("y"), F.lit(95.0)))
    return p.select("clip_id", "track_id", "frame_idx", "pose", wrists.alias("wrists"), F.array("x", "y").alias("court"), F.array(F.col("y"), F.col("x")).alias("ball"))


@query(
    """SELECT clip_id, track_id, frame_idx, 30 AS n_rows, 72 AS n_columns, round(s[30].px, 4) AS pose_x, round((s[30].px - s[29].px) * 0.1, 5) AS change_x, 0.0 AS first_change, round(sqrt((s[1].x - y) * (s[1].x - y) + (s[1].y - x) * (s[1].y - x) + 100) * 0.01, 4) AS left_ball, round(s[30].x * 0.001, 4) AS court_x
       FROM (SELECT *, list({'px': (v * 3 % 100) / 1000.0::DOUBLE + 0.3, 'x': x, 'y': y}) OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM ply) WHERE len(s) = 30"""
)
def prj_17_win_07_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, last = F.col("features"), F.col("features")[29]
    d = features.feature_windows(feature_rows(spark, sf_dir)).where(features.shape_ok(f))
    return d.select("clip_id", "track_id", "frame_idx", F.size(f).alias("n_rows"), F.size(last).alias("n_columns"), F.round(last[0], 4).alias("pose_x"), F.round(last[34], 5).alias("change_x"), f[0][34].alias("first_change"), F.round(f[0][68], 4).alias("left_ball"), F.round(last[70], 4).alias("court_x"))


@query("SELECT 'adapter' AS dataset_id, '2.0.0' AS schema_version, count(*) AS sample_count, string_agg(l || '=' || n, ',' ORDER BY l) AS classes, 'pass' AS validation_status FROM (SELECT *, count(*) OVER () AS m FROM (SELECT event_type AS l, count(*) AS n FROM ev GROUP BY ALL))".replace("count(*) AS sample_count", "sum(n)::BIGINT AS sample_count"))
def agg_13_14_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.transform(F.sequence(F.lit(1), F.lit(72)), lambda k: (F.col("v") * k % 10).cast("double"))
    s = adapter.events(spark, sf_dir).select(F.col("event_type").alias("label"), F.array_repeat(row, 30).alias("features"))
    m = features.manifest(s, "adapter")
    classes = F.array_join(F.transform(F.array_sort(F.map_entries("class_distribution")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return m.select("dataset_id", "schema_version", "sample_count", classes.alias("classes"), "validation_status")


@query("SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS index FROM (SELECT DISTINCT event_type FROM ev)")
def src_10_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.label_index(adapter.events(spark, sf_dir).select(F.col("event_type").alias("label")))
    return out.select("label", F.col("index").cast("long").alias("index"))


@query("SELECT d.clip_id, d.frame_idx, d.slot, t.team FROM det d LEFT JOIN (SELECT DISTINCT track_id, team FROM det WHERE track_id < 9) t USING (track_id)")
def joi_16_team_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.detections(spark, sf_dir)
    teams = d.where("track_id < 9").select("track_id", "team").distinct()
    return d.drop("team").join(teams, "track_id", "left").select("clip_id", "frame_idx", "slot", "team")
