"""Queries of track, continuity and live-play operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import continuity, liveplay, tracks
from . import adapter
from .registry import query


def _r(name: str, alias: str | None = None):
    return F.round(name, 4).alias(alias or name)


@query("SELECT clip_id, track_id, count(DISTINCT frame_idx) AS n_frames FROM det GROUP BY ALL")
def agg_04_track_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.frame_counts(adapter.detections(spark, sf_dir))


@query("SELECT clip_id, frame_idx, slot, conf FROM det QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY conf DESC, slot) = 1")
def agg_20_best_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.best_ball(adapter.detections(spark, sf_dir), "slot").select("clip_id", "frame_idx", "slot", "conf")


@query(
    "SELECT clip_id, track_id, frame_idx, round(s, 4) AS smooth FROM k",
    """z AS (SELECT clip_id, track_id, frame_idx, x AS z, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx) AS n FROM ply),
    k AS (SELECT clip_id, track_id, frame_idx, n, z AS s, 1.0::DOUBLE AS p FROM z WHERE n = 1
          UNION ALL SELECT z.clip_id, z.track_id, z.frame_idx, z.n, k.s + (k.p + 1e-4) / (k.p + 1e-4 + 1e-2) * (z.z - k.s), (1 - (k.p + 1e-4) / (k.p + 1e-4 + 1e-2)) * (k.p + 1e-4)
          FROM k JOIN z ON z.clip_id = k.clip_id AND z.track_id = k.track_id AND z.n = k.n + 1)""",
    recursive=True,
)
def sts_01_kalman_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.kalman_1d(adapter.players(spark, sf_dir), "x").select("clip_id", "track_id", "frame_idx", _r("smooth"))


_DT = "(1.0::DOUBLE / 30.0)"
_KALMAN = f"""o AS (SELECT clip_id, track_id, frame_idx, x, y, w, h, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx) AS n FROM ply),
    k AS (
        SELECT clip_id, track_id, frame_idx, n, x AS sx, y AS sy, 0.0::DOUBLE AS svx, 0.0::DOUBLE AS svy, 25.0::DOUBLE AS a, 0.0::DOUBLE AS b, 25.0::DOUBLE AS e FROM o WHERE n = 1
        UNION ALL
        SELECT clip_id, track_id, frame_idx, n, px + a1 / (a1 + 9) * (x - px), py + a1 / (a1 + 9) * (y - py), svx + b1 / (a1 + 9) * (x - px), svy + b1 / (a1 + 9) * (y - py), (1 - a1 / (a1 + 9)) * a1, (1 - a1 / (a1 + 9)) * b1, e1 - b1 / (a1 + 9) * b1
        FROM (SELECT o.clip_id, o.track_id, o.frame_idx, o.n, o.x, o.y, k.svx, k.svy, k.sx + {_DT} * k.svx AS px, k.sy + {_DT} * k.svy AS py,
                     k.a + 2 * {_DT} * k.b + {_DT} * {_DT} * k.e + 1 AS a1, k.b + {_DT} * k.e AS b1, k.e + 4 AS e1
              FROM k JOIN o ON o.clip_id = k.clip_id AND o.track_id = k.track_id AND o.n = k.n + 1)
    )"""


@query("SELECT clip_id, track_id, frame_idx, round(sx, 3) AS sx, round(sy, 3) AS sy, round(svx, 3) AS svx, round(svy, 3) AS svy FROM k", _KALMAN, recursive=True)
def sts_02_kalman_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tracks.kalman_2d(adapter.players(spark, sf_dir), adapter.FPS)
    return k.select("clip_id", "track_id", "frame_idx", *[F.round(c, 3).alias(c) for c in ("sx", "sy", "svx", "svy")])


@query(
    """SELECT clip_id, track_id, frame_idx, round(coalesce((w + lag(w) OVER t) * 0.5, w), 4) AS sw, round(coalesce((h + lag(h) OVER t) * 0.5, h), 4) AS sh, round(sqrt(svx * svx + svy * svy), 3) AS motion_speed
       FROM k JOIN o USING (clip_id, track_id, frame_idx) WINDOW t AS (PARTITION BY clip_id, track_id ORDER BY frame_idx)""",
    _KALMAN,
    recursive=True,
)
def win_09_smooth_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks.smooth_motion(adapter.players(spark, sf_dir), adapter.FPS)
    return s.select("clip_id", "track_id", "frame_idx", _r("sw"), _r("sh"), F.round("motion_speed", 3).alias("motion_speed"))


@query(
    """SELECT clip_id, track_id, frame_idx, len(l) AS n, l[1] AS oldest, len(l) = 30 AS is_ready FROM (SELECT clip_id, track_id, frame_idx, list(x) OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM ply)"""
)
def win_05_flt_21_last_30_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks.trailing(adapter.players(spark, sf_dir), "x", 30, "l")
    return d.select("clip_id", "track_id", "frame_idx", F.size("l").cast("long").alias("n"), F.col("l")[0].alias("oldest"), (F.size("l") == 30).alias("is_ready"))


@query(
    """SELECT clip_id, track_id, frame_idx, CASE WHEN n >= 10 THEN b.z END AS apex_z, CASE WHEN n >= 10 THEN b.f END AS apex_frame
       FROM (SELECT clip_id, track_id, frame_idx, max({'z': y, 'f': frame_idx}) OVER t AS b, count(*) OVER t AS n FROM ply WINDOW t AS (PARTITION BY clip_id, track_id ORDER BY frame_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
)
def win_06_agg_21_apex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.apex(adapter.players(spark, sf_dir), "y").select("clip_id", "track_id", "frame_idx", "apex_z", "apex_frame")


_GAPS = """act AS (SELECT *, v % 3 <> 0 AS active FROM ply),
    nxt AS (SELECT *, lead(frame_idx) OVER t AS nf, lead(x) OVER t AS nx, lead(y) OVER t AS ny, lead(w) OVER t AS nw, lead(h) OVER t AS nh, lead(active) OVER t AS na FROM act WINDOW t AS (PARTITION BY clip_id, track_id ORDER BY frame_idx)),
    made AS (SELECT clip_id, track_id, f AS frame_idx, x + (nx - x) * al AS x, y + (ny - y) * al AS y, w + (nw - w) * al AS w, h + (nh - h) * al AS h
             FROM (SELECT *, (f - frame_idx) / (nf - frame_idx)::DOUBLE AS al FROM (SELECT *, unnest(range(frame_idx + 1, nf)) AS f FROM nxt WHERE active AND na AND nf - frame_idx - 1 BETWEEN 1 AND 3)))"""


@query("SELECT clip_id, track_id, frame_idx, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM made", _GAPS)
def sts_09_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.players(spark, sf_dir).withColumn("active", F.col("v") % 3 != 0)
    return tracks.fill_gaps(rows).select("clip_id", "track_id", "frame_idx", *map(_r, "xywh"))


@query("SELECT clip_id, synthesized, count(*) AS n, sum(frame_idx) AS frames FROM (SELECT clip_id, frame_idx, false AS synthesized FROM act UNION ALL SELECT clip_id, frame_idx, true FROM made) GROUP BY ALL", _GAPS)
def set_04_observed_and_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.players(spark, sf_dir).withColumn("active", F.col("v") % 3 != 0)
    return tracks.repaired(rows).groupBy("clip_id", "synthesized").agg(F.count("*").alias("n"), F.sum("frame_idx").alias("frames"))


def signed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with tracks, counts, and an eight-value signature."""
    f = continuity.frame_tracks(adapter.detections(spark, sf_dir))
    e = adapter.events(spark, sf_dir).where("slot = 0").select("clip_id", "frame_idx", F.col("v").alias("v0"))
    return f.join(e, ["clip_id", "frame_idx"]).withColumn("signature", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.floor(F.col("v0") / 700) * k * 7 % 10) / 10.0))


_CONT = """ft AS (SELECT clip_id, frame_idx, list_sort(list(DISTINCT track_id)) AS tracks, count(*) AS n FROM det GROUP BY ALL),
    sg AS (SELECT ft.*, list_transform(range(1, 9), lambda k: (v // 700 * k * 7 % 10) / 10.0::DOUBLE) AS s FROM ft JOIN ev USING (clip_id, frame_idx) WHERE ev.slot = 0),
    pv AS (SELECT *, lag(tracks) OVER w AS pt, lag(s) OVER w AS ps, lag(n) OVER w AS pn FROM sg WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
    dl AS (SELECT *, CASE WHEN pn IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, 9), lambda k: abs(s[k] - ps[k]))) / 8 END AS visual_delta,
                  CASE WHEN pn IS NULL THEN 0.0 ELSE 1.0 - len(list_intersect(tracks, pt)) / len(list_distinct(list_concat(tracks, pt)))::DOUBLE END AS churn, CASE WHEN pn IS NULL THEN 0 ELSE abs(n - pn) END AS count_delta FROM pv),
    ds AS (SELECT *, 0.6 * least(1.0, visual_delta / 0.28) + 0.3 * least(1.0, churn / 0.8) + 0.1 * least(1.0, count_delta / 6.0::DOUBLE) AS d FROM dl),
    br AS (SELECT *, pn IS NOT NULL AND (d >= 0.72 OR (visual_delta >= 0.28 AND churn >= 0.55)) AS breaks FROM ds)"""


@query("SELECT clip_id, frame_idx, round(visual_delta, 4) AS visual_delta, round(churn, 4) AS churn, count_delta, round(d, 4) AS discontinuity, breaks, sum(breaks::BIGINT) OVER (PARTITION BY clip_id ORDER BY frame_idx)::BIGINT AS continuity_segment FROM br", _CONT)
def win_01_02_joi_19_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = continuity.with_segments(signed_frames(spark, sf_dir))
    return d.select("clip_id", "frame_idx", _r("visual_delta"), _r("churn"), "count_delta", _r("discontinuity"), "breaks", "continuity_segment")


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with metrics, score and label."""
    d = adapter.detections(spark, sf_dir).selectExpr(
        "clip_id", "frame_idx", "v % 4 <> 0 AS active", "speed / 3.1 AS speed", "vx", "vy", "CASE WHEN court_x IS NULL THEN NULL ELSE court_x BETWEEN 0 AND 2600 END AS in_bounds", "x < 40 OR x > 460 AS edge", "v % 9 = 0 AS mismatch", "synthesized AS changed"
    )
    m = liveplay.frame_metrics(d).withColumn("t_ms", F.floor(F.col("frame_idx") * 1000 / 30))
    return liveplay.with_score(m.join(adapter.balls(spark, sf_dir).select("clip_id", "frame_idx", F.col("conf").alias("ball_conf")), ["clip_id", "frame_idx"], "left"))


_SCORES = """lm AS (
    SELECT clip_id, frame_idx, count(*) AS n, count(*) FILTER (active) AS a, count(*) FILTER (active AND coalesce(court_x BETWEEN 0 AND 2600, true)) AS on_court, coalesce(sum(speed / 3.1) FILTER (active), 0) AS speed_sum,
           coalesce(median(speed / 3.1) FILTER (active), 0) AS speed_median, count(*) FILTER (active AND speed / 3.1 >= 18) AS fast, coalesce(median(vx) FILTER (active), 0) AS vx_median, coalesce(median(abs(vy)) FILTER (active), 0) AS vy_abs_median,
           count(*) FILTER (active AND vx > 0) AS rt, count(*) FILTER (active AND vx < 0) AS lt, count(*) FILTER (active AND (x < 40 OR x > 460)) AS edge, count(*) FILTER (active AND v % 9 = 0) AS mismatch, count(*) FILTER (synthesized) AS changed
    FROM (SELECT *, v % 4 <> 0 AS active FROM det) GROUP BY ALL),
lp AS (SELECT lm.*, ball.conf AS ball_conf, greatest(0, least(1, (CASE WHEN a > 0 THEN greatest(rt, lt) / a::DOUBLE ELSE 0 END - 0.8) / 0.2)) * least(1, abs(vx_median) / 120.0) * greatest(0, least(1, 1 - vy_abs_median / 40.0)) AS pan
       FROM lm LEFT JOIN ball USING (clip_id, frame_idx)),
lc AS (SELECT *, greatest(0.05, 1 - 0.95 * pan) AS calm, least(1, changed / greatest(n, 1)::DOUBLE) AS ch FROM lp),
lr AS (SELECT *, greatest(0, least(1, 0.5 + 0.5 * (
        (0.30 * greatest(0, least(1, (on_court - 1) / 3.0::DOUBLE)) + 0.25 * least(1, speed_sum / 180.0) * calm + 0.20 * least(1, speed_median / 40.0) * calm + 0.15 * least(1, fast / 2.0::DOUBLE) * calm + 0.08 * (1 - ch) + CASE WHEN coalesce(ball_conf, 0) >= 0.35 THEN 0.02 ELSE 0 END)
      - (0.25 * (1 - greatest(0, least(1, (on_court - 1) / 2.0::DOUBLE))) + 0.15 * (1 - least(1, speed_sum / 80.0)) + 0.15 * least(1, CASE WHEN a > 0 THEN edge / a::DOUBLE ELSE 1 END) + 0.10 * least(1, CASE WHEN a > 0 THEN mismatch / a::DOUBLE ELSE 0 END) + 0.10 * ch + 0.35 * pan)))) AS raw FROM lc),
ls AS (SELECT *, CAST(floor(frame_idx * 1000 / 30) AS BIGINT) AS t_ms, round(raw, 4) AS score, CASE WHEN raw >= 0.62 THEN 'live_play' WHEN raw <= 0.38 THEN 'dead_ball' ELSE 'uncertain' END AS label FROM lr)"""


@query(
    "SELECT clip_id, frame_idx, n, a, on_court, round(speed_sum, 4) AS speed_sum, round(speed_median, 4) AS speed_median, fast, round(vx_median, 4) AS vx_median, round(vy_abs_median, 4) AS vy_abs_median, round(pan, 4) AS pan, score, label FROM ls", _SCORES
)
def sco_03_agg_05_live_play_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_scores(spark, sf_dir).select("clip_id", "frame_idx", "n", "a", "on_court", _r("speed_sum"), _r("speed_median"), "fast", _r("vx_median"), _r("vy_abs_median"), _r("pan"), "score", "label")


_STATE = (
    _SCORES
    + """,
sc AS (SELECT clip_id, frame_idx, score, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS n FROM ls),
wn AS (SELECT *, count(*) OVER w5 AS n5, count(*) OVER w8 AS n8, avg(score) OVER w5 AS a5, avg(score) OVER w8 AS a8, count(*) FILTER (score >= 0.55) OVER w5 AS hi5, count(*) FILTER (score <= 0.45) OVER w5 AS lo5, count(*) FILTER (score <= 0.45) OVER w8 AS lo8
       FROM sc WINDOW w5 AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
fl AS (SELECT *, a5 >= 0.62 OR hi5 >= 2 AS stays, n5 >= 3 AND a5 >= 0.62 AND hi5 >= 3 AS enters, n8 >= 6 AND a8 <= 0.38 AND lo8 >= 6 AS leaves, n5 >= 3 AND a5 <= 0.38 AND lo5 >= 3 AS dies FROM wn),
st AS (
    SELECT clip_id, frame_idx, n, CASE WHEN enters THEN 'live_play' WHEN dies THEN 'dead_ball' ELSE 'uncertain' END AS state FROM fl WHERE n = 1
    UNION ALL SELECT f.clip_id, f.frame_idx, f.n, CASE WHEN st.state = 'live_play' THEN CASE WHEN f.leaves THEN 'dead_ball' WHEN NOT f.stays THEN 'uncertain' ELSE 'live_play' END WHEN f.enters THEN 'live_play' WHEN f.dies THEN 'dead_ball' ELSE 'uncertain' END
    FROM st JOIN fl f ON f.clip_id = st.clip_id AND f.n = st.n + 1
)"""
)


@query("SELECT clip_id, frame_idx, state FROM st", _STATE, recursive=True)
def sts_04_win_03_live_play_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveplay.with_state(frame_scores(spark, sf_dir)).select("clip_id", "frame_idx", "state")


_SEGMENTS = _SCORES + """,
nw AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY clip_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS b FROM ls),
sn AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY frame_idx)::BIGINT - 1 AS segment FROM nw)"""


@query(
    """SELECT clip_id, segment, any_value(label) AS label, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS n, round(avg(score), 4) AS mean_score, max(score) AS peak_score,
       CASE any_value(label) WHEN 'live_play' THEN CASE WHEN count(*) FILTER (coalesce(ball_conf, 0) >= 0.35) >= greatest(2, count(*) // 3) THEN 'ball_and_on_court_motion' WHEN sum(speed_sum) >= sum(on_court) * 20 THEN 'on_court_motion' ELSE 'stable_on_court_presence' END
            WHEN 'dead_ball' THEN CASE WHEN sum(speed_sum) <= sum(on_court) * 12 THEN 'low_on_court_motion' ELSE 'edge_heavy_idle_scene' END ELSE 'mixed_evidence' END AS dominant
       FROM sn GROUP BY clip_id, segment""",
    _SEGMENTS,
)
def win_04_agg_11_12_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveplay.segments(frame_scores(spark, sf_dir))


@query("SELECT clip_id, frame_idx, label, min(frame_idx) OVER s AS segment_first, max(frame_idx) OVER s AS segment_last, max(t_ms) OVER s - min(t_ms) OVER s AS segment_ms FROM sn WINDOW s AS (PARTITION BY clip_id, segment)", _SEGMENTS)
def joi_10_13_segment_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveplay.with_own_segment(frame_scores(spark, sf_dir)).select("clip_id", "frame_idx", "label", "segment_first", "segment_last", "segment_ms")
