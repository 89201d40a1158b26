"""Queries of identity, appearance, jersey and ledger operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import appearance, identity, ledger
from ..operators.policy import IdentityPolicy
from ..sources.storage import saved
from . import adapter
from .geometry import _DR
from .registry import query

POLICY = IdentityPolicy()


def short_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tracks (one per user and clip) close to each other, for identity links."""
    e = adapter.events(spark, sf_dir).where("slot <> 0").select("clip_id", "frame_idx", "slot", "user_id", "v")
    # a clip's events go to one task while they are narrow; what follows by clip needs no further exchange
    dealt = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip_id")
    return adapter.lowest_slot(dealt, "clip_id", "frame_idx", "user_id").selectExpr(
        "clip_id", "frame_idx", "user_id AS track_id", "v * 37 % 80 + 0.0D AS x", "v * 61 % 60 + 0.0D AS y", "40 + v * 7 % 20 + 0.0D AS w", "90 + v * 11 % 40 + 0.0D AS h", "(v * 3 % 400 - 200) / 7.0D AS vx", "(v * 19 % 160 - 80) / 7.0D AS vy",
        "CASE WHEN v % 7 = 0 THEN NULL ELSE v * 29 % 300 + 0.0D END AS court_x", "CASE WHEN v % 7 = 0 THEN NULL ELSE v * 17 % 150 + 0.0D END AS court_y",
        "CASE v % 5 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' WHEN 2 THEN NULL ELSE 'unknown' END AS uniform", "(50 + v * 13 % 50) / 100.0D AS conf", "v % 9 <> 0 AS active", "frame_idx div 25 AS segment",
    )


_TAILS = """sh AS (
    SELECT clip_id, frame_idx, user_id AS track_id, v * 37 % 80 + 0.0::DOUBLE AS x, v * 61 % 60 + 0.0::DOUBLE AS y, 40 + v * 7 % 20 + 0.0::DOUBLE AS w, 90 + v * 11 % 40 + 0.0::DOUBLE AS h, (v * 3 % 400 - 200) / 7.0::DOUBLE AS vx, (v * 19 % 160 - 80) / 7.0::DOUBLE AS vy,
           CASE WHEN v % 7 = 0 THEN NULL ELSE v * 29 % 300 + 0.0::DOUBLE END AS cx, CASE WHEN v % 7 = 0 THEN NULL ELSE v * 17 % 150 + 0.0::DOUBLE END AS cy, CASE v % 5 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' WHEN 2 THEN NULL ELSE 'unknown' END AS uniform,
           (50 + v * 13 % 50) / 100.0::DOUBLE AS conf, v % 9 <> 0 AS active, frame_idx // 25 AS segment
    FROM ev WHERE slot <> 0 QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx, user_id ORDER BY slot) = 1),
hd AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx) = 1),
tl AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx DESC) = 1),
pr AS (SELECT a.clip_id, a.track_id AS pred, b.track_id AS succ, b.frame_idx - a.frame_idx - 1 AS gap, a.frame_idx AS end_frame, b.frame_idx AS start_frame, a.segment = b.segment AS same,
           greatest(40.0, 1.35 * (a.h + b.h) / 2) AS lim, (least(a.w, b.w) / greatest(a.w, b.w) + least(a.h, b.h) / greatest(a.h, b.h)) / 2 AS size,
           sqrt((a.x + a.vx * (b.frame_idx - a.frame_idx) * (1.0::DOUBLE / 30) - b.x) * (a.x + a.vx * (b.frame_idx - a.frame_idx) * (1.0::DOUBLE / 30) - b.x) + (a.y + a.vy * (b.frame_idx - a.frame_idx) * (1.0::DOUBLE / 30) - b.y) * (a.y + a.vy * (b.frame_idx - a.frame_idx) * (1.0::DOUBLE / 30) - b.y)) AS dist,
           sqrt(a.vx * a.vx + a.vy * a.vy) AS sa, sqrt(b.vx * b.vx + b.vy * b.vy) AS sb, a.vx * b.vx + a.vy * b.vy AS dot, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS oc,
           a.uniform AS ua, b.uniform AS ub, least(a.conf, b.conf) AS conf, a.active AND b.active AS active
       FROM tl a JOIN hd b ON a.clip_id = b.clip_id AND a.track_id <> b.track_id AND b.frame_idx - a.frame_idx - 1 BETWEEN 1 AND 3),
sc AS (SELECT *, round(0.34 * greatest(0, least(1, 1 - dist / lim)) + 0.18 * CASE WHEN sa > 1 AND sb > 1 THEN greatest(0, least(1, (dot / (sa * sb) + 1) / 2)) ELSE 0.5 END + 0.14 * size
           + 0.14 * CASE WHEN ua IS NULL OR ub IS NULL THEN 0 WHEN ua IN ('dark', 'light') AND ub IN ('dark', 'light') AND ua = ub THEN 1 WHEN ua = 'unknown' OR ub = 'unknown' THEN 0.55 ELSE 0 END
           + 0.10 * CASE WHEN oc IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - oc / 260.0)) END + 0.06 * greatest(0, least(1, 1 - (gap - 1) / 3.0::DOUBLE)) + 0.04 * conf, 4) AS score
       FROM pr WHERE active AND NOT coalesce(ua IN ('dark', 'light') AND ub IN ('dark', 'light') AND ua <> ub, false) AND dist <= lim AND size >= 0.55 AND coalesce(oc <= 260, true)),
hy AS (SELECT clip_id, pred, succ, gap, end_frame, start_frame, score, same FROM sc WHERE score >= 0.55),
lk AS (SELECT * FROM hy WHERE same AND score >= 0.72),
sl AS (SELECT a.* FROM lk a WHERE a.score - 0.05 > coalesce((SELECT max(b.score) FROM lk b WHERE b.clip_id = a.clip_id AND (b.pred = a.pred OR b.succ = a.succ) AND (b.pred <> a.pred OR b.succ <> a.succ)), 0.0))"""


@query("SELECT clip_id, pred, succ, gap, score FROM lk", _TAILS)
def joi_06_sco_04_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = identity.candidates(short_tracks(spark, sf_dir), POLICY.link)
    return c.select("clip_id", "pred", "succ", F.col("gap").cast("long").alias("gap"), "score")


@query("SELECT clip_id, pred, succ, gap, score FROM hy", _TAILS)
def joi_07_hypothesis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = identity.candidates(short_tracks(spark, sf_dir), POLICY.hypothesis, same_segment=False)
    return c.select("clip_id", "pred", "succ", F.col("gap").cast("long").alias("gap"), "score")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.selected(identity.candidates(short_tracks(spark, sf_dir), POLICY.link))


@query("SELECT clip_id, pred, succ, score FROM sl", _TAILS)
def sco_05_win_10_selected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("clip_id", "pred", "succ", "score")


@query(
    """SELECT clip_id, group_pred, group_succ, rank, pred, succ, gap, score, round(best - score, 4) AS margin, CASE WHEN sel THEN 'selected' WHEN anys THEN 'alternate' ELSE 'deferred' END AS status,
              CASE WHEN NOT anys THEN 'deferred' WHEN other >= best - 0.05 THEN 'ambiguous_selected' ELSE 'selected' END AS group_status, candidates
       FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, group_pred, group_succ ORDER BY score DESC, gap, succ, pred) AS rank, max(score) OVER g AS best, bool_or(sel) OVER g AS anys, coalesce(max(CASE WHEN NOT sel THEN score END) OVER g, 0.0) AS other, count(*) OVER g AS candidates
             FROM (SELECT h.*, r.root // 1000 AS group_pred, r.root % 1000 AS group_succ, EXISTS (SELECT 1 FROM sl WHERE sl.clip_id = h.clip_id AND sl.pred = h.pred AND sl.succ = h.succ) AS sel
                   FROM hy h JOIN (SELECT clip_id, node, min(root) AS root FROM cc GROUP BY ALL) r ON r.clip_id = h.clip_id AND r.node = h.pred * 1000 + h.succ)
             WINDOW g AS (PARTITION BY clip_id, group_pred, group_succ)) WHERE rank <= 3""",
    _TAILS
    + """,
cc AS (SELECT clip_id, pred * 1000 + succ AS node, pred * 1000 + succ AS root FROM hy
       UNION SELECT h.clip_id, h.pred * 1000 + h.succ, cc.root FROM cc JOIN hy h ON h.clip_id = cc.clip_id AND (h.pred = cc.node // 1000 OR h.succ = cc.node % 1000))""",
    recursive=True,
)
def sco_06_srt_04_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = identity.candidates(short_tracks(spark, sf_dir), POLICY.hypothesis, same_segment=False)
    c = c.select("clip_id", "pred", "succ", F.col("gap").cast("long").alias("gap"), "score", (F.col("same_segment") & (F.col("score") >= POLICY.link)).alias("linked"))
    return identity.hypotheses(saved(identity.with_labels(c, POLICY.top)))


_CHAINS = _TAILS + """,
rk AS (SELECT clip_id, pred, succ, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, gap, succ) AS r FROM sl),
cn AS (SELECT clip_id, succ AS track_id, pred AS canonical, r, 0 AS depth FROM rk UNION ALL SELECT cn.clip_id, cn.track_id, rk.pred, rk.r, depth + 1 FROM cn JOIN rk ON rk.clip_id = cn.clip_id AND rk.succ = cn.canonical AND rk.r < cn.r),
fn AS (SELECT clip_id, track_id, canonical FROM cn QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY depth DESC) = 1)"""


@query("SELECT clip_id, track_id, canonical FROM fn", _CHAINS, recursive=True)
def sts_10_canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_ids(_links(spark, sf_dir))


@query(
    """SELECT m.clip_id, m.identity, m.frame_idx, round(ax + (bx - ax) * (m.frame_idx - fa) / (fb - fa), 4) AS x, round(ay + (b_y - ay) * (m.frame_idx - fa) / (fb - fa), 4) AS y, round(aw + (bw - aw) * (m.frame_idx - fa) / (fb - fa), 4) AS w, round(ah + (bh - ah) * (m.frame_idx - fa) / (fb - fa), 4) AS h
       FROM (SELECT l.clip_id, fn.canonical AS identity, unnest(range(a.frame_idx + 1, b.frame_idx)) AS frame_idx, a.frame_idx AS fa, b.frame_idx AS fb, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS b_y, a.w AS aw, b.w AS bw, a.h AS ah, b.h AS bh
             FROM sl l JOIN tl a ON a.clip_id = l.clip_id AND a.track_id = l.pred JOIN hd b ON b.clip_id = l.clip_id AND b.track_id = l.succ JOIN fn ON fn.clip_id = l.clip_id AND fn.track_id = l.succ) m
       WHERE NOT EXISTS (SELECT 1 FROM sh LEFT JOIN fn USING (clip_id, track_id) WHERE sh.clip_id = m.clip_id AND coalesce(canonical, track_id) = m.identity AND sh.frame_idx = m.frame_idx)""",
    _CHAINS,
    recursive=True,
)
def sts_10_bridged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated rows of each link's gap, under the canonical identity."""
    rows = saved(short_tracks(spark, sf_dir))  # ends, links and seen frames all read them, and three steps read the links
    links = saved(identity.selected(identity.candidates(rows, POLICY.link)))
    made = identity.bridged(rows, links)
    return made.select("clip_id", "identity", "frame_idx", *[F.round(c, 4).alias(c) for c in "xywh"])


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with boxes, histograms and what the active-player score needs."""
    return adapter.detections(spark, sf_dir).selectExpr(
        "*", "x - 20 AS x1", "y AS y1", "x + 20 AS x2", "y + h AS y2", "CASE WHEN v % 6 = 0 THEN NULL ELSE (v * 23 % 97) / 97.0D END AS appearance_distance",
        "CASE WHEN v % 8 = 0 THEN NULL ELSE transform(sequence(1, 8), k -> ((v * k * 7) % 16 + 1) / 64.0D) END AS hist",
    ).withColumn("speed", F.col("speed") / 7.0)


_PEOPLE = """cnt AS (SELECT clip_id, track_id, count(DISTINCT frame_idx) AS n_frames FROM det GROUP BY ALL),
pp AS (SELECT det.* EXCLUDE (speed), speed / 7.0::DOUBLE AS speed, n_frames, x - 20 AS x1, y AS y1, x + 20 AS x2, y + h AS y2, CASE WHEN v % 6 = 0 THEN NULL ELSE (v * 23 % 97) / 97.0::DOUBLE END AS far,
            CASE WHEN v % 8 = 0 THEN NULL ELSE list_transform(range(1, 9), lambda k: ((v * k * 7) % 16 + 1) / 64.0::DOUBLE) END AS hist FROM det JOIN cnt USING (clip_id, track_id)),
eg AS (SELECT *, CASE WHEN x1 < 38.4 OR x2 > 640 - 38.4 THEN 0.15 ELSE 0.0 END + CASE WHEN y1 < 28.8 OR y2 > 480 - 28.8 THEN 0.05 ELSE 0.0 END AS edge, court_x BETWEEN -50 AND 2890 AND court_y BETWEEN -50 AND 1575 AS inb FROM pp),
act AS (SELECT *, round(greatest(0, least(1, 0.35 * conf + 0.20 * greatest(0, least(1, ((y2 - y1) / 480 - 0.08) / 0.18)) - edge + CASE WHEN inb IS NULL THEN 0 WHEN inb THEN 0.20 ELSE -0.20 END + 0.10 * least(n_frames, 5) / 5.0 + 0.15 * least(1, speed / 6.0)
            - CASE WHEN far > 0.42 AND speed <= 3 AND edge >= 0.15 THEN 0.14 * least(1, (far - 0.42) / 0.58) ELSE 0 END)), 4) AS score FROM eg)"""


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import frame_counts

    d = people(spark, sf_dir)
    return appearance.with_active(d, frame_counts(d), adapter.WIDTH, adapter.HEIGHT)


@query("SELECT clip_id, frame_idx, slot, score, inb AS in_bounds, round(edge, 4) AS edge FROM act", _PEOPLE)
def sco_01_02_active_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir).select("clip_id", "frame_idx", "slot", "active.score", "active.in_bounds", F.round("active.edge", 4).alias("edge"))


_PROTO = _PEOPLE + """,
pt AS (SELECT clip_id, CASE WHEN uniform IN ('dark', 'light') THEN uniform ELSE 'unknown' END AS bucket, list_transform(range(1, 9), lambda k: avg_list[k]) AS prototype
       FROM (SELECT clip_id, uniform, [""" + ", ".join(f"avg(hist[{k}])" for k in range(1, 9)) + """] AS avg_list FROM act WHERE hist IS NOT NULL AND score >= 0.55 AND speed >= 3 AND coalesce(inb, true) AND edge < 0.15 GROUP BY ALL))"""


@query("SELECT clip_id, bucket, round(prototype[1], 6) AS p1, round(prototype[4], 6) AS p4, round(prototype[8], 6) AS p8 FROM pt", _PROTO)
def agg_06_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("prototype")
    return appearance.prototypes(_active(spark, sf_dir)).select("clip_id", "bucket", F.round(p[0], 6).alias("p1"), F.round(p[3], 6).alias("p4"), F.round(p[7], 6).alias("p8"))


@query(
    """SELECT clip_id, frame_idx, slot, bucket AS team_bucket, round(d, 4) AS team_distance FROM (
         SELECT act.clip_id, frame_idx, slot, bucket, round(1 - list_sum(list_transform(range(1, 9), lambda k: least(hist[k], prototype[k]))), 6) AS d, CASE WHEN bucket = uniform THEN 0 ELSE list_position(['dark', 'light', 'unknown'], bucket) END AS r
         FROM act LEFT JOIN pt ON pt.clip_id = act.clip_id AND hist IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx, slot ORDER BY d, r) = 1""",
    _PROTO,
)
def joi_11_sco_12_nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _active(spark, sf_dir)
    return appearance.with_team(d, appearance.prototypes(d)).select("clip_id", "frame_idx", "slot", "team_bucket", F.round("team_distance", 4).alias("team_distance"))


@query("SELECT clip_id, CASE WHEN v % 256 >= 150 THEN 'light' WHEN v % 256 <= 95 THEN 'dark' ELSE 'unknown' END AS bucket, count(*) AS n FROM det GROUP BY ALL")
def prj_26_uniform_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.detections(spark, sf_dir).groupBy("clip_id", appearance.uniform_bucket(F.col("v") % 256).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "SELECT clip_id, frame_idx, " + ", ".join(f"round(count(*) FILTER ((CASE WHEN v % 256 >= 128 THEN 4 ELSE 0 END + CASE WHEN v * 3 % 256 >= 128 THEN 2 ELSE 0 END + CASE WHEN v * 5 % 256 >= 128 THEN 1 ELSE 0 END) = {k}) / count(*)::DOUBLE, 6) AS b{k}" for k in range(8)) + " FROM det GROUP BY ALL"
)
def prj_28_colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = appearance.colour_histogram(F.col("v") % 256, F.col("v") * 3 % 256, F.col("v") * 5 % 256)
    return adapter.detections(spark, sf_dir).groupBy("clip_id", "frame_idx").agg(h.alias("h")).select("clip_id", "frame_idx", *[F.col("h")[k].alias(f"b{k}") for k in range(8)])


_READS = ["'O' || v % 10", "'1' || 'OILSBZ'[v % 6 + 1]", "'ABC'", "'000'", "' 2' || v % 10 || ' '", "'B'", "'x' || v", "CAST(v % 130 AS VARCHAR)", "NULL", "'No 4'"]
_JERSEY = (
    "rd AS (SELECT clip_id, frame_idx, slot, track_id, conf, (v % 2000) / 10.0::DOUBLE AS sharpness, CASE v % 10 "
    + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(_READS))
    + """ END AS read FROM det),
nm AS (SELECT *, upper(trim(read)) AS t, regexp_replace(translate(upper(trim(read)), 'OILSBZ', '011582'), '[^0-9]', '', 'g') AS dg FROM rd),
nr AS (SELECT * , CASE WHEN NOT (length(t) > 2 AND NOT regexp_matches(t, '[0-9]')) AND length(dg) > 0 AND TRY_CAST(right(dg, 2) AS INT) BETWEEN 1 AND 99 THEN CAST(TRY_CAST(right(dg, 2) AS INT) AS VARCHAR) END AS number FROM nm),
evd AS (SELECT * FROM nr WHERE number IS NOT NULL AND sharpness >= 25 QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY sharpness DESC, conf DESC, frame_idx, slot) <= 5),
vt AS (SELECT clip_id, track_id, number, sum(greatest(0.05, conf * greatest(0.2, least(1, sharpness / 120.0)))) AS weight, count(*) AS votes FROM evd GROUP BY ALL),
cs AS (SELECT clip_id, track_id, number, votes, weight / sum(weight) OVER w AS share, sum(votes) OVER w AS evidence, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY weight DESC, votes DESC, number DESC) AS n FROM vt WINDOW w AS (PARTITION BY clip_id, track_id))"""
)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR reads of detections."""
    exprs = ["concat('O', v % 10)", "concat('1', substr('OILSBZ', cast(v % 6 + 1 AS int), 1))", "'ABC'", "'000'", "concat(' 2', v % 10, ' ')", "'B'", "concat('x', v)", "cast(v % 130 AS string)", "NULL", "'No 4'"]
    read = "CASE v % 10 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(exprs)) + " END AS read"
    return adapter.detections(spark, sf_dir).selectExpr("clip_id", "frame_idx", "slot", "track_id", "conf", "(v % 2000) / 10.0D AS sharpness", read)


@query("SELECT clip_id, frame_idx, slot, read, number FROM nr", _JERSEY)
def sco_09_jersey_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("clip_id", "frame_idx", "slot", "read", appearance.jersey_text(F.col("read")).alias("number"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumn("number", appearance.jersey_text(F.col("read"))).where(F.col("number").isNotNull() & (F.col("sharpness") >= 25))
    return appearance.top_evidence(r, ("clip_id", "track_id"))


@query("SELECT clip_id, track_id, frame_idx, slot, number FROM evd", _JERSEY)
def srt_03_top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("clip_id", "track_id", "frame_idx", "slot", "number")


@query("SELECT clip_id, track_id, number, votes, round(share, 4) AS share, evidence FROM cs WHERE n = 1 AND votes >= 2 AND share >= 0.62", _JERSEY)
def agg_07_jersey_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance.jersey_consensus(_evidence(spark, sf_dir), ("clip_id", "track_id")).withColumn("share", F.round("share", 4))


@query("SELECT det.clip_id, count(*) AS n, count(number) AS numbered, count(number) FILTER (share >= 0.9 AND evidence >= 3) AS shown FROM det LEFT JOIN (SELECT * FROM cs WHERE n = 1 AND votes >= 2 AND share >= 0.62) c USING (clip_id, track_id) GROUP BY ALL", _JERSEY)
def sco_11_flt_16_jersey_of_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = appearance.jersey_consensus(_evidence(spark, sf_dir), ("clip_id", "track_id"))
    shown = appearance.displayed(c).select("clip_id", "track_id", F.lit(1).alias("shown"))
    d = adapter.detections(spark, sf_dir).join(c, ["clip_id", "track_id"], "left").join(shown, ["clip_id", "track_id"], "left")
    return d.groupBy("clip_id").agg(F.count("*").alias("n"), F.count("number").alias("numbered"), F.count("shown").alias("shown"))


@query("SELECT clip_id, track_id, frame_idx, arg_max(number, (conf, -CAST(number AS INT))) AS number FROM nr WHERE number IS NOT NULL AND sharpness >= 25 GROUP BY ALL", _JERSEY)
def sco_10_best_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance.best_reads(reads(spark, sf_dir), "clip_id", "track_id", "frame_idx").select("clip_id", "track_id", "frame_idx", "number")


_KIND = "CASE WHEN v % 11 = 0 THEN 'PossessionChange' WHEN v % 5 = 0 THEN 'Pass' WHEN v % 3 = 0 THEN 'Dribble' WHEN v % 13 = 0 THEN 'MadeBasket' WHEN v % 7 = 0 THEN 'MissedBasket' WHEN v % 17 = 0 THEN 'Rebound' WHEN v % 2 = 0 THEN 'Steal' WHEN v % 19 = 0 THEN 'ThreePointSignal' ELSE 'Foul' END"
_ORIGIN = "CASE v % 5 WHEN 0 THEN 'Steal' WHEN 1 THEN 'Rebound' WHEN 2 THEN 'Turnover' WHEN 3 THEN 'JumpBall' END"
_LEDGER = f"""lg AS (SELECT clip_id AS game_id, event_id % 500 AS seq, {_KIND} AS kind, t_ms * 10 AS t_ms, user_id % 3 AS player_id, 1 + user_id % 2 AS team_id, v % 3 AS to_id, 2 AS points, {_ORIGIN} AS origin, v % 2865 + 0.0::DOUBLE AS x, v * 7 % 1524 + 0.0::DOUBLE AS y, v % 4 = 0 AS is_official FROM ev)"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger events: one game for each clip."""
    return adapter.events(spark, sf_dir).selectExpr("clip_id AS game_id", "event_id % 500 AS seq", f"{_KIND} AS kind", "t_ms * 10 AS t_ms", "user_id % 3 AS player_id", "1 + user_id % 2 AS team_id", "v % 3 AS to_id", "2L AS points", f"{_ORIGIN} AS origin", "v % 2865 + 0.0D AS x", "v * 7 % 1524 + 0.0D AS y", "v % 4 = 0 AS is_official")


_ZONE = f"CASE WHEN fb > 1432.5 THEN 'Backcourt' WHEN fb < 580 AND abs(y - 762) < 245 THEN 'Paint' WHEN dr > 675 AND fb < 300 THEN CASE WHEN y < 762 THEN 'CornerLeft' ELSE 'CornerRight' END WHEN dr > 675 AND abs(y - 762) < 300 THEN 'TopOfKey' WHEN y < 762 THEN 'WingLeft' ELSE 'WingRight' END"


@query(
    """SELECT game_id, seq, possession, handler, pteam AS possession_team, start_ms, dribbles, passes, CASE WHEN possession > 0 THEN coalesce(zone, 'Backcourt') END AS zone, CASE WHEN possession > 0 THEN tr0 AND paint = 0 END AS transition FROM (
         SELECT *, count(*) FILTER (dr) OVER o AS dribbles, count(*) FILTER (pas) OVER o AS passes, last_value(CASE WHEN dr OR pas THEN zn END IGNORE NULLS) OVER o AS zone, count(*) FILTER (dr AND zn = 'Paint') OVER o AS paint FROM z WINDOW o AS (PARTITION BY game_id, possession ORDER BY seq))""",
    _LEDGER
    + f""",
p1 AS (SELECT *, count(*) FILTER (kind = 'PossessionChange') OVER (PARTITION BY game_id ORDER BY seq) AS possession FROM lg),
p2 AS (SELECT *, kind = 'Pass' AND possession > 0 AS pas, CASE WHEN kind = 'PossessionChange' THEN player_id WHEN kind = 'Pass' AND possession > 0 THEN to_id END AS gives FROM p1),
p3 AS (SELECT *, last_value(gives IGNORE NULLS) OVER (PARTITION BY game_id, possession ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb, last_value(gives IGNORE NULLS) OVER o AS handler, first_value(CASE WHEN kind = 'PossessionChange' THEN team_id END IGNORE NULLS) OVER o AS pteam,
              first_value(CASE WHEN kind = 'PossessionChange' THEN t_ms END IGNORE NULLS) OVER o AS start_ms, first_value(CASE WHEN kind = 'PossessionChange' THEN coalesce(origin IN ('Steal', 'Rebound', 'Turnover'), false) END IGNORE NULLS) OVER o AS tr0 FROM p2 WINDOW o AS (PARTITION BY game_id, possession ORDER BY seq)),
p4 AS (SELECT *, possession > 0 AND kind = 'Dribble' AND hb = player_id AS dr0, CASE WHEN pteam = 1 THEN x ELSE 2865 - x END AS fb, {_DR.replace('cx', 'x').replace('cy', 'y').format(rim='(CASE WHEN pteam = 1 THEN 160.0 ELSE 2705.0 END)')} AS dr FROM p3),
z AS (SELECT * EXCLUDE (dr), {_ZONE} AS zn, coalesce(dr0, false) AS dr FROM p4)""",
)
def sts_05_possession_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ledger.with_possession(ledger_events(spark, sf_dir))
    return p.select("game_id", "seq", "possession", "handler", "possession_team", "start_ms", "dribbles", "passes", "zone", "transition")


#: One step an event: the baskets that wait are a list in order of events, a signal takes the first that it can reach.
_FOLD = """st AS (
        SELECT DISTINCT game_id, -1::BIGINT AS seq, []::STRUCT(seq BIGINT, t BIGINT, player BIGINT, team BIGINT)[] AS waiting, NULL::STRUCT(seq BIGINT, t BIGINT, player BIGINT, team BIGINT) AS hit FROM lg
        UNION ALL
        SELECT game_id, seq, CASE WHEN kind = 'MadeBasket' THEN list_append(waiting, {'seq': seq, 't': t_ms, 'player': player_id, 'team': team_id}) WHEN found IS NOT NULL THEN list_filter(waiting, lambda w: w.seq <> found.seq) ELSE waiting END, found
        FROM (SELECT g.*, s.waiting, CASE WHEN g.kind = 'ThreePointSignal' THEN list_filter(s.waiting, lambda w: w.t <= g.t_ms AND g.t_ms <= w.t + 2000)[1] END AS found FROM st s JOIN lg g ON g.game_id = s.game_id AND g.seq = s.seq + 1)
    )"""
HISTORY_SQL = """SELECT lg.game_id, CASE WHEN kind = 'ThreePointSignal' THEN hit.seq ELSE lg.seq END AS seq, lg.seq AS at_seq, CASE WHEN kind = 'ThreePointSignal' THEN 'MadeBasket' ELSE kind END AS kind,
    CASE WHEN kind = 'ThreePointSignal' THEN hit.player ELSE player_id END AS player_id, CASE WHEN kind = 'ThreePointSignal' THEN hit.team ELSE team_id END AS team_id, points
    FROM lg JOIN st USING (game_id, seq) WHERE kind <> 'MadeBasket' AND (kind <> 'ThreePointSignal' OR hit IS NOT NULL)"""


@query(HISTORY_SQL, _LEDGER + "," + _FOLD, recursive=True)
def sts_06_joi_15_validated_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's history with baskets in the order in which signals make them official."""
    return ledger.validated(ledger_events(spark, sf_dir))


@query(
    "SELECT game_id, player_id, coalesce(sum(points) FILTER (kind = 'MadeBasket'), 0) AS points, count(*) FILTER (kind = 'MadeBasket') AS fgm, count(*) FILTER (kind IN ('MadeBasket', 'MissedBasket')) AS fga, count(*) FILTER (kind = 'Rebound') AS rebounds, count(*) FILTER (kind = 'Steal') AS steals, count(*) FILTER (kind = 'Foul') AS fouls FROM lg WHERE kind IN ('MadeBasket', 'MissedBasket', 'Rebound', 'Steal', 'Foul') GROUP BY ALL", _LEDGER
)
def agg_01_box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.box_score(ledger_events(spark, sf_dir))


@query("SELECT game_id, seq, coalesce(sum(points) FILTER (team_id = 1) OVER w, 0) AS score_1, coalesce(sum(points) FILTER (team_id <> 1) OVER w, 0) AS score_2 FROM lg WHERE kind = 'MadeBasket' WINDOW w AS (PARTITION BY game_id ORDER BY seq)", _LEDGER)
def agg_02_running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_score(ledger_events(spark, sf_dir), order="seq").select("game_id", "seq", "score_1", "score_2")


@query("SELECT game_id, count(*) AS total_events, coalesce(sum(points) FILTER (kind = 'MadeBasket' AND is_official AND team_id = 1), 0) AS points_1, coalesce(sum(points) FILTER (kind = 'MadeBasket' AND is_official AND team_id <> 1), 0) AS points_2 FROM lg GROUP BY ALL", _LEDGER)
def agg_03_flt_05_game_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(ledger_events(spark, sf_dir))


@query(f"SELECT game_id, seq, 2 AS points FROM lg WHERE {_DR.replace('cx', 'x').replace('cy', 'y').format(rim='160.0')} < 22.86 OR {_DR.replace('cx', 'x').replace('cy', 'y').format(rim='2705.0')} < 22.86", _LEDGER.replace("v % 2865 + 0.0::DOUBLE AS x, v * 7 % 1524", "140 + v % 40 + 0.0::DOUBLE AS x, 742 + v * 7 % 40"))
def sts_07_rim_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls = ledger_events(spark, sf_dir).join(adapter.events(spark, sf_dir).selectExpr("clip_id AS game_id", "event_id % 500 AS seq", "v"), ["game_id", "seq"]).withColumn("x", 140.0 + F.col("v") % 40).withColumn("y", 742.0 + F.col("v") * 7 % 40)
    return ledger.rim_proposals(balls).select("game_id", "seq", "points")


@query()
def sts_11_all_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clip and state: frames, detections (also made ones), active players and numbered ones after all passes in order."""
    from ..operators.annotate import annotate
    from .layer1 import signed_frames

    d = people(spark, sf_dir)
    d = adapter.lowest_slot(d, "clip_id", "frame_idx", "track_id").select("clip_id", "track_id", "frame_idx", "slot", "x", "y", "w", "h", "conf", "court_x", "court_y", "uniform", "hist")
    out = annotate(d, signed_frames(spark, sf_dir).select("clip_id", "frame_idx", "signature"), adapter.balls(spark, sf_dir), reads(spark, sf_dir), adapter.WIDTH, adapter.HEIGHT, adapter.FPS)
    per_frame = out.detections.groupBy("clip_id", "frame_idx").agg(F.count("*").alias("detections"), F.count_if("synthesized").alias("made"), F.count_if("active.candidate").alias("active"), F.count("jersey").alias("numbered"))
    j = out.frames.join(per_frame, ["clip_id", "frame_idx"])
    return j.groupBy("clip_id", "state").agg(F.count("*").alias("frames"), *[F.sum(c).alias(c) for c in ("detections", "made", "active", "numbered")])
