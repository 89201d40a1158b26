"""Queries from detections to box scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, possession
from . import adapter
from .registry import query

_NEAR = """
near AS (
    SELECT b.clip_id, b.frame_idx, b.t_ms, b.x AS bx, b.y AS "by", p.track_id, p.team,
           sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) AS distance
    FROM ball b LEFT JOIN ply p USING (clip_id, frame_idx)
    QUALIFY row_number() OVER (PARTITION BY b.clip_id, b.frame_idx ORDER BY sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), p.slot) = 1
)"""
_POSSESSION = (
    _NEAR
    + """,
assigned AS (SELECT *, CASE WHEN distance < 50 THEN track_id WHEN coalesce(distance, 1e9) > 200 THEN -1 END AS a, CASE WHEN distance < 50 THEN team WHEN coalesce(distance, 1e9) > 200 THEN -1 END AS a_team FROM near),
held AS (
    SELECT *, nullif(last_value(a IGNORE NULLS) OVER w, -1) AS handler, nullif(last_value(a_team IGNORE NULLS) OVER w, -1) AS handler_team
    FROM assigned WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
moved AS (SELECT * FROM held WHERE a <> -1 AND a IS DISTINCT FROM handler),
pos AS (
    SELECT clip_id, frame_idx, 0 AS seq, CASE WHEN handler_team = team THEN 'pass' ELSE 'steal' END AS kind, handler AS from_id,
           CASE WHEN handler_team = team THEN track_id END AS to_id, CASE WHEN handler_team <> team THEN track_id END AS player_id, team AS team_id, handler_team AS from_team, t_ms, bx AS x, "by" AS y
    FROM moved WHERE handler IS NOT NULL
    UNION ALL SELECT clip_id, frame_idx, 1, 'catch', NULL, NULL, track_id, team, NULL, t_ms, bx, "by" FROM moved
)"""
)
_ATTRIBUTED = (
    _POSSESSION
    + """,
att AS (
    SELECT clip_id, frame_idx, seq, 0 AS part, 'catch' AS event_type, player_id AS actor_id, NULL::BIGINT AS secondary_actor_id, team_id, t_ms, NULL AS next_event_type FROM pos WHERE kind = 'catch'
    UNION ALL SELECT clip_id, frame_idx, seq, 0, 'pass', from_id, to_id, team_id, t_ms, 'catch' FROM pos WHERE kind = 'pass'
    UNION ALL SELECT clip_id, frame_idx, seq, 0, 'turnover', from_id, player_id, from_team, t_ms, 'steal' FROM pos WHERE kind = 'steal' AND from_id IS NOT NULL
    UNION ALL SELECT clip_id, frame_idx, seq, 1, 'steal', player_id, from_id, team_id, t_ms, NULL FROM pos WHERE kind = 'steal'
)"""
)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.nearest_players(adapter.players(spark, sf_dir), adapter.balls(spark, sf_dir))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(possession.possession_events(nearest(spark, sf_dir)))


@query("SELECT clip_id, frame_idx, track_id, team, round(distance, 4) AS distance FROM near", _NEAR)
def joi_04_nearest_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir).select("clip_id", "frame_idx", "track_id", "team", F.round("distance", 4).alias("distance"))


@query("SELECT * FROM pos", _POSSESSION)
def sts_03_possession_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.possession_events(nearest(spark, sf_dir))


@query("SELECT *, '' AS violations FROM att", _ATTRIBUTED)
def evt_01_02_attributed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).select("clip_id", "frame_idx", "seq", "part", "event_type", "actor_id", "secondary_actor_id", "team_id", "t_ms", "next_event_type", F.array_join("rule_validation", ",").alias("violations"))


@query(
    "SELECT clip_id, actor_id, CASE event_type WHEN 'turnover' THEN 'TOs' ELSE 'Steals' END AS stat, count(*) AS total FROM att WHERE event_type IN ('turnover', 'steal') GROUP BY ALL",
    _ATTRIBUTED,
)
def game_box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detections to possession, attributed events, and each player's statistics."""
    return attribution.box_score(attributed(spark, sf_dir), "clip_id")


@query(
    """SELECT f.clip_id, f.frame_idx, last_value(b.x IGNORE NULLS) OVER w AS x, last_value(b.y IGNORE NULLS) OVER w AS y, last_value(CASE WHEN b.x IS NOT NULL THEN b.frame_idx END IGNORE NULLS) OVER w AS seen_frame
       FROM (SELECT DISTINCT clip_id, frame_idx FROM ev) f LEFT JOIN ball b USING (clip_id, frame_idx) WINDOW w AS (PARTITION BY f.clip_id ORDER BY f.frame_idx)"""
)
def joi_14_last_known_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.last_known_ball(adapter.events(spark, sf_dir), adapter.balls(spark, sf_dir))


_EVENT_ROWS = "(SELECT *, CASE WHEN v % 13 = 0 THEN NULL ELSE track_id END AS actor_id, CASE WHEN v % 5 = 0 THEN NULL ELSE slot END AS secondary_actor_id, CASE WHEN v % 17 = 0 THEN NULL ELSE team END AS team_id, v % 19 <> 0 AS live_play FROM det)"
_TYPES = sorted(attribution.RULES)
_KINDS = [None, "shot_attempt", "missed_shot", "pass", "catch", "steal", "made_shot"]


def _pick(values: list, column) -> object:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), column.cast("int") + 1)


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of all types, with and without what their rules ask for."""
    d, v = adapter.detections(spark, sf_dir), F.col("v")
    yes = lambda m: v % m != 0
    return d.select(
        "clip_id",
        "frame_idx",
        "slot",
        _pick(_TYPES, v % 10).alias("event_type"),
        F.when(yes(13), F.col("track_id")).alias("actor_id"),
        F.when(yes(5), F.col("slot")).alias("secondary_actor_id"),
        F.when(yes(17), F.col("team")).alias("team_id"),
        yes(19).alias("live_play"),
        _pick(_KINDS, v % 7).alias("preceding_event_type"),
        _pick(_KINDS, F.floor(v / 7) % 7).alias("next_event_type"),
        _pick(_KINDS, F.floor(v / 3) % 7).alias("terminal_event_type"),
        _pick(_KINDS, F.floor(v / 5) % 7).alias("resolution_event_type"),
        _pick([None, "two_point", "three_point", "free_throw", "four_point"], F.floor(v / 11) % 5).alias("shot_value"),
        F.struct(yes(2).alias("ball_release"), F.when(yes(3), F.when(F.floor(v / 2) % 2 == 0, "made").otherwise("missed")).alias("shot_result"), yes(7).alias("possession_change"), yes(3).alias("loss_of_team_control"), yes(4).alias("possession_gain"), yes(6).alias("pass_then_make")).alias("evidence"),
    )


def _case_sql() -> str:
    lists = {n: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]" for n, xs in (("t", _TYPES), ("k", _KINDS), ("s", [None, "two_point", "three_point", "free_throw", "four_point"]))}
    return f"""cases AS (SELECT clip_id, frame_idx, slot, v, {lists["t"]}[v % 10 + 1] AS event_type, actor_id, secondary_actor_id, team_id, live_play,
        {lists["k"]}[v % 7 + 1] AS prec, {lists["k"]}[v // 7 % 7 + 1] AS nxt, {lists["k"]}[v // 3 % 7 + 1] AS term, {lists["k"]}[v // 5 % 7 + 1] AS reso, {lists["s"]}[v // 11 % 5 + 1] AS shot_value,
        v % 2 <> 0 AS rel, CASE WHEN v % 3 <> 0 THEN CASE WHEN v // 2 % 2 = 0 THEN 'made' ELSE 'missed' END END AS res, v % 7 <> 0 AS chg, v % 3 <> 0 AS loss, v % 4 <> 0 AS gain, v % 6 <> 0 AS ptm FROM {_EVENT_ROWS})"""


_CHECKS = {
    "live_play": "live_play",
    "actor_identity_known": "actor_id IS NOT NULL",
    "receiver_identity_known": "secondary_actor_id IS NOT NULL",
    "team_in_possession_known": "team_id IS NOT NULL",
    "ball_release_evidence": "rel",
    "shot_value_known": "coalesce(shot_value IN ('two_point', 'three_point', 'free_throw'), false)",
    "preceding_shot_attempt": "prec IS NOT DISTINCT FROM 'shot_attempt'",
    "make_result_evidence": "res IS NOT DISTINCT FROM 'made'",
    "miss_result_evidence": "res IS NOT DISTINCT FROM 'missed'",
    "preceding_missed_shot": "prec IS NOT DISTINCT FROM 'missed_shot'",
    "possession_change_evidence": "chg",
    "loss_of_team_control_evidence": "loss",
    "possession_gain_evidence": "gain",
    "pass_then_made_shot_sequence": "ptm",
}


def _violations_sql() -> str:
    arms = []
    for name, (pre, second, follows, expected, allowed, resolution, terminal) in attribution.RULES.items():
        t = [f"CASE WHEN NOT ({_CHECKS[p]}) THEN '{p}' END" for p in pre if p in _CHECKS] + ["CASE WHEN actor_id IS NULL THEN 'primary_actor_missing' END"]
        if second and not second.endswith("_optional"):
            t.append("CASE WHEN secondary_actor_id IS NULL THEN 'secondary_actor_missing' END")
        if follows:
            t.append(f"CASE WHEN prec IS DISTINCT FROM '{follows}' THEN 'must_follow:{follows}' END")
        if expected:
            t.append(f"CASE WHEN nxt <> '{expected}' THEN 'expected_follow_up:{expected}' END")
        inside = lambda xs: ", ".join(f"'{x}'" for x in xs)
        if allowed:
            t.append(f"CASE WHEN NOT coalesce(nxt IN ({inside(allowed)}), false) THEN 'allowed_follow_up' END")
        if resolution:
            t.append(f"CASE WHEN NOT coalesce(reso IN ({inside(resolution)}), false) THEN 'resolution_required' END")
        if terminal:
            t.append(f"CASE WHEN term IS DISTINCT FROM '{terminal}' THEN 'required_terminal_event:{terminal}' END")
        arms.append(f"WHEN '{name}' THEN concat_ws(',', {', '.join(t)})")
    return "CASE event_type " + " ".join(arms) + " END"


_STATS = "(VALUES " + ", ".join(f"('{e}', '{s}', '{k}', {d})" for e, s, k, d in attribution.STAT_DELTAS) + ") s(event_type, shot, stat, delta)"


@query(f"SELECT clip_id, frame_idx, slot, event_type, {_violations_sql()} AS violations FROM cases", _case_sql())
def evt_03_04_rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cases(spark, sf_dir).select("clip_id", "frame_idx", "slot", "event_type", F.array_join(attribution.violations(), ",").alias("violations"))


@query(f"SELECT event_type, stat, sum(delta) AS total, count(*) AS n FROM (SELECT *, {_violations_sql()} AS bad FROM cases) c JOIN {_STATS} USING (event_type) WHERE bad = '' AND (shot = '' OR shot = shot_value) GROUP BY ALL", _case_sql())
def evt_05_06_stat_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rule_cases(spark, sf_dir).withColumn("rule_validation", attribution.violations()).withColumn("stat_deltas", attribution.stat_deltas())
    return d.select("event_type", F.explode("stat_deltas").alias("stat", "delta")).groupBy("event_type", "stat").agg(F.sum("delta").alias("total"), F.count("*").alias("n"))
