"""Attributed events: possession events as rows of the statistics' event model, validated by rules, with stat deltas.

The rules are data; their checks are Columns over the event row, so any number of events is validated in one projection.
An event row has event_type, actor_id, secondary_actor_id, team_id, t_ms, live_play, preceding_event_type,
next_event_type, terminal_event_type, resolution_event_type, shot_value, and evidence (a struct of nullable fields).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type -> (prerequisites, second actor, must follow, expected next, allowed next, resolution, terminal).
RULES = {
    "pass": (["live_play", "actor_identity_known", "team_in_possession_known"], "receiver", None, "catch", [], [], None),
    "catch": (["live_play", "actor_identity_known"], None, None, None, [], [], None),
    "shot_attempt": (["live_play", "actor_identity_known", "ball_release_evidence", "shot_value_known"], None, None, None, [], ["made_shot", "missed_shot"], None),
    "made_shot": (["preceding_shot_attempt", "actor_identity_known", "shot_value_known", "make_result_evidence"], None, "shot_attempt", None, [], [], None),
    "missed_shot": (["preceding_shot_attempt", "actor_identity_known", "miss_result_evidence"], None, "shot_attempt", None, [], [], None),
    "rebound_off": (["live_play", "actor_identity_known", "preceding_missed_shot", "possession_change_evidence"], None, "missed_shot", None, [], [], None),
    "rebound_def": (["live_play", "actor_identity_known", "preceding_missed_shot", "possession_change_evidence"], None, "missed_shot", None, [], [], None),
    "turnover": (["live_play", "actor_identity_known", "loss_of_team_control_evidence"], "beneficiary_optional", None, None, ["steal", "pass", "catch"], [], None),
    "steal": (["live_play", "actor_identity_known", "possession_gain_evidence", "preceding_turnover_optional"], "offender_optional", None, None, [], [], None),
    "assist_candidate": (["live_play", "actor_identity_known", "receiver_identity_known", "pass_then_made_shot_sequence"], "shooter", "pass", None, [], [], "made_shot"),
}
# The most milliseconds between an event and the one it answers or waits for, used only if strict.
MAX_GAP_MS = {"pass": 1200, "shot_attempt": 2500, "made_shot": 2500, "missed_shot": 2500, "rebound_off": 1800, "rebound_def": 1800, "assist_candidate": 3000}
# Fixed values: (event type, shot value or empty, statistic, delta).
STAT_DELTAS = [
    ("shot_attempt", "two_point", "2P FGA", 1),
    ("shot_attempt", "three_point", "3P FGA", 1),
    ("shot_attempt", "free_throw", "FTA", 1),
    ("made_shot", "two_point", "2P FGM", 1),
    ("made_shot", "two_point", "PTS", 2),
    ("made_shot", "three_point", "3P FGM", 1),
    ("made_shot", "three_point", "PTS", 3),
    ("made_shot", "free_throw", "FTM", 1),
    ("made_shot", "free_throw", "PTS", 1),
    ("rebound_off", "", "O. Reb.", 1),
    ("rebound_off", "", "T. Reb.", 1),
    ("rebound_def", "", "D. Reb.", 1),
    ("rebound_def", "", "T. Reb.", 1),
    ("turnover", "", "TOs", 1),
    ("steal", "", "Steals", 1),
    ("assist_candidate", "", "Assists", 1),
]
SHOT_VALUES = ["two_point", "three_point", "free_throw"]
EVIDENCE = "struct<ball_release:boolean,shot_result:string,possession_change:boolean,loss_of_team_control:boolean,possession_gain:boolean,pass_then_make:boolean>"


def validate_rules(rules: dict) -> None:
    """Raise if a rule table lacks an event, or an event a prerequisite."""
    if missing := sorted(set(RULES) - set(rules)):
        raise ValueError(f"rules lack events: {missing}")
    if empty := [k for k, r in rules.items() if not r[0]]:
        raise ValueError(f"rules without prerequisites: {empty}")


def _prerequisite(name: str) -> Column:
    """Whether a prerequisite holds; unknown names and optional ones always do."""
    e = lambda field: F.coalesce(F.col(f"evidence.{field}"), F.lit(False))
    checks = {
        "live_play": lambda: F.coalesce(F.col("live_play"), F.lit(False)),
        "actor_identity_known": lambda: F.col("actor_id").isNotNull(),
        "receiver_identity_known": lambda: F.col("secondary_actor_id").isNotNull(),
        "team_in_possession_known": lambda: F.col("team_id").isNotNull(),
        "ball_release_evidence": lambda: e("ball_release"),
        "shot_value_known": lambda: F.coalesce(F.col("shot_value").isin(SHOT_VALUES), F.lit(False)),
        "preceding_shot_attempt": lambda: F.col("preceding_event_type").eqNullSafe("shot_attempt"),
        "make_result_evidence": lambda: F.col("evidence.shot_result").eqNullSafe("made"),
        "miss_result_evidence": lambda: F.col("evidence.shot_result").eqNullSafe("missed"),
        "preceding_missed_shot": lambda: F.col("preceding_event_type").eqNullSafe("missed_shot"),
        "possession_change_evidence": lambda: e("possession_change"),
        "loss_of_team_control_evidence": lambda: e("loss_of_team_control"),
        "possession_gain_evidence": lambda: e("possession_gain"),
        "pass_then_made_shot_sequence": lambda: e("pass_then_make"),
    }
    return checks[name]() if name in checks else F.lit(True)


def with_terminal_event(rows: DataFrame, rules: dict = RULES, name: str = "required_terminal_event") -> DataFrame:
    """``rows`` with the terminal event that the rule of their ``event_type`` requires (null if none); a type without a rule raises."""
    known = F.create_map(*[x for k, r in rules.items() for x in (F.lit(k), F.lit(r[-1]).cast("string"))])
    unknown = F.raise_error(F.concat(F.lit("no rule for event type "), F.coalesce("event_type", F.lit("null"))))
    return rows.withColumn(name, F.when(F.col("event_type").isin(list(rules)), known[F.col("event_type")]).otherwise(unknown))


def violations(rules: dict = RULES, strict: bool = False, max_gap_ms: dict[str, int] = MAX_GAP_MS) -> Column:
    """The unmet constraints of an event row, in order; null for an unknown event type.

    ``strict`` also tests the gap limits (column ``gap_ms``), which by default are stated but not enforced.
    """
    out = F.lit(None).cast("array<string>")
    for name, (prerequisites, second, follows, expected, allowed, resolution, terminal) in rules.items():
        tests = [F.when(~_prerequisite(p), p) for p in prerequisites]
        tests.append(F.when(F.col("actor_id").isNull(), "primary_actor_missing"))
        if second and not second.endswith("_optional"):
            tests.append(F.when(F.col("secondary_actor_id").isNull(), "secondary_actor_missing"))
        if follows:
            tests.append(F.when(~F.col("preceding_event_type").eqNullSafe(follows), f"must_follow:{follows}"))
        if expected:
            tests.append(F.when(F.col("next_event_type").isNotNull() & (F.col("next_event_type") != expected), f"expected_follow_up:{expected}"))
        if allowed:
            tests.append(F.when(~F.coalesce(F.col("next_event_type").isin(allowed), F.lit(False)), "allowed_follow_up"))
        if resolution:
            tests.append(F.when(~F.coalesce(F.col("resolution_event_type").isin(resolution), F.lit(False)), "resolution_required"))
        if terminal:
            tests.append(F.when(~F.col("terminal_event_type").eqNullSafe(terminal), f"required_terminal_event:{terminal}"))
        if strict and name in max_gap_ms:
            tests.append(F.when(F.col("gap_ms") > max_gap_ms[name], "max_gap_ms"))
        out = F.when(F.col("event_type") == name, F.array_compact(F.array(*tests))).otherwise(out)
    return out


def stat_deltas(table: list[tuple[str, str, str, int]] = STAT_DELTAS) -> Column:
    """Statistic deltas of an event row as a map; empty if any constraint is unmet (column ``rule_validation``)."""
    by: dict[tuple[str, str], list] = {}
    for event, shot, stat, delta in table:
        by.setdefault((event, shot), []).extend([F.lit(stat), F.lit(delta)])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    out = empty
    for (event, shot), pairs in by.items():
        here = (F.col("event_type") == event) & ((F.col("shot_value") == shot) if shot else F.lit(True))
        out = F.when(here, F.create_map(*pairs)).otherwise(out)
    return F.when(F.size("rule_validation") == 0, out).otherwise(empty)


def attribute(events: DataFrame) -> DataFrame:
    """Possession events as attributed events with rule_validation and stat_deltas.

    A catch is one row, a pass one with the catch expected next, a steal two: the turnover (if the offender is known)
    and the steal.  Other kinds give none.
    """
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def row(seq: int, kind: str, actor, second, team, following: str | None, evidence: dict[str, bool]) -> Column:
        fields = [x.split(":")[0] for x in EVIDENCE[7:-1].split(",")]
        proof = F.struct(*[(F.lit(evidence.get(f)).cast("string" if f == "shot_result" else "boolean")).alias(f) for f in fields])
        return F.struct(
            F.lit(seq).alias("part"), F.lit(kind).alias("event_type"), actor.alias("actor_id"), second.alias("secondary_actor_id"), team.alias("team_id"), F.lit(following).cast("string").alias("next_event_type"), proof.alias("evidence")
        )

    c = F.col
    rows = (
        F.when(c("kind") == "catch", F.array(row(0, "catch", c("player_id"), none, c("team_id"), None, {})))
        .when(c("kind") == "pass", F.array(row(0, "pass", c("from_id"), c("to_id"), F.coalesce(c("team_id"), c("from_team")), "catch", {})))
        .when(
            c("kind") == "steal",
            F.filter(
                F.array(row(0, "turnover", c("from_id"), c("player_id"), c("from_team"), "steal", {"loss_of_team_control": True}), row(1, "steal", c("player_id"), c("from_id"), c("team_id"), None, {"possession_gain": True})),
                lambda e: (e["event_type"] != "turnover") | e["actor_id"].isNotNull(),
            ),
        )
    )
    out = events.withColumn("e", F.explode(rows)).select("clip_id", "frame_idx", "seq", "e.*", "t_ms")
    out = out.withColumns({"live_play": F.lit(True), "preceding_event_type": text, "terminal_event_type": text, "resolution_event_type": text, "shot_value": text})
    return out.withColumn("rule_validation", violations()).withColumn("stat_deltas", stat_deltas())


def box_score(attributed: DataFrame, *keys: str) -> DataFrame:
    """Sums of stat deltas by player and statistic: keys, actor_id, stat, total."""
    return attributed.select(*keys, "actor_id", F.explode("stat_deltas").alias("stat", "delta")).groupBy(*keys, "actor_id", "stat").agg(F.sum("delta").alias("total"))


def stat_table(spark: SparkSession) -> DataFrame:
    """The stat deltas as rows: event_type, shot_value (empty if it does not matter), stat, delta."""
    return spark.createDataFrame(STAT_DELTAS, "event_type string, shot_value string, stat string, delta int")
