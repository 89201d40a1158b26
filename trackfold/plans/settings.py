"""Queries of what files set: identity policies, video paths, takes, rules of events, summaries of written lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, continuity, identity, ledger
from ..operators.policy import IdentityPolicy
from ..sources import jsonl, mocap, reports, rules
from ..sources.storage import shared_folder
from . import adapter, game, people
from .documents import _STICKS, _written
from .layer1 import _CONT, signed_frames
from .registry import query

#: A policy that differs from the defaults in each of its settings but the switch of hypotheses.
OWN = IdentityPolicy(visual=0.2, churn=0.9, cut=0.6, reset=False, fill=False, max_gap=2, link=0.6, max_court=900.0, max_ratio=2.0, hypothesis=0.5, top=2, ambiguity=0.1)


def own_policy(spark: SparkSession) -> IdentityPolicy:
    """The policy after its way through a file."""
    return rules.identity_settings(_written(spark, rules.identity_policy_document(OWN)))


def _with(sql: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


_OWN_TAILS = _with(
    people._TAILS,
    ("1.35 *", "2.0 *"),
    ("BETWEEN 1 AND 3)", "BETWEEN 1 AND 2)"),
    ("oc / 260.0", "oc / 900.0"),
    ("oc <= 260", "oc <= 900"),
    ("(gap - 1) / 3.0::DOUBLE", "(gap - 1) / 2.0::DOUBLE"),
    ("score >= 0.55", "score >= 0.5"),
    ("WHERE same AND score >= 0.72", "WHERE score >= 0.6"),
)


@query("SELECT clip_id, pred, succ, gap, score FROM sl", _OWN_TAILS)
def src_09_links_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by a policy of one's own, which lets them go over cuts."""
    policy = own_policy(spark)
    links = identity.selected(identity.candidates(people.short_tracks(spark, sf_dir), policy.link, policy=policy))
    return links.select("clip_id", "pred", "succ", F.col("gap").cast("long").alias("gap"), "score")


@query(
    "SELECT clip_id, frame_idx, breaks, sum(breaks::BIGINT) OVER (PARTITION BY clip_id ORDER BY frame_idx)::BIGINT AS continuity_segment FROM br",
    _with(_CONT, ("visual_delta / 0.28", "visual_delta / 0.2"), ("churn / 0.8)", "churn / 0.9)"), ("d >= 0.72", "d >= 0.6"), ("visual_delta >= 0.28", "visual_delta >= 0.2")),
)
def src_09_cuts_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts by the same policy."""
    return continuity.with_segments(signed_frames(spark, sf_dir), policy=own_policy(spark)).select("clip_id", "frame_idx", "breaks", "continuity_segment")


@query("SELECT video, count(*) AS clips, sum(n)::BIGINT AS n FROM (SELECT clip_id, count(*) AS n, CASE WHEN clip_id % 3 = 0 THEN 'clips/' || clip_id || '.mp4' ELSE 'footage/game.mp4' END AS video FROM ev GROUP BY clip_id) GROUP BY video")
def src_21_video_of_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The video of each clip: the one asked for, else that of the configuration."""
    path = f"{shared_folder(spark)}/configuration"
    reports.write_document(spark, path, {"local_video_path": "footage/game.mp4"})
    clips = adapter.events(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("n"))
    asked = clips.withColumn("requested", F.when(F.col("clip_id") % 3 == 0, F.concat(F.lit("clips/"), "clip_id", F.lit(".mp4"))))
    return rules.with_video_path(asked, path).groupBy("video").agg(F.count("*").alias("clips"), F.sum("n").alias("n"))


@query(
    """SELECT label, count(*) AS samples, sum(steps)::BIGINT AS steps, round(sum(x), 6) AS x_total FROM (
         SELECT CASE WHEN clip_id % 2 = 0 THEN 'walk' ELSE 'run' END AS label, least(30, len(s)) AS steps, list_sum(list_transform(range(least(30, len(s))), lambda i: s[CAST(floor(CASE WHEN len(s) <= 30 THEN i ELSE i * (len(s) - 1) / 29.0 END) AS BIGINT) + 1] * 0.00254::DOUBLE)) AS x
         FROM (SELECT clip_id, list(v % 10 ORDER BY event_id) AS s FROM ev GROUP BY clip_id)) GROUP BY label"""
)
def src_23_samples_of_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two takes whose motion files are there, a file for each clip of 500 frames, and of one that is missing."""
    folder = shared_folder(spark)
    spark.createDataFrame([(_STICKS,)], "value string").coalesce(1).write.text(f"{folder}/sticks")
    line = F.concat_ws("\n", F.col("event_id") + 1, F.concat(F.lit("root "), F.col("v") % 10, F.lit(" 0 100 0 0 0")))
    e = adapter.events(spark, sf_dir).select("clip_id", (F.col("clip_id") % 2).alias("take"), F.struct("event_id", line.alias("f")).alias("s"))
    files = e.groupBy("take", "clip_id").agg(F.concat_ws("\n", F.lit(":DEGREES"), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"])).alias("value"))
    files.drop("clip_id").write.partitionBy("take").option("maxRecordsPerFile", 1).text(f"{folder}/motion")  # a file, but no folder, for each clip
    takes = [("sticks", "motion/take=0", "walk"), ("sticks", "motion/take=1", "run"), ("sticks", "motion/take=2", "hop")]
    made = mocap.capture_dataset(spark, folder, takes)
    x = F.aggregate("features_v2", F.lit(0.0), lambda total, row: total + row[70])
    return made.groupBy("label").agg(F.count("*").alias("samples"), F.sum(F.size("features_v2")).alias("steps"), F.round(F.sum(x), 6).alias("x_total"))


@query(
    "SELECT clip_id, frame_idx, slot, CASE WHEN event_type = 'assist_candidate' THEN 'made_shot' WHEN event_type = 'steal' THEN 'turnover' END AS required_terminal_event FROM cases",
    game._case_sql(),
)
def joi_22_rule_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminal event that each row's rule asks for, by rules in which a steal ends in a turnover; an event without a rule would stop the query."""
    document = rules.event_rules_document()
    document["events"]["steal"]["temporal"]["required_terminal_event"] = "turnover"
    own = rules.event_rules(_written(spark, document))
    return attribution.with_terminal_event(game.rule_cases(spark, sf_dir), own.rules).select("clip_id", "frame_idx", "slot", "required_terminal_event")


@query(
    "SELECT game_id, count(*) AS total_events, coalesce(sum(points) FILTER (kind = 'MadeBasket' AND is_official AND team_id = 1), 0)::BIGINT AS points_1, coalesce(sum(points) FILTER (kind = 'MadeBasket' AND is_official AND team_id <> 1), 0)::BIGINT AS points_2 FROM lg GROUP BY game_id",
    people._LEDGER,
)
def src_03_summary_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of written event lines, which must be there."""
    path = f"{shared_folder(spark)}/events"
    jsonl.write_lines(people.ledger_events(spark, sf_dir).select("game_id", "kind", "t_ms", "team_id", "points", "is_official"), path)
    return ledger.summary(jsonl.read_lines(spark, path, "game_id long, kind string, t_ms long, team_id int, points long, is_official boolean", must_exist=True))
