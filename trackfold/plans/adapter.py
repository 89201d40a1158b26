"""Sports-tracking rows made from the ``events`` table by integer arithmetic, in Spark and as SQL.

Ten consecutive events are a frame, fifty frames a clip.  Slot 0 of a frame is the ball, unless its event is an error;
the other slots are detections of players.  All values are small integers or quotients of them, so that both engines
compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frame size in pixels and frames per second.
WIDTH, HEIGHT, FPS = 640, 480, 30.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_idx, slot, t_ms, user_id, event_type, value, v: one row for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id",
        "event_id div 500 AS clip_id",
        "(event_id % 500) div 10 AS frame_idx",
        "event_id % 10 AS slot",
        "((event_id % 500) div 10 * 1000) div 30 AS t_ms",
        "user_id",
        "event_type",
        "value",
        "cast(round(value * 100) AS bigint) AS v",
    )


_DETECTION = [
    ("clip_id", "clip_id"),
    ("frame_idx", "frame_idx"),
    ("slot", "slot"),
    ("t_ms", "t_ms"),
    ("track_id", "user_id % 12"),
    ("team", "1 + user_id % 12 % 2"),
    ("v", "v"),
    ("conf", "(v * 13 % 101) / 100.0D"),
    ("x", "v * 37 % 500 + 0.0D"),
    ("y", "v * 61 % 400 + 0.0D"),
    ("w", "20 + v * 7 % 60 + 0.0D"),
    ("h", "40 + v * 11 % 160 + 0.0D"),
    ("court_x", "CASE WHEN v % 7 = 0 THEN NULL ELSE v * 29 % 3000 - 60 + 0.0D END"),
    ("court_y", "CASE WHEN v % 7 = 0 THEN NULL ELSE v * 17 % 1700 - 60 + 0.0D END"),
    ("speed", "(v * 5 % 600) / 10.0D"),
    ("vx", "(v * 3 % 400 - 200) / 2.0D"),
    ("vy", "(v * 19 % 160 - 80) / 2.0D"),
    ("uniform", "CASE v % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' ELSE 'unknown' END"),
    ("synthesized", "v % 11 = 0"),
]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player detections of slots 1 to 9; a track may be in a frame several times."""
    return events(spark, sf_dir).where("slot <> 0").selectExpr(*[f"{e} AS {n}" for n, e in _DETECTION])


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with each track once in a frame: that of the lowest slot."""
    return lowest_slot(detections(spark, sf_dir), "clip_id", "frame_idx", "track_id")


def lowest_slot(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the lowest slot of each group, by one aggregation that is partial before its exchange."""
    rest = [c for c in rows.columns if c not in keys and c != "slot"]
    first = F.min(F.struct("slot", *rest)).alias("r")
    return rows.groupBy(*keys).agg(first).select(*keys, "r.*").select(*rows.columns)


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ball of each frame that has one."""
    return events(spark, sf_dir).where("slot = 0 AND event_type <> 'error'").selectExpr("clip_id", "frame_idx", "t_ms", "v", "v * 37 % 500 + 0.0D AS x", "v * 61 % 400 + 0.0D AS y", "(v * 13 % 101) / 100.0D AS conf")


def _sql(text: str) -> str:
    return text.replace("0.0D", "0.0::DOUBLE").replace("100.0D", "100.0::DOUBLE").replace("10.0D", "10.0::DOUBLE").replace("2.0D", "2.0::DOUBLE")


#: Common table expressions for DuckDB: ev, det, ply (players) and ball.
CTE = f"""
ev AS (
    SELECT event_id, event_id // 500 AS clip_id, (event_id % 500) // 10 AS frame_idx, event_id % 10 AS slot,
           ((event_id % 500) // 10 * 1000) // 30 AS t_ms, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS v
    FROM events
),
det AS (SELECT {", ".join(f"{_sql(e)} AS {n}" for n, e in _DETECTION)} FROM ev WHERE slot <> 0),
ply AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx, track_id ORDER BY slot) = 1),
ball AS (
    SELECT clip_id, frame_idx, t_ms, v, v * 37 % 500 + 0.0::DOUBLE AS x, v * 61 % 400 + 0.0::DOUBLE AS y, (v * 13 % 101) / 100.0::DOUBLE AS conf
    FROM ev WHERE slot = 0 AND event_type <> 'error'
)
"""
