"""Ball possession from detections: nearest player, the possession machine as windows, and its events.

A frame's nearest player takes the ball within ``TAKE`` and loses it beyond ``DROP``; in between the handler stays.  The
handler before a frame is the last assignment of the frames before it, so no state is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TAKE, DROP, NOBODY = 50.0, 200.0, -1


def nearest_players(players: DataFrame, balls: DataFrame, keys: tuple[str, ...] = ("clip_id", "frame_idx")) -> DataFrame:
    """For each frame with a ball: the nearest player's track and team (ties: lowest slot) and distance; null without players.

    Players and balls meet on the frame, so nothing is compared across frames.
    """
    b = balls.select(*keys, F.col("t_ms").alias("ball_t_ms"), F.col("x").alias("bx"), F.col("y").alias("by"))
    p = players.select(*keys, "slot", "track_id", "team", "x", "y")
    d = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    both = b.join(p, list(keys), "left").withColumn("d", d)
    best = F.min(F.when(F.col("track_id").isNotNull(), F.struct("d", "slot", "track_id", "team")))
    out = both.groupBy(*keys).agg(F.first("ball_t_ms").alias("t_ms"), F.first("bx").alias("bx"), F.first("by").alias("by"), best.alias("b"))
    return out.select(*keys, "t_ms", "bx", "by", F.col("b.d").alias("distance"), F.col("b.track_id").alias("track_id"), F.col("b.team").alias("team"))


def with_handler(nearest: DataFrame, clip: str = "clip_id", frame: str = "frame_idx") -> DataFrame:
    """``nearest`` with the assignment of each frame and the handler (track, team) before it; null for nobody."""
    far = F.coalesce(F.col("distance"), F.lit(float("inf")))
    taken = F.when(far < TAKE, F.struct("track_id", "team")).when(far > DROP, F.struct(F.lit(NOBODY).cast("long").alias("track_id"), F.lit(NOBODY).cast("long").alias("team")))
    before = Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, -1)
    out = nearest.withColumn("taken", taken).withColumn("before", F.last("taken", ignorenulls=True).over(before))
    return out.withColumn("handler", F.when(F.col("before.track_id") != NOBODY, F.col("before.track_id"))).withColumn("handler_team", F.when(F.col("before.track_id") != NOBODY, F.col("before.team"))).drop("before")


def possession_events(nearest: DataFrame) -> DataFrame:
    """pass, steal and catch rows: clip_id, frame_idx, seq, kind, from_id, to_id, player_id, team_id, from_team, t_ms, x, y.

    When the ball goes to another track: a pass (same team) or a steal (other team) if there was a handler, then a catch.
    The team of a handler that is not in view is the last known one.
    """
    h = with_handler(nearest)
    moved = h.where((F.col("taken.track_id") != NOBODY) & ~F.col("taken.track_id").eqNullSafe(F.col("handler")))
    kind = F.when(F.col("handler").isNull(), F.lit(None)).when(F.col("handler_team") == F.col("team"), "pass").otherwise("steal")
    none = F.lit(None).cast("long")
    loss = F.struct(
        F.lit(0).alias("seq"),
        kind.alias("kind"),
        F.col("handler").alias("from_id"),
        F.when(kind == "pass", F.col("track_id")).alias("to_id"),
        F.when(kind == "steal", F.col("track_id")).alias("player_id"),
        F.col("handler_team").alias("from_team"),
    )
    gain = F.struct(F.lit(1).alias("seq"), F.lit("catch").alias("kind"), none.alias("from_id"), none.alias("to_id"), F.col("track_id").alias("player_id"), none.alias("from_team"))
    out = moved.withColumn("e", F.explode(F.array(loss, gain))).where("e.kind IS NOT NULL")
    return out.select("clip_id", "frame_idx", "e.seq", "e.kind", "e.from_id", "e.to_id", "e.player_id", F.col("team").alias("team_id"), "e.from_team", "t_ms", F.col("bx").alias("x"), F.col("by").alias("y"))


def last_known_ball(frames: DataFrame, balls: DataFrame) -> DataFrame:
    """Every frame with the ball last seen at or before it (x, y, the frame it was seen in)."""
    f = frames.select("clip_id", "frame_idx").distinct().join(balls.select("clip_id", "frame_idx", F.struct("x", "y", "frame_idx").alias("b")), ["clip_id", "frame_idx"], "left")
    so_far = Window.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("b", ignorenulls=True).over(so_far)
    return f.select("clip_id", "frame_idx", last.alias("b")).select("clip_id", "frame_idx", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.frame_idx").alias("seen_frame"))
