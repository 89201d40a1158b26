"""Live play: frame metrics, score, trailing windows, hysteresis, and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clip01

LIVE, DEAD = 0.62, 0.38
FRAME = ("clip_id", "frame_idx")


def frame_metrics(detections: DataFrame) -> DataFrame:
    """Per frame: counts, speed sums and medians, signs of motion over active detections; shares over all.

    Input columns: active, speed, vx, vy, in_bounds (nullable), edge, mismatch, changed (repaired or synthesized).
    """
    a = F.col("active")
    on = lambda c: F.when(a, F.col(c))
    n = lambda c: F.count_if(a & c)
    return detections.groupBy(*FRAME).agg(
        F.count("*").alias("n"),
        F.count_if(a).alias("a"),
        n(F.coalesce("in_bounds", F.lit(True))).alias("on_court"),
        F.coalesce(F.sum(on("speed")), F.lit(0.0)).alias("speed_sum"),
        F.coalesce(F.median(on("speed")), F.lit(0.0)).alias("speed_median"),
        n(F.col("speed") >= 18).alias("fast"),
        F.coalesce(F.median(on("vx")), F.lit(0.0)).alias("vx_median"),
        F.coalesce(F.median(F.abs(on("vy"))), F.lit(0.0)).alias("vy_abs_median"),
        n(F.col("vx") > 0).alias("right"),
        n(F.col("vx") < 0).alias("left"),
        n(F.col("edge")).alias("edge"),
        n(F.col("mismatch")).alias("mismatch"),
        F.count_if(F.col("changed")).alias("changed"),
    )


def with_score(m: DataFrame, ball_confidence: str = "ball_conf") -> DataFrame:
    """Frame metrics with pan pressure, live-play score (rounded) and label (from the unrounded score)."""
    c, a = F.col, F.col("a").cast("double")
    share = lambda x, none: F.when(c("a") > 0, c(x) / a).otherwise(F.lit(none))
    dominance = F.when(c("a") > 0, F.greatest("right", "left") / a).otherwise(F.lit(0.0))
    m = m.withColumn("pan", clip01((dominance - 0.8) / 0.2) * clip01(F.abs(c("vx_median")) / 120.0) * clip01(1.0 - c("vy_abs_median") / 40.0))
    calm = F.greatest(F.lit(0.05), 1.0 - 0.95 * c("pan"))
    changed = clip01(c("changed") / F.greatest(c("n"), F.lit(1)))
    ball = F.when(F.coalesce(c(ball_confidence), F.lit(0.0)) >= 0.35, 0.02).otherwise(0.0)
    live = 0.30 * clip01((c("on_court") - 1) / 3.0) + 0.25 * clip01(c("speed_sum") / 180.0) * calm + 0.20 * clip01(c("speed_median") / 40.0) * calm + 0.15 * clip01(c("fast") / 2.0) * calm + 0.08 * (1.0 - changed) + ball
    dead = (
        0.25 * (1.0 - clip01((c("on_court") - 1) / 2.0)) + 0.15 * (1.0 - clip01(c("speed_sum") / 80.0)) + 0.15 * clip01(share("edge", 1.0)) + 0.10 * clip01(share("mismatch", 0.0)) + 0.10 * changed + 0.35 * c("pan")
    )
    m = m.withColumn("raw", clip01(0.5 + 0.5 * (live - dead)))
    return m.withColumn("label", label(c("raw"))).withColumn("score", F.round("raw", 4)).drop("raw")


def label(score: Column) -> Column:
    """live_play, dead_ball or uncertain."""
    return F.when(score >= LIVE, "live_play").when(score <= DEAD, "dead_ball").otherwise("uncertain")


def with_state(scored: DataFrame) -> DataFrame:
    """Frames with the hysteresis state: entering, staying and leaving live play by trailing windows of 5 and 8 frames.

    Only the bit "is live" is carried: it is set by entering, cleared where staying fails or leaving holds, else kept.
    """
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    w5, w8 = w.rowsBetween(-4, 0), w.rowsBetween(-7, 0)
    s = F.col("score")
    over = lambda f, t, win: F.count_if(f(s, t)).over(win)
    ge, le = (lambda x, t: x >= t), (lambda x, t: x <= t)
    d = scored.withColumns({"n5": F.count("*").over(w5), "n8": F.count("*").over(w8), "avg5": F.avg("score").over(w5), "avg8": F.avg("score").over(w8), "hi5": over(ge, 0.55, w5), "lo5": over(le, 0.45, w5), "lo8": over(le, 0.45, w8)})
    d = d.withColumns(
        {
            "stays": (F.col("avg5") >= LIVE) | (F.col("hi5") >= 2),
            "enters": (F.col("n5") >= 3) & (F.col("avg5") >= LIVE) & (F.col("hi5") >= 3),
            "leaves": (F.col("n8") >= 6) & (F.col("avg8") <= DEAD) & (F.col("lo8") >= 6),
            "dies": (F.col("n5") >= 3) & (F.col("avg5") <= DEAD) & (F.col("lo5") >= 3),
        }
    )
    d = d.withColumn("bit", F.when(F.col("enters"), 1).when(~(~F.col("leaves") & F.col("stays")), 0))
    d = d.withColumn("live", F.coalesce(F.last("bit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    d = d.withColumn("was_live", F.coalesce(F.lag("live").over(w), F.lit(0)) == 1)
    state = F.when(F.col("live") == 1, "live_play").when(F.col("was_live"), F.when(F.col("leaves"), "dead_ball").otherwise("uncertain")).otherwise(F.when(F.col("dies"), "dead_ball").otherwise("uncertain"))
    # before anything is known a clip is dead
    return d.withColumn("state", state).drop("bit", "live", "was_live", "stays", "enters", "leaves", "dies")


def with_segment(frames: DataFrame, value: str = "label") -> DataFrame:
    """Frames numbered by stretches of an equal ``value``."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return frames.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w) - 1).drop("__new")


def segments(frames: DataFrame) -> DataFrame:
    """One row per stretch: label, first and last frame and time, frames, mean and peak score, dominant signal."""
    n, motion, present = F.count("*"), F.sum("speed_sum"), F.sum("on_court")
    balls = F.count_if(F.coalesce(F.col("ball_conf"), F.lit(0.0)) >= 0.35)
    dominant = (
        F.when((F.first("label") == "live_play") & (balls >= F.greatest(F.lit(2), F.floor(n / 3))), "ball_and_on_court_motion")
        .when(F.first("label") == "live_play", F.when(motion >= present * 20.0, "on_court_motion").otherwise("stable_on_court_presence"))
        .when(F.first("label") == "dead_ball", F.when(motion <= present * 12.0, "low_on_court_motion").otherwise("edge_heavy_idle_scene"))
        .otherwise("mixed_evidence")
    )
    return with_segment(frames).groupBy("clip_id", "segment").agg(
        F.first("label").alias("label"),
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.min("t_ms").alias("first_ms"),
        F.max("t_ms").alias("last_ms"),
        F.count("*").alias("n"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.max("score").alias("peak_score"),
        dominant.alias("dominant"),
    )


def with_own_segment(frames: DataFrame) -> DataFrame:
    """Frames with their stretch's label, first and last frame and duration: the stretch number is known, so nothing is searched."""
    numbered = with_segment(frames)
    whole = Window.partitionBy("clip_id", "segment")
    return numbered.withColumns({"segment_first": F.min("frame_idx").over(whole), "segment_last": F.max("frame_idx").over(whole), "segment_ms": F.max("t_ms").over(whole) - F.min("t_ms").over(whole)})
