"""Continuity segments: breaks between frames by visual change, change of tracks, and change of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clip01
from .policy import IdentityPolicy

BREAK_CHURN = 0.55


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two id sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def visual_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two signatures; 0 if one is missing or they differ in length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a)).otherwise(F.lit(0.0))


def frame_tracks(detections: DataFrame) -> DataFrame:
    """Per frame: the sorted set of tracks and the number of detections."""
    return detections.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_set("track_id")).alias("tracks"), F.count("*").alias("n"))


def with_segments(frames: DataFrame, signature: str = "signature", policy: IdentityPolicy = IdentityPolicy()) -> DataFrame:
    """Frames with churn, visual change, score, break flag and segment number; the first frame of a clip begins segment 0."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    before = frames.withColumns({"__t": F.lag("tracks").over(w), "__s": F.lag(signature).over(w), "__n": F.lag("n").over(w)})
    first = F.col("__n").isNull()
    d = before.withColumns(
        {
            "visual_delta": F.when(first, 0.0).otherwise(visual_delta(F.col("__s"), F.col(signature))),
            "churn": F.when(first, 0.0).otherwise(1.0 - jaccard(F.col("__t"), F.col("tracks"))),
            "count_delta": F.when(first, 0).otherwise(F.abs(F.col("n") - F.col("__n"))).cast("long"),
        }
    )
    v, c = F.col("visual_delta"), F.col("churn")
    d = d.withColumn("discontinuity", 0.60 * clip01(v / policy.visual) + 0.30 * clip01(c / policy.churn) + 0.10 * clip01(F.col("count_delta") / 6.0))
    d = d.withColumn("breaks", ~first & ((F.col("discontinuity") >= policy.cut) | ((v >= policy.visual) & (c >= BREAK_CHURN))))
    return d.withColumn("continuity_segment", F.sum(F.col("breaks").cast("long")).over(w)).drop("__t", "__s", "__n")
