"""Poses of boxes, identity groups of frames, and the order of detections within a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A box whose numbers are all at most NORMALISED is in shares of the frame; a pose needs more than SHARE of its joints in it.
NORMALISED, SHARE = 1.1, 0.3


def share_in_box(joints: Column, x: Column, y: Column, w: Column, h: Column, frame_w: float, frame_h: float) -> Column:
    """Share of a pose's valid joints (both coordinates above 0) that lie in a box given by centre and size; null without any."""
    small = F.greatest(x, y, w, h) <= NORMALISED
    across, down = F.when(small, 1.0).otherwise(frame_w), F.when(small, 1.0).otherwise(frame_h)
    valid = F.filter(joints, lambda j: (j.x > 0) & (j.y > 0))
    inside = F.filter(valid, lambda j: j.x.between((x - w / 2) / across, (x + w / 2) / across) & j.y.between((y - h / 2) / down, (y + h / 2) / down))
    return F.when(F.size(valid) > 0, F.size(inside) / F.size(valid))


def poses_of_boxes(boxes: DataFrame, poses: DataFrame, frame_w: float, frame_h: float, keys: tuple[str, ...] = ("clip_id", "frame_idx")) -> DataFrame:
    """``boxes`` (keys, slot, x, y, w, h) with pose_no and share of the pose (keys, pose_no, joints) that fits best.

    The pose with the largest share of valid joints in the box wins, of equal ones the first; a box whose best share is
    not above SHARE, or whose frame has no pose, has nulls.  Boxes meet the poses of their own frame only.
    """
    met = boxes.join(poses, list(keys))
    share = share_in_box(*(F.col(c) for c in ("joints", "x", "y", "w", "h")), frame_w, frame_h)
    met = met.withColumn("share", share).where(F.col("share") > SHARE)
    best = met.groupBy(*keys, "slot").agg(F.max_by(F.struct("pose_no", "share"), F.struct("share", -F.col("pose_no"))).alias("best"))
    return boxes.join(best, [*keys, "slot"], "left").select(*boxes.columns, F.col("best.pose_no").alias("pose_no"), F.col("best.share").alias("share"))


def with_group_ids(frames: DataFrame, groups: DataFrame, name: str = "identity_hypothesis_group_ids") -> DataFrame:
    """``frames`` (clip_id, frame_idx) with the sorted distinct ids of the groups (clip_id, group_id, start_frame, end_frame) that last over them.

    Each group is spread over its frames, so the range condition becomes an equality.
    """
    spread = groups.select("clip_id", "group_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx"))
    ids = spread.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_set("group_id")).alias(name))
    kind = ids.schema[name].dataType
    return frames.join(ids, ["clip_id", "frame_idx"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def detection_order(rows: DataFrame, before: str = "slot") -> DataFrame:
    """``rows`` with ``position``: within a frame by identity, then track, nulls last, then synthesized ones first, then by ``before``."""
    order = Window.partitionBy("clip_id", "frame_idx").orderBy(F.col("identity_id").asc_nulls_last(), F.col("track_id").asc_nulls_last(), F.col("synthesized").desc_nulls_last(), before)
    return rows.withColumn("position", F.row_number().over(order))
