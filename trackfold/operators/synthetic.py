"""Training samples of motion capture: skeletons seen by a camera, as feature rows of 30 steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .features import STEPS, feature_row

SCHEMA_VERSION = "2.0.0"
# The cameras of a plain view and of motion capture: intrinsics, rotation, translation.
INTRINSICS = np.array([[1000.0, 0, 960], [0, 1000, 540], [0, 0, 1]])
MOVE_CAMERA = (INTRINSICS, np.eye(3), np.array([0.0, -600.0, -250.0]))
_AT = [300.0, -600.0, 250.0]
_TURN = geometry.look_at(_AT, [0.0, 0.0, 100.0])
CAPTURE_CAMERA = (INTRINSICS, _TURN, -_TURN @ np.array(_AT))


def samples(steps: DataFrame, camera: tuple[np.ndarray, np.ndarray, np.ndarray], *keys: str) -> DataFrame:
    """keys and features: the steps (keys, step, skeleton, ball) of each sample as feature rows in order.

    A pose is what the camera sees, scaled by its own range; the wrists are lifted from it without a homography; the
    position on the court is the middle of the hips.  A sample has few steps, so its rows are gathered.
    """
    seen = F.transform("skeleton", lambda j: geometry.let(geometry.pinhole(j[0], j[1], j[2], *camera), lambda p: F.array(p["u"], p["v"])))
    d = steps.withColumn("pose", geometry.box_normalised(seen))
    d = d.withColumn("before", F.coalesce(F.lag("pose").over(Window.partitionBy(*keys).orderBy("step")), "pose"))
    d = d.withColumn("lifted", geometry.lift_joints(F.col("pose"), F.array(*map(F.lit, geometry.IDENTITY))))
    hip = lambda axis: (F.get("skeleton", F.lit(11))[axis] + F.get("skeleton", F.lit(12))[axis]) / 2
    row = feature_row(F.col("pose"), F.col("before"), F.slice("lifted", 10, 2), F.col("ball"), F.array(hip(0), hip(1)))
    rows = F.array_sort(F.collect_list(F.struct("step", row.alias("row"))))
    return d.groupBy(*keys).agg(F.transform(rows, lambda r: r["row"]).alias("features"))


def capture_samples(poses: DataFrame, label: str) -> DataFrame:
    """label, schema_version, features_v2, file: a sample of each motion file (file, frame, joints), 30 of its frames if it has more.

    The ball is held 5 cm before and above the right wrist.
    """
    w = Window.partitionBy("file")
    d = poses.withColumns({"k": F.row_number().over(w.orderBy("frame")) - 1, "n": F.count("*").over(w)})
    place = F.ceil(F.col("k") * (STEPS - 1) / (F.col("n") - 1))
    d = d.where((F.col("n") <= STEPS) | (F.floor(place * (F.col("n") - 1) / (STEPS - 1)) == F.col("k")))
    wrist = F.get("joints", F.lit(10))
    d = d.select("file", F.col("k").alias("step"), F.col("joints").alias("skeleton"), F.array(wrist[0] + 5, wrist[1], wrist[2] + 5).alias("ball"))
    return samples(d, CAPTURE_CAMERA, "file").select(F.lit(label).alias("label"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("features").alias("features_v2"), "file")
