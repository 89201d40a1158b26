import pytest
from pyspark.sql import functions as F

from trackfold.operators import attribution, poses
from trackfold.sources import jsonl


def test_pose_of_a_box_in_pixels_and_in_shares(spark):
    joints = "array<struct<x:double,y:double>>"
    made = spark.createDataFrame(
        [
            (1, 1, 0, [(0.1, 0.1), (0.9, 0.9), (0.0, 0.5)]),  # half of the two valid joints are in the box
            (1, 1, 1, [(0.1, 0.1), (0.9, 0.1)]),  # the same share, later
            (1, 1, 2, [(0.0, 0.0)]),  # no valid joint
            (1, 2, 0, [(0.1, 0.1), (0.9, 0.9), (0.8, 0.9), (0.7, 0.9)]),  # a quarter is too little
        ],
        f"clip_id long, frame_idx long, pose_no long, joints {joints}",
    )
    boxes = spark.createDataFrame([(1, 1, 1, 64.0, 48.0, 64.0, 48.0), (1, 1, 2, 0.1, 0.1, 0.1, 0.1), (1, 2, 1, 0.1, 0.1, 0.1, 0.1), (1, 3, 1, 0.1, 0.1, 0.1, 0.1)], "clip_id long, frame_idx long, slot long, x double, y double, w double, h double")
    got = {(r.frame_idx, r.slot): (r.pose_no, r.share) for r in poses.poses_of_boxes(boxes, made, 640.0, 480.0).collect()}
    assert got == {(1, 1): (0, 0.5), (1, 2): (0, 0.5), (2, 1): (None, None), (3, 1): (None, None)}


def test_group_ids_and_order(spark):
    frames = spark.range(5).selectExpr("7L clip_id", "id frame_idx")
    groups = spark.createDataFrame([(7, "g2", 1, 3), (7, "g1", 3, 9), (7, "g2", 3, 3), (8, "g3", 0, 4)], "clip_id long, group_id string, start_frame long, end_frame long")
    got = {r.frame_idx: list(r.ids) for r in poses.with_group_ids(frames, groups, "ids").collect()}
    assert got == {0: [], 1: ["g2"], 2: ["g2"], 3: ["g1", "g2"], 4: ["g1"]}
    rows = spark.createDataFrame([(1, None, 3, False, 0), (1, 2, None, False, 1), (1, 2, 5, False, 2), (1, 2, 5, True, 3), (1, None, None, False, 4)], "frame_idx long, identity_id long, track_id long, synthesized boolean, slot long").withColumn("clip_id", F.lit(1))
    assert [r.slot for r in poses.detection_order(rows).orderBy("position").collect()] == [3, 2, 1, 0, 4]


def test_an_event_type_without_a_rule_raises(spark):
    known = list(attribution.RULES)
    rows = spark.createDataFrame([(k,) for k in known], "event_type string")
    got = {r.event_type: r.required_terminal_event for r in attribution.with_terminal_event(rows).collect()}
    assert got == {k: r[-1] for k, r in attribution.RULES.items()}
    for bad in ("dunk_contest", None):
        with pytest.raises(Exception, match="no rule for event type"):
            attribution.with_terminal_event(spark.createDataFrame([(bad,)], "event_type string")).collect()


def test_newer_dataset_first(spark, tmp_path):
    (tmp_path / "v2.jsonl").write_text('{"label": "old"}\n')
    paths = [f"{tmp_path}/v3.jsonl", f"{tmp_path}/v2.jsonl"]
    assert [r.label for r in jsonl.first_that_exists(spark, paths, "label string").collect()] == ["old"]
    (tmp_path / "v3.jsonl").write_text('{"label": "new"}\n')
    assert [r.label for r in jsonl.first_that_exists(spark, paths, "label string").collect()] == ["new"]
    with pytest.raises(FileNotFoundError):
        jsonl.first_that_exists(spark, [f"{tmp_path}/none"], "label string")
