import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfold.sources import jsonl, mocap
from trackfold.streaming import events


def test_lines_skip_blanks_and_missing_paths(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind": "ball", "t_ms": 33, "x": 1.5}\n\nbroken\n{"kind": "player", "t_ms": 66}\n')
    rows = jsonl.read_lines(spark, str(tmp_path / "a.jsonl")).cache()
    assert [r.kind for r in rows.where("_bad IS NULL").orderBy("t_ms").collect()] == ["ball", "player"]
    assert rows.where("_bad IS NOT NULL").count() == 1
    assert jsonl.read_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        jsonl.read_lines(spark, str(tmp_path / "none"), must_exist=True)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        jsonl.read_lines(spark, str(tmp_path / "a.jsonl"), strict=True).collect()


def test_artifacts_and_round_trip(spark, tmp_path):
    doc = {"clip_id": "c1", "schema_version": "1.0.0", "frames": [{"frame_idx": 0, "t_ms": 0, "detections": [{"track_id": 3, "confidence": 0.5}, {"track_id": 4}]}, {"frame_idx": 1, "t_ms": 33, "detections": [{"class_id": 0}]}]}
    (tmp_path / "c1.json").write_text(json.dumps(doc, indent=1))
    a = jsonl.read_artifacts(spark, str(tmp_path / "c1.json"))
    d = jsonl.detections(jsonl.frames(a))
    assert [(r.frame_idx, r.det_ord, r.track_id) for r in d.collect()] == [(0, 0, 3), (0, 1, 4)]
    jsonl.write_artifacts(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    clips = spark.createDataFrame([("c1",), ("c2",)], "clip_id string")
    assert jsonl.listed_clips(clips, a).count() == 1


def test_clips_of_the_four_domains(spark, tmp_path):
    artifacts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "clip_id string")
    assert jsonl.clips_of_domains(spark, str(tmp_path), artifacts).count() == 0
    for name in ("nba/a.mp4", "nba/x.mp4", "nba/b.mov", "youth/b.mp4", "street/c.mp4", "playground/d.MP4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"film")
    got = sorted(tuple(r) for r in jsonl.clips_of_domains(spark, str(tmp_path), artifacts).collect())
    assert got == [("a", "nba", "nba/a.mp4"), ("b", "youth", "youth/b.mp4")]


def test_calibration_shapes(spark, tmp_path):
    m = [[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]
    (tmp_path / "old.json").write_text(json.dumps({"z": {"h_matrix": m}}))
    assert jsonl.read_calibration(spark, str(tmp_path / "new.json"), str(tmp_path / "old.json")).first().clip_id == "z"
    (tmp_path / "new.json").write_text(json.dumps({"a": {"h_sequence": {"7": m}}, "b": {"h_matrix": m}}))
    rows = jsonl.read_calibration(spark, str(tmp_path / "new.json"), str(tmp_path / "old.json")).orderBy("clip_id").collect()
    assert [(r.clip_id, r.frame_idx, len(r.h)) for r in rows] == [("a", 7, 9), ("b", None, 9)]
    (tmp_path / "bad.json").write_text("{")
    assert jsonl.read_calibration(spark, str(tmp_path / "bad.json")).count() == 0


def test_contract_and_slices(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 2, "c": "x"}',), ('{"a": 1.5, "b": 2, "c": "x"}',), ('{"a": 1, "b": 2.5}',), ("no",)], "value string")
    out = jsonl.contract_errors(rows, {"a": "int", "b": "float", "c": "string"})
    assert [r.problem for r in out.collect()] == [None, "a", "c", "not_json"]
    clips = spark.createDataFrame([("a", 25.0), ("b", 29.0), ("c", 3.0)], "clip_id string, duration double")
    got = jsonl.clip_slices(clips, 10.0).groupBy("clip_id").agg(F.count("*").alias("n")).collect()
    assert {r.clip_id: r.n for r in got} == {"a": 2, "b": 3}


SKELETON = """:units
length 1.0
:root
order TX TY TZ RX RY RZ
axis XYZ
position 0 0 0
orientation 0 0 0
:bonedata
begin
id 1
name a
direction 0 0 2
length 10
axis 0 0 0 XYZ
dof rx ry rz
end
begin
id 2
name b
direction 1 0 0
length 4
axis 0 0 0 XYZ
end
:hierarchy
begin
root a
a b
end
"""


def test_motion_capture(spark, tmp_path):
    s = mocap.parse_skeleton(SKELETON)
    assert [b.name for b in s.bones] == ["a", "b"]
    stack = mocap.pose_stacks(s, {"root": np.array([[1.0, 2, 3, 0, 0, 0]]), **{b.name: np.array([[90.0 if c == "rz" else 0.0 for c in b.dof]]) * (b.name == "a") for b in s.bones}}, 1)[0]
    at = dict(zip(["root", "a", "b"], stack, strict=True))
    np.testing.assert_allclose(at["root"], np.array([1, 3, 2]) * 2.54)
    np.testing.assert_allclose(at["a"] - at["root"], [0, 0, 25.4], atol=1e-9)
    np.testing.assert_allclose(at["b"] - at["a"], [0, 4 * 2.54, 0], atol=1e-9)
    (tmp_path / "m.amc").write_text("#!x\n:FULLY\nstray 1\n1\nroot 1 2 3 0 0 0\na 0 0 90\nunknown 5\n2\nroot 0 0 0 0 0 0\n")
    motion = mocap.read_motion(spark, str(tmp_path / "m.amc"))
    assert sorted((r.frame, b.bone, len(b.channels)) for r in motion.collect() for b in r.bones) == [(1, "a", 3), (1, "root", 6), (1, "unknown", 1), (2, "root", 6)]
    got = {(r.frame, r.bone): (r.x, r.y, r.z) for r in mocap.solved(motion, s).collect()}
    np.testing.assert_allclose(got[1, "b"], at["b"])
    assert len(got) == 6
    with pytest.raises(ValueError, match="hierarchy"):
        mocap.parse_skeleton(SKELETON.split(":hierarchy")[0])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"kind": k, "t_ms": t}) for k, t in (("ball", 0), ("ball", 5000), ("player", 12000))))
    q = events.counts(events.read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r.n) for r in spark.table("kinds").collect()) == [("ball", 2), ("player", 1)]


def _plain_positions(skeleton, frame):
    """One frame, bone by bone, with matrices of single axes."""

    def turn(axis, degrees):
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        return np.array({"rx": [[1, 0, 0], [0, c, -s], [0, s, c]], "ry": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "rz": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis])

    def product(order, angles):
        out = np.eye(3)
        for a in order:
            out = out @ turn(a, angles.get(a, 0.0))
        return out

    root = frame.get("root", {})
    place = {"root": 2.54 * np.array([root.get("tx", skeleton.position[0]), root.get("tz", skeleton.position[2]), root.get("ty", skeleton.position[1])])}
    turned = {"root": product(skeleton.axes, {a: root.get(a, skeleton.orientation[i]) for i, a in enumerate(("rx", "ry", "rz"))})}
    for b in skeleton.bones:
        place[b.name] = place[b.parent] + turned[b.parent] @ (b.direction * b.length * 2.54)
        turned[b.name] = turned[b.parent] @ b.basis @ product(b.dof, frame.get(b.name, {})) @ b.basis.T
    return place


def test_stacks_of_frames_equal_frames_one_by_one(spark, tmp_path):
    """Random channels, lines that lack, repeated lines, short lines, and batches of a few frames."""
    rng = np.random.default_rng(3)
    bones = [mocap.Bone(n, *(lambda d: (d / np.linalg.norm(d), float(rng.uniform(1, 9))))(rng.normal(size=3)), mocap.turns(["rx", "ry", "rz"], rng.uniform(-90, 90, (1, 3)))[0], dof, up) for n, dof, up in (("a", ["rx", "ry", "rz"], "root"), ("b", ["rz"], "root"), ("c", [], "a"), ("d", ["rz", "rx"], "c"), ("e", ["ry"], "b"))]
    s = mocap.Skeleton(["tx", "ty", "tz", "rx", "ry", "rz"], ["rz", "ry", "rx"], np.array([1.0, 2, 3]), np.array([10.0, 20, 30]), bones)
    dof = {"root": s.order} | {b.name: b.dof for b in bones}
    lines, frames = [], {}
    for f in range(1, 41):
        lines.append(str(f))
        frames[f] = {}
        for name in rng.permutation(list(dof)).tolist() + ["a"] * (f % 5 == 0):
            if rng.random() < 0.8:
                values = rng.uniform(-180, 180, len(dof[name]) - (rng.random() < 0.2 and len(dof[name]) > 1)).round(3).tolist()
                lines.append(" ".join([name, *map(str, values)]))
                frames[f][name] = dict(zip(dof[name], values, strict=False))
    (tmp_path / "m.amc").write_text(":DEGREES\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = mocap.solved(mocap.read_motion(spark, str(tmp_path / "m.amc")), s)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.frame, r.bone): (r.x, r.y, r.z) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 240
    for f, channels in frames.items():
        for bone, place in _plain_positions(s, channels).items():
            np.testing.assert_allclose(got[f, bone], place, atol=1e-9)
