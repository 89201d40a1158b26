import copy
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfold.operators import attribution, behaviour, features, synthetic
from trackfold.plans.documents import _STICKS
from trackfold.sources import mocap, reports, rules


def test_rules_come_back_from_json_and_yaml(spark, tmp_path):
    document = rules.event_rules_document()
    (tmp_path / "rules.json").write_text(json.dumps(document))
    read = rules.event_rules(rules.read_document(spark, str(tmp_path / "rules.json")))
    assert (read.rules, read.max_gap_ms) == (attribution.RULES, attribution.MAX_GAP_MS)
    assert sorted(read.stat_deltas) == sorted(attribution.STAT_DELTAS)
    assert [r[:4] for r in rules.kinematic_rules(rules.kinematic_rules_document())] == [tuple(r[:4]) for r in behaviour.RULES]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text(yaml.safe_dump(document, sort_keys=False))
    assert rules.event_rules(rules.read_document(spark, str(tmp_path / "rules.yaml"))) == read
    with pytest.raises(FileNotFoundError):
        rules.read_document(spark, str(tmp_path / "none.json"))
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        rules.read_document(spark, str(tmp_path / "list.json"))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda d: d.update(kind="other"), "must declare kind"),
        (lambda d: d.update(assumptions={}), "lack assumptions"),
        (lambda d: d.update(events={}), "lack events"),
        (lambda d: d["events"].pop("steal"), "lack events: steal"),
        (lambda d: d["events"]["pass"].pop("temporal"), "pass lacks sections: temporal"),
        (lambda d: d["events"]["catch"].update(actors={}), "catch has no primary actor"),
        (lambda d: d["events"]["catch"].update(counting={}), "catch has no counting.stat_deltas"),
    ],
)
def test_contract_of_event_rules(change, message):
    document = copy.deepcopy(rules.event_rules_document())
    change(document)
    with pytest.raises(ValueError, match=message):
        rules.event_rules(document)


def test_policy_labels_and_video(spark, tmp_path):
    policy = {"assumptions": {"a": 1}, "continuity": {"k": 1}, "identity": {"short_gap": {"g": 3}, "hypotheses": {"m": 0.5}}}
    assert rules.identity_policy(policy) is policy
    with pytest.raises(ValueError, match="identity.hypotheses"):
        rules.identity_policy(policy | {"identity": {"short_gap": {"g": 3}, "hypotheses": {}}})
    with pytest.raises(ValueError, match="assumptions, continuity, identity, identity.short_gap"):
        rules.identity_policy({})
    assert rules.labels({"categories": [{"rules": ["b", "a"]}, {"rules": ["c", "a"]}, {}]}) == {"a": 0, "b": 1, "c": 2}
    (tmp_path / "c.json").write_text('{"local_video_path": "clips/x.mp4"}')
    assert rules.video_path(spark, "given.mp4", "/nowhere") == "given.mp4"
    assert rules.video_path(spark, None, str(tmp_path / "c.json")) == "clips/x.mp4"
    (tmp_path / "e.json").write_text("{}")
    assert rules.video_path(spark, None, str(tmp_path / "e.json")) == rules.DEFAULT_VIDEO


def test_controlled_ball_of_a_rule_file(spark):
    document = {"rules": [{"id": "hold", "conditions": [{"ball_state": "controlled"}], "predicates": [{"joint": "tail", "metric": "velocity_x", "operator": ">"}]}]}
    read = rules.kinematic_rules(document)
    pose = F.array(*[F.array(F.lit(0.0), F.lit(0.0)) for _ in range(17)])
    rows = spark.range(20).select(F.lit(1).alias("clip_id"), F.lit(1).alias("track_id"), F.col("id").alias("frame_idx"), pose.alias("pose"), F.lit(True).alias("possession"), (F.col("id") % 2 == 0).alias("controlled"))
    got = {r.frame_idx: r.label for r in behaviour.with_labels(rows, rules=read, controlled="controlled").collect()}
    assert got == {i: "hold" if i >= 14 and i % 2 == 0 else "idle_bystander" for i in range(20)}
    assert rules.kinematic_rules({}) == []


def test_features_of_the_middle_of_the_court(spark):
    joints = [[0.0, 0.0, 0.0] for _ in range(17)]
    joints[11] = joints[12] = [1432.5, 762.0, 100.0]
    skeleton = F.array(*[F.array(*map(F.lit, j)) for j in joints])
    steps = spark.range(30).select(F.lit("s").alias("label"), F.col("id").cast("int").alias("step"), skeleton.alias("skeleton"), F.array(*map(F.lit, [0.0, 0.0, 0.0])).alias("ball"))
    made = synthetic.samples(steps, synthetic.MOVE_CAMERA, "label").first().features
    assert np.shape(made) == (30, 72)
    np.testing.assert_allclose([r[-2:] for r in made], [[1.4325, 0.762]] * 30, atol=0.005)
    assert not np.any(np.array(made)[:, 34:68])


def test_dataset_of_takes(spark, tmp_path):
    (tmp_path / "a.asf").write_text(_STICKS)
    (tmp_path / "long.amc").write_text(":DEGREES\n" + "".join(f"{i}\nroot {i} 0 0 0 0 0\n" for i in range(1, 72)))
    (tmp_path / "short.amc").write_text(":DEGREES\n" + "".join(f"{i}\nroot {i} 0 0 0 0 0\n" for i in range(1, 4)))
    with pytest.warns(UserWarning, match="none.amc"):
        d = mocap.capture_dataset(spark, str(tmp_path), [("a.asf", "long.amc", "walk"), ("a.asf", "none.amc", "run"), ("a.asf", "short.amc", "step")])
    got = {r.label: np.array(r.features_v2) for r in d.collect()}
    assert {k: v.shape for k, v in got.items()} == {"walk": (30, 72), "step": (3, 72)}
    # frames of evenly spaced places: the hips are at the root's x
    want = np.linspace(0, 70, 30).astype(int) + 1
    np.testing.assert_allclose(got["walk"][:, 70], want * mocap.CM_PER_INCH * 0.001, atol=1e-9)
    with pytest.warns(UserWarning):
        assert mocap.capture_dataset(spark, str(tmp_path), [("no.asf", "no.amc", "x")]).count() == 0


def test_a_frame_without_all_bones_has_no_joints(spark):
    bones = [(b, 0.0, 0.0, 0.0) for b in ["head", *mocap.COCO_BONES]]
    rows = [("f", 1, *b) for b in bones] + [("f", 2, *b) for b in bones[1:]] + [("f", 1, "root", 9.0, 9.0, 9.0)]
    d = spark.createDataFrame(rows, "file string, frame long, bone string, x double, y double, z double")
    got = {r.frame: r.joints for r in mocap.coco_poses(d).collect()}
    assert len(got[1]) == 17 and got[2] is None


def test_manifest_ignores_order_but_not_repeats(spark):
    def digest(labels):
        rows = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("features", F.array_repeat(F.array_repeat(F.lit(0.5), 72), 30))
        return features.manifest(rows.repartition(3), "d").first()

    a, b, c = digest("xyx"), digest("xxy"), digest("xy")
    assert a.sha256_hash == b.sha256_hash != c.sha256_hash
    assert (a.validation_status, a.sample_count, a.n_errors) == ("pass", 3, 0)
    empty = features.manifest(spark.createDataFrame([], "label string, features array<array<double>>"), "d").first()
    assert (empty.sample_count, empty.class_distribution) == (0, {})


def test_fixture_files_are_sorted(spark, tmp_path):
    cases = spark.createDataFrame([(2, 1, "b"), (1, 9, "a"), (1, 3, "c")], "clip_id long, frame_idx long, case_id string")
    reports.write_fixture(cases, "notes", f"{tmp_path}/f")
    assert reports.read_document(spark, f"{tmp_path}/f/report") == {"schema_version": "1.0.0", "source": "notes", "case_count": 3}
    lines = [x for p in sorted((tmp_path / "f" / "cases").glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["case_id"] for x in lines] == ["c", "a", "b"]


def test_solved_poses_keep_a_frame_in_one_row(spark, tmp_path):
    """They equal the poses of grouped bones, without an exchange; a file's steps are chosen before lines are parsed."""
    from trackfold.plans.documents import _STICKS

    frames = "".join(f"{n}\nroot {n % 3} {n % 5} 100 {n} {2 * n} 0\nhead 5\n" for n in range(1, 101))
    (tmp_path / "m.amc").write_text(":DEGREES\n" + frames)
    skeleton = mocap.parse_skeleton(_STICKS)
    motion = mocap.read_motion(spark, str(tmp_path / "m.amc"))
    posed = mocap.solved_poses(motion, skeleton)
    assert "Exchange" not in posed._jdf.queryExecution().executedPlan().toString()
    want = {r.frame: r.joints for r in mocap.coco_poses(mocap.solved(motion, skeleton)).collect()}
    assert {r.frame: r.joints for r in posed.collect()} == want and len(want) == 100
    few = mocap.read_motion(spark, str(tmp_path / "m.amc"), 30)
    assert sorted(r.frame for r in few.collect()) == [i * 99 // 29 + 1 for i in range(30)]
    lacking = mocap.parse_skeleton(_STICKS.replace("head", "skull"))
    assert {r.joints for r in mocap.solved_poses(few, lacking).collect()} == {None}
