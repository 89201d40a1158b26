"""Policies and configurations of one's own, and what they change."""

import pytest

from trackfold.operators import continuity, identity
from trackfold.operators.policy import IdentityPolicy
from trackfold.sources import jsonl, reports, rules


def test_settings_of_a_policy_file(spark, tmp_path):
    own = IdentityPolicy(0.1, 0.2, 0.3, False, False, 7, 0.4, 100.0, 1.5, False, 0.6, 5, 0.7)
    reports.write_document(spark, str(tmp_path / "p"), rules.identity_policy_document(own))
    assert rules.identity_settings(rules.read_document(spark, str(tmp_path / "p"))) == own
    document = rules.identity_policy_document()
    for section in (document["continuity"], document["identity"], document["identity"]["hypotheses"]):
        for switch in ("reset_identity_on_discontinuity", "occlusion_first_within_segment", "enabled"):
            section.pop(switch, None)
    assert rules.identity_settings(document) == IdentityPolicy()


@pytest.mark.parametrize("value", [None, "far", [1]])
def test_a_limit_must_be_a_number(value):
    document = rules.identity_policy_document()
    document["identity"]["short_gap"]["max_court_distance"] = value
    with pytest.raises(ValueError, match="short_gap.max_court_distance"):
        rules.identity_settings(document)
    del document["identity"]["short_gap"]["max_court_distance"]
    with pytest.raises(ValueError, match="short_gap.max_court_distance"):
        rules.identity_settings(document)
    document["continuity"] = {}
    with pytest.raises(ValueError, match="lacks sections: continuity"):
        rules.identity_settings(document)


def _ends(spark):
    """Track 1 ends at frame 3; track 2 starts at frame 6, two frames later, behind a cut, some way off."""
    row = lambda t, f, x, segment: (1, t, f, x, 100.0, 50.0, 100.0, 0.0, 0.0, x, 100.0, "dark", 0.9, True, segment)
    rows = [row(1, f, 100.0, 0) for f in range(4)] + [row(2, f, 160.0, 1) for f in range(6, 9)]
    return spark.createDataFrame(rows, "clip_id long, track_id long, frame_idx long, x double, y double, w double, h double, vx double, vy double, court_x double, court_y double, uniform string, conf double, active boolean, segment long")


@pytest.mark.parametrize(
    ("change", "found"),
    [({}, False), ({"reset": False}, True), ({"reset": False, "max_gap": 1}, False), ({"reset": False, "max_gap": 0}, False), ({"reset": False, "max_court": 59.0}, False), ({"reset": False, "max_ratio": 0.5}, False)],
)
def test_each_limit_of_links(spark, change, found):
    policy = IdentityPolicy(link=0.5, **change)
    links = identity.candidates(_ends(spark), policy.link, policy=policy).collect()
    assert [(r.pred, r.succ, r.gap) for r in links] == ([(1, 2, 2)] if found else [])


def test_the_score_of_the_gap_follows_its_limit(spark):
    score = {n: identity.candidates(_ends(spark), 0.1, policy=IdentityPolicy(reset=False, max_gap=n)).first().score for n in (2, 5)}
    assert score[5] - score[2] == pytest.approx(0.06 * (1 - 1 / 5) - 0.06 * (1 - 1 / 2), abs=1e-4)


def test_switch_and_limits_of_hypotheses(spark):
    wide = IdentityPolicy(reset=False)
    links = identity.candidates(_ends(spark), 0.1, policy=wide)
    assert [r.status for r in identity.hypotheses(links, identity.selected(links), wide).collect()] == ["selected"]
    assert identity.hypotheses(links, links.limit(0), IdentityPolicy(with_hypotheses=False)).count() == 0
    assert identity.hypotheses(links, links.limit(0), IdentityPolicy(top=0)).count() == 0


def test_limits_of_cuts(spark):
    rows = [(1, 0, [1, 2], 2, [0.0] * 4), (1, 1, [1, 2], 2, [0.25] * 4), (1, 2, [5, 6], 2, [0.25] * 4)]
    frames = spark.createDataFrame(rows, "clip_id long, frame_idx long, tracks array<int>, n long, signature array<double>")
    cuts = lambda **limits: [r.frame_idx for r in continuity.with_segments(frames, policy=IdentityPolicy(**limits)).where("breaks").orderBy("frame_idx").collect()]
    assert cuts() == []
    assert cuts(visual=0.2, cut=0.6) == [1]
    assert cuts(cut=0.3) == [1, 2]
    assert cuts(cut=0.3, churn=1.1) == [1]


def test_video_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.mp4"), (2, None)], "id long, requested string")
    reports.write_document(spark, str(tmp_path / "c"), {"local_video_path": "b.mp4"})
    reports.write_document(spark, str(tmp_path / "e"), {})
    videos = lambda d, path: [r.video for r in rules.with_video_path(d, str(tmp_path / path)).orderBy("id").collect()]
    assert videos(rows, "c") == ["a.mp4", "b.mp4"]
    assert videos(rows, "e") == ["a.mp4", rules.DEFAULT_VIDEO]
    assert videos(rows.where("id = 1"), "none") == ["a.mp4"]
    with pytest.raises(Exception, match="no configuration"):
        videos(rows, "none")


def test_calibrations_of_several_documents(spark, tmp_path):
    for i, name in enumerate("ab"):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "x.json").write_text('{"%s": {"h_matrix": [[%d, 0, 0], [0, 1, 0], [0, 0, 1]]}}' % (name, i + 2))
    (tmp_path / "part=1" / "y.json").write_text("{broken")
    got = {r.clip_id: r.h[0] for r in jsonl.read_calibration(spark, str(tmp_path)).collect()}
    assert got == {"a": 2.0, "b": 3.0}
