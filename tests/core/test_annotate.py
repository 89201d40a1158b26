"""All passes in order over a small scene: what a pass makes must reach the passes behind it."""

import pytest
from pyspark.sql import functions as F

from trackfold.operators.annotate import annotate

FRAMES = 12


@pytest.fixture(scope="module")
def scene(spark):
    """Track 7 has a gap at frame 4; track 3 ends at frame 5 and goes on as track 19 at frame 7; at frame 9 the view changes."""
    rows = []
    for f in range(9):
        if f != 4:
            rows.append((1, 7, f, 1, 130.0 + 10 * f, 240.0, 50.0, 120.0, 0.9, 1000.0 + 20 * f, 700.0, "dark", [0.7, 0.3] + [0.0] * 6))
        if f != 6:
            rows.append((1, 3 if f < 6 else 19, f, 2, 400.0 + 2 * f, 260.0, 52.0, 118.0, 0.92, 1500.0, 800.0 + 5 * f, "light", [0.2, 0.8] + [0.0] * 6))
    rows += [(1, 40, f, 1, 300.0, 250.0, 50.0, 120.0, 0.9, 1200.0, 700.0, "dark", [0.7, 0.3] + [0.0] * 6) for f in range(9, FRAMES)]
    d = spark.createDataFrame(rows, "clip_id long, track_id long, frame_idx long, slot long, x double, y double, w double, h double, conf double, court_x double, court_y double, uniform string, hist array<double>")
    signature = F.array(*[F.when(F.col("id") < 9, 0.0).otherwise(1.0) for _ in range(4)])
    signatures = spark.range(FRAMES).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("frame_idx"), signature.alias("signature"))
    balls = spark.range(0, FRAMES, 2).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("frame_idx"), F.lit(0.8).alias("conf"))
    # the number is read on both parts of a player, and the parts alone have too few reads
    reads = spark.createDataFrame([(1, 3, 1, 2, "23", 0.95, 80.0), (1, 3, 2, 2, "23", 0.95, 70.0), (1, 19, 8, 2, "23", 0.95, 60.0), (1, 7, 1, 1, "8", 0.95, 10.0)], "clip_id long, track_id long, frame_idx long, slot long, read string, conf double, sharpness double")
    out = annotate(d, signatures, balls, reads, 640, 480, 30.0)
    return d.count(), [r.asDict(recursive=True) for r in out.detections.collect()], [r.asDict(recursive=True) for r in out.frames.collect()], [tuple(r) for r in out.links.select("pred", "succ").collect()]


def test_tracks_are_linked_and_gaps_filled(scene):
    n, rows, _, links = scene
    assert links == [(3, 19)]
    assert {r["track_id"] for r in rows} == {7, 3, 40}
    made = {(r["track_id"], r["frame_idx"]): r for r in rows if r["synthesized"]}
    assert set(made) == {(7, 4), (3, 6)} and len(rows) == n + 2
    assert len({(r["track_id"], r["frame_idx"]) for r in rows}) == len(rows)


def test_the_last_smoothing_and_scores_see_made_rows(scene):
    _, rows, _, _ = scene
    for r in rows:
        assert r["svx"] is not None and r["speed"] is not None and r["active"]["candidate"] is not None
    at = {r["frame_idx"]: r for r in rows if r["track_id"] == 7}
    assert at[4]["x"] == pytest.approx(170.0, abs=1.5) and at[4]["svx"] > 0
    # one track of all its frames: the count that the score uses has the made row
    assert at[4]["n_frames"] == 9


def test_the_number_is_that_of_the_whole_identity(scene):
    _, rows, _, _ = scene
    assert {r["jersey"] for r in rows if r["track_id"] == 3} == {"23"}
    assert {r["jersey"] for r in rows if r["track_id"] != 3} == {None}


def test_frames_follow_the_cut_and_have_states(scene):
    _, _, frames, _ = scene
    segments = {f["frame_idx"]: f["continuity_segment"] for f in frames}
    assert [segments[i] for i in range(FRAMES)] == [0] * 9 + [1] * 3
    assert all(f["state"] in ("live_play", "dead_ball", "uncertain") for f in frames)
    assert [f["ball_conf"] for f in sorted(frames, key=lambda f: f["frame_idx"])] == [0.8, None] * 6
