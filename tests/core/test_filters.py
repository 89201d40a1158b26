"""The track filters against a plain fold, over block borders and batch borders."""

import numpy as np
import pytest

from trackfold.operators import tracks


def fold_1d(z):
    x, p, out = z[0], 1.0, []
    for i, v in enumerate(z):
        if i:
            x, p = tracks.kalman_step(x, p, v, 1e-4, 1e-2)
        out.append(x)
    return out


def fold_2d(x, y, dt):
    s, (a, b, e), out = np.array([x[0], y[0], 0.0, 0.0]), (25.0, 0.0, 25.0), []
    for i in range(len(x)):
        if i:
            px, py = s[0] + dt * s[2], s[1] + dt * s[3]
            a, b, e = a + 2 * dt * b + dt * dt * e + 1.0, b + dt * e, e + 4.0
            k1, k2 = a / (a + 9.0), b / (a + 9.0)
            s = np.array([px + k1 * (x[i] - px), py + k1 * (y[i] - py), s[2] + k2 * (x[i] - px), s[3] + k2 * (y[i] - py)])
            a, b, e = (1 - k1) * a, (1 - k1) * b, e - k2 * b
        out.append(s)
    return np.array(out)


@pytest.fixture
def rows():
    rng = np.random.default_rng(4)
    out = []
    for clip, track, n, gap in ((1, 1, 700, 1), (1, 2, 1, 1), (2, 1, 260, 3), (2, 7, 40, 1), (3, 3, 3, 5000)):
        frames = np.cumsum(rng.integers(1, gap + 1, n)) - 1
        walk = np.cumsum(rng.normal(0, 5, (n, 2)), 0)
        out += [(clip, track, int(f), float(x), float(y), f"r{i}") for i, (f, (x, y)) in enumerate(zip(frames, walk, strict=True))]
    return out


@pytest.mark.parametrize("block,batch", [(4096, 10_000), (64, 10_000), (100, 37), (1, 50)])
def test_filters_equal_the_fold(spark, rows, monkeypatch, block, batch):
    monkeypatch.setattr(tracks, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "clip_id long, track_id long, frame_idx long, x double, y double, tag string").repartition(5)
        one = {(r.clip_id, r.track_id, r.frame_idx): r.smooth for r in tracks.kalman_1d(df, "x").collect()}
        two = {(r.clip_id, r.track_id, r.frame_idx): (r.sx, r.sy, r.svx, r.svy, r.tag) for r in tracks.kalman_2d(df, 30.0, ("tag",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(one) == len(two) == len(rows)
    for key in {r[:2] for r in rows}:
        mine = sorted(r for r in rows if r[:2] == key)
        x, y = [r[3] for r in mine], [r[4] for r in mine]
        np.testing.assert_allclose([one[r[:3]] for r in mine], fold_1d(x), atol=1e-9)
        np.testing.assert_allclose([two[r[:3]][:4] for r in mine], fold_2d(x, y, 1 / 30.0), atol=1e-9)
        assert [two[r[:3]][4] for r in mine] == [r[5] for r in mine]


def test_a_long_track_is_split_over_tasks(spark):
    """One track of 300,000 rows: many blocks, more than one task, and the fold's values at its end."""
    from pyspark.sql import functions as F

    n = 300_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("clip_id"), F.lit(1).cast("long").alias("track_id"), F.col("id").alias("frame_idx"), (F.col("id") * 7919 % 1000 + 0.0).alias("x"))
    out = tracks.kalman_1d(df, "x")
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    want = fold_1d([float(i * 7919 % 1000) for i in range(n)])
    got = {r.frame_idx: r.smooth for r in out.where("frame_idx % 9973 = 0 OR frame_idx > 299990").collect()}
    np.testing.assert_allclose([got[f] for f in sorted(got)], [want[f] for f in sorted(got)], atol=1e-9)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "clip_id long, track_id long, frame_idx long, x double, y double")
    assert tracks.kalman_1d(empty, "x").count() == 0 and tracks.kalman_2d(empty, 30.0).count() == 0


def test_tracks_stay_whole_where_joins_change_while_running(spark):
    """A join that becomes a broadcast one at run time is read where it lies; rows of a track must come together all the same."""
    from pyspark.sql import functions as F

    i = F.col("id")
    df = spark.range(0, 60_000, 1, 12).select((i % 500).alias("clip_id"), (i * 7 % 3).alias("track_id"), F.floor(i / 1500).alias("frame_idx"), (i * 7919 % 1000 + 0.0).alias("x"), (i * 104_729 % 700 + 0.0).alias("y"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100MB"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        one = {(r.clip_id, r.track_id, r.frame_idx): r.smooth for r in tracks.kalman_1d(df, "x").collect()}
        two = {(r.clip_id, r.track_id, r.frame_idx): (r.sx, r.sy, r.svx, r.svy) for r in tracks.kalman_2d(df, 30.0).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    mine = {}
    for r in sorted(df.collect()):
        mine.setdefault((r.clip_id, r.track_id), []).append(r)
    for rows in mine.values():
        x, y = [r.x for r in rows], [r.y for r in rows]
        np.testing.assert_array_equal([one[tuple(r[:3])] for r in rows], fold_1d(x))  # the very same doubles
        np.testing.assert_array_equal([two[tuple(r[:3])] for r in rows], fold_2d(x, y, 1 / 30.0))
