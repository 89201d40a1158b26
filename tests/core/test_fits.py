"""Homographies from moments against the singular vector of each frame's own matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfold.functions import geometry
from trackfold.operators import calibration

TRUTH = np.array([[2.0, 0.1, 30.0], [0.05, 1.5, 20.0], [1e-4, 2e-4, 1.0]])


def pairs(rng, n, noise):
    uv = rng.uniform([0, 0], [1920, 1080], (n, 2))
    p = np.c_[uv, np.ones(n)] @ TRUTH.T
    return uv, p[:, :2] / p[:, 2:] + rng.normal(0, noise, (n, 2)) if noise else p[:, :2] / p[:, 2:]


@pytest.mark.parametrize("noise", [0.0, 0.5, 5.0])
def test_fits_equal_the_singular_vector(spark, noise):
    rng = np.random.default_rng(5)
    frames = {(c, f): pairs(rng, n, noise) for c in (1, 2) for f, n in enumerate((4, 5, 9, 40, 300))}
    rows = [(c, f, *map(float, a), *map(float, b)) for (c, f), (uv, xy) in frames.items() for a, b in zip(uv, xy, strict=True)]
    df = spark.createDataFrame([*rows, (7, 0, 1.0, 2.0, 3.0, 4.0)], "clip_id long, frame_idx long, u double, v double, x double, y double").repartition(5)
    got = {(r.clip_id, r.frame_idx): np.array(r.h) for r in calibration.fits(df).collect()}
    assert set(got) == set(frames)  # a single pair fits nothing
    corners = np.array([[0, 0], [1920, 0], [0, 1080], [1920, 1080], [960, 540]], float)
    shown = lambda h: (lambda p: p[:, :2] / p[:, 2:])(np.c_[corners, np.ones(5)] @ h.reshape(3, 3).T)
    for key, (uv, xy) in frames.items():
        want = geometry.fit_homography(uv, xy)
        # within a millionth of the court's extent
        np.testing.assert_allclose(shown(got[key]), shown(want), rtol=0, atol=1e-6 * np.abs(shown(want)).max())
        np.testing.assert_allclose(got[key], want, rtol=1e-5, atol=1e-8)


def test_points_that_fix_nothing(spark):
    """Equal points, points of one line, and pairs of no extent give some matrix and no error."""
    rows = [(1, 0, 5.0, 5.0, 1.0, 1.0)] * 4 + [(1, 1, float(i), float(i), float(i), 2.0 * i) for i in range(6)]
    df = spark.createDataFrame(rows, "clip_id long, frame_idx long, u double, v double, x double, y double")
    out = calibration.fits(df).collect()
    assert len(out) == 2 and all(np.isfinite(r.h).all() and len(r.h) == 9 for r in out)
    assert calibration.fits(df.limit(0)).count() == 0


def test_no_group_of_pairs_goes_to_python(spark):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("frame_idx"), *[F.rand(i).alias(c) for i, c in enumerate("uvxy")])
    plan = calibration.fits(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
