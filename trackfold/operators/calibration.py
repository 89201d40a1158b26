"""Calibration: homographies by frame, point summaries and validation, fits, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import IDENTITY


def with_homography(frames: DataFrame, calibration: DataFrame, default: list[float] | None = IDENTITY) -> DataFrame:
    """Frames with the homography of their frame, else of their clip (frame_idx null), else the default (may be None).

    ``calibration``: clip_id, frame_idx (null for a whole clip), h.
    """
    own = calibration.where("frame_idx IS NOT NULL").select("clip_id", "frame_idx", F.col("h").alias("__own"))
    whole = calibration.where("frame_idx IS NULL").select("clip_id", F.col("h").alias("__clip"))
    other = F.lit(None).cast("array<double>") if default is None else F.array(*map(F.lit, default))
    return frames.join(own, ["clip_id", "frame_idx"], "left").join(whole, "clip_id", "left").withColumn("h", F.coalesce("__own", "__clip", other)).drop("__own", "__clip")


def known_points(points: DataFrame, primitives: DataFrame) -> DataFrame:
    """Points with their court feature; the landmark id stands in for a missing primitive id."""
    named = points.withColumn("primitive_id", F.coalesce("primitive_id", "landmark_id"))
    return named.join(F.broadcast(primitives), "primitive_id", "left")  # a dozen features


def point_problem(n_unknown: Column, n: Column, n_primitives: Column, n_families: Column) -> Column:
    """Why a clip's points do not calibrate it, in order; null if they do."""
    return F.when(n_unknown > 0, "unknown_primitive").when(n < 4, "too_few_points").when(n_primitives < 2, "too_few_primitives").when(n_families < 2, "too_few_families")


def point_summary(points: DataFrame, *keys: str) -> DataFrame:
    """Points, distinct features and families of each group, and the problem, if any."""
    g = points.groupBy(*keys).agg(F.count("*").alias("n_points"), F.countDistinct("primitive_id").alias("n_primitives"), F.countDistinct("family").alias("n_families"), F.count_if(F.col("family").isNull()).alias("n_unknown"))
    return g.withColumn("problem", point_problem(*(F.col(c) for c in ("n_unknown", "n_points", "n_primitives", "n_families"))))


def calibrates(n_points: Column, n_families: Column) -> Column:
    """Whether a frame's correspondences suffice for a fit."""
    return (n_points >= 4) & (n_families >= 2)


def ordered_samples(points: DataFrame, *keys: str) -> DataFrame:
    """Samples of each feature numbered: lines along their longer image axis, arcs as they were sampled."""
    w = Window.partitionBy(*keys, "primitive_id")
    wide = F.max("u").over(w) - F.min("u").over(w) >= F.max("v").over(w) - F.min("v").over(w)
    rank = F.when(F.col("kind") != "line", F.col("sample_order").cast("double")).when(wide, F.col("u")).otherwise(F.col("v"))
    p = points.withColumn("__k", rank)
    return p.withColumn("place", F.row_number().over(w.orderBy("__k", "sample_order")) - 1).drop("__k")


#: The six products of (u, v, 1) with itself that differ, by place in a 3 x 3 matrix.
_PLACES = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_AXES = ("u", "v", "x", "y")


def moments(correspondences: DataFrame) -> DataFrame:
    """Per (clip_id, frame_idx): n, means and spreads of u, v, x, y, and 24 sums over the pairs moved and scaled by them.

    The sums are those of (u, v, 1) with itself, alone and weighted with x, y, and x^2 + y^2: all that a direct linear
    transform needs of its pairs.  They are added up in parts before any exchange, so a frame may have any number of pairs.
    """
    keys = ["clip_id", "frame_idx"]
    rows = correspondences.select(*keys, *[F.col(c).cast("double").alias(c) for c in _AXES])
    spread = lambda a, b: F.sqrt(F.var_pop(a) + F.var_pop(b))
    whole = lambda c: F.when(c > 0, c).otherwise(F.lit(1.0))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in _AXES], whole(spread("u", "v")).alias("s_uv"), whole(spread("x", "y")).alias("s_xy")).where("n >= 4")
    d = rows.join(stats, keys)
    d = d.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.col("s_uv" if c in "uv" else "s_xy") for c in _AXES})
    p, weights = (F.col("u"), F.col("v"), F.lit(1.0)), (F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    sums = [F.sum(w * p[i] * p[j]).alias(f"q{k}_{i}{j}") for k, w in enumerate(weights) for i, j in _PLACES]
    own = ["n", *(f"m_{c}" for c in _AXES), "s_uv", "s_xy"]
    added = d.groupBy(*keys).agg(*[F.first(c).alias(c) for c in own], *sums)
    return added.select(*keys, *own, F.array(*[f"q{k}_{i}{j}" for k in range(4) for i, j in _PLACES]).alias("sums"))


def solved(means: np.ndarray, spreads: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Homographies (frames x 9) from moments: the vectors of unit length with the least algebraic error over the pairs as given.

    The error is a form of the scaled pairs' moments, the length one of the pairs as given; so the answer is the largest
    eigenvector of length against error, of all frames in one call.
    """
    n = len(sums)
    blocks = np.zeros((n, 4, 3, 3))
    for c, (i, j) in enumerate(_PLACES):
        blocks[:, :, i, j] = blocks[:, :, j, i] = sums.reshape(n, 4, 6)[:, :, c]
    error = np.zeros((n, 9, 9))
    error[:, :3, :3] = error[:, 3:6, 3:6] = blocks[:, 0]
    error[:, :3, 6:] = error[:, 6:, :3] = -blocks[:, 1]
    error[:, 3:6, 6:] = error[:, 6:, 3:6] = -blocks[:, 2]
    error[:, 6:, 6:] = blocks[:, 3]
    error += 1e-14 * np.trace(error, axis1=1, axis2=2)[:, None, None] * np.eye(9)
    image, court_back = np.zeros((n, 3, 3)), np.zeros((n, 3, 3))
    for t, m, s, back in ((image, means[:, :2], spreads[:, 0], False), (court_back, means[:, 2:], spreads[:, 1], True)):
        t[:, 0, 0] = t[:, 1, 1] = s if back else 1 / s
        t[:, :2, 2] = m if back else -m / s[:, None]
        t[:, 2, 2] = 1.0
    # H = court_back . H_scaled . image, as a matrix on the nine elements by rows
    given = np.einsum("nij,nlk->nikjl", court_back, image).reshape(n, 9, 9)
    lower = np.linalg.cholesky(error)
    against = given @ np.swapaxes(np.linalg.inv(lower), 1, 2)
    h = np.einsum("nij,nj->ni", against, np.linalg.eigh(np.swapaxes(against, 1, 2) @ against)[1][:, :, -1])
    h /= np.linalg.norm(h, axis=1)[:, None]
    return np.where(np.abs(h[:, 8:]) > 1e-12, h / np.where(h[:, 8:] == 0, 1.0, h[:, 8:]), h)


def fits(correspondences: DataFrame) -> DataFrame:
    """A homography for each (clip_id, frame_idx) with at least four pairs (u, v) to (x, y).

    It is that of the direct linear transform (smallest singular vector).  Spark adds up each frame's moments; a task
    solves all frames of a batch at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = lambda *names: np.stack([batch.column(c).to_numpy() for c in names], 1)  # noqa: B023, E731
                h = solved(at("m_u", "m_v", "m_x", "m_y"), at("s_uv", "s_xy"), batch.column("sums").flatten().to_numpy().reshape(-1, 24))
                yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("frame_idx"), pa.array(list(h), pa.list_(pa.float64()))], names=["clip_id", "frame_idx", "h"])

    return moments(correspondences).mapInArrow(run, "clip_id long, frame_idx long, h array<double>")
