"""Geometry as Column expressions; matrices are arrays of nine doubles, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Court sizes in centimetres.
COURT_LENGTH, COURT_WIDTH, RIM_Z, RIM_RADIUS, THREE_POINT, BASELINE_TO_RIM = 2865.0, 1524.0, 304.8, 22.86, 675.0, 160.0
#: What is added to the divisor of a projection.
EPSILON = 1e-6


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: within lambdas Spark does not share common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip01(x: Column) -> Column:
    """A value limited to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """The value at share alpha of the way from a to b."""
    return a + (b - a) * alpha


def norm2(x: Column, y: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(x * x + y * y)


def lerp_points(a: Column, b: Column, alpha: Column) -> Column:
    """Point lists interpolated place by place; null if their lengths differ."""
    both = F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda s, t: lerp(s, t, alpha)))
    return F.when(F.size(a) == F.size(b), both)


def project(u: Column, v: Column, h: Column) -> Column:
    """Struct x, y of a pixel under homography ``h``; the divisor gets EPSILON added, so identity is not exact."""
    w = h[6] * u + h[7] * v + h[8] + EPSILON
    return F.struct(((h[0] * u + h[1] * v + h[2]) / w).alias("x"), ((h[3] * u + h[4] * v + h[5]) / w).alias("y"))


def undistort(u: Column, v: Column, k: dict[str, float], fx: float, fy: float, cx: float, cy: float) -> Column:
    """Struct x, y of a pixel without lens distortion: five fixed-point steps for radial k1, k2 and tangential p1, p2."""
    k1, k2, p1, p2 = (float(k.get(n, 0.0)) for n in ("k1", "k2", "p1", "p2"))
    if not any((k1, k2, p1, p2)):
        return F.struct(u.cast("double").alias("x"), v.cast("double").alias("y"))
    x0, y0 = (u - cx) / fx, (v - cy) / fy

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * r2 * r2
        dx = 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
        dy = p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        return F.struct(((x0 - dx) / radial).alias("x"), ((y0 - dy) / radial).alias("y"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.struct(x0.cast("double").alias("x"), y0.cast("double").alias("y")), step)
    return F.struct((s["x"] * fx + cx).alias("x"), (s["y"] * fy + cy).alias("y"))


def floor_point(u: Column, v: Column, h: Column, strict: bool = False) -> Column:
    """Struct x, y, z=0 of a pixel by true division; null (or an error if strict) where the divisor is below 1e-6."""
    w = h[6] * u + h[7] * v + h[8]
    point = F.struct(((h[0] * u + h[1] * v + h[2]) / w).alias("x"), ((h[3] * u + h[4] * v + h[5]) / w).alias("y"), F.lit(0.0).alias("z"))
    return F.when(F.abs(w) >= 1e-6, point).otherwise(F.raise_error(F.lit("the point lies at infinity")) if strict else F.lit(None))


def determinant(h: Column) -> Column:
    """Determinant of a 3 x 3 matrix."""
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def homography_sanity(h: Column) -> Column:
    """Struct determinant and invertible (absolute determinant above 1e-6)."""
    d = determinant(h)
    return F.struct(d.alias("determinant"), (F.abs(d) > 1e-6).alias("invertible"))


def matmul(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 matrices."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def motion_update(state: Column, delta: Column) -> Column:
    """Struct h, panning, confidence after a motion: H times delta; panning if delta is over 0.05 from identity (Frobenius)."""
    away = F.sqrt(sum(((delta[i] - IDENTITY[i]) * (delta[i] - IDENTITY[i]) for i in range(1, 9)), (delta[0] - 1.0) * (delta[0] - 1.0)))
    panning = away > 0.05
    return F.struct(matmul(state["h"], delta).alias("h"), panning.alias("panning"), F.when(panning, state["confidence"] * 0.99).otherwise(state["confidence"]).alias("confidence"))


def lift_joints(joints: Column, h: Column, z_scale: float = 0.75) -> Column:
    """17 joints projected one by one; z is z_scale times the distance, on the court, of y from the projected middle of the ankles."""

    def lifted(s: Column) -> Column:
        return F.transform(s["j"], lambda j: let(project(j[0], j[1], s["h"]), lambda p: F.array(p["x"], p["y"], F.abs(p["y"] - s["floor"]) * z_scale)))

    def with_floor(j: Column) -> Column:
        left, right = F.get(j, F.lit(15)), F.get(j, F.lit(16))
        floor = project((left[0] + right[0]) / 2, (left[1] + right[1]) / 2, h)["y"]
        return F.struct(j.alias("j"), h.alias("h"), floor.alias("floor"))

    return let(joints, lambda j: F.when(F.size(j) == 17, let(with_floor(j), lifted)))


def lift_joints_on_floor(joints: Column, h: Column, z_scale: float = 0.5) -> Column:
    """All joints over the floor point of the ankles' middle, (0, 0) without ankles; z is z_scale times |floor y - v|; empty where unresolvable."""

    def middle(j: Column, k: int) -> Column:
        return F.when(F.size(j) >= 17, (F.get(j, F.lit(15))[k] + F.get(j, F.lit(16))[k]) / 2).otherwise(F.lit(0.0))

    def lifted(s: Column) -> Column:
        points = F.transform(s["j"], lambda p: F.array(s["at"]["x"], s["at"]["y"], F.abs(s["v"] - p[1]) * z_scale))
        return F.when(s["at"].isNotNull(), points).otherwise(F.array().cast("array<array<double>>"))

    with_floor = let(joints, lambda j: F.struct(j.alias("j"), middle(j, 0).alias("u"), middle(j, 1).alias("v")))
    return let(let(with_floor, lambda s: F.struct(s["j"].alias("j"), s["v"].alias("v"), floor_point(s["u"], s["v"], h).alias("at"))), lifted)


def box_centre(d: dict[str, Column]) -> Column:
    """Struct x, y: the smoothed centre, else that of xywh, else the middle of xyxy, else (0, 0)."""
    middle = F.when(d["xyxy"].isNotNull(), F.array((d["xyxy"][0] + d["xyxy"][2]) / 2, (d["xyxy"][1] + d["xyxy"][3]) / 2))
    p = F.coalesce(d["smoothed"], F.when(d["xywh"].isNotNull(), F.slice(d["xywh"], 1, 2)), middle, F.array(F.lit(0.0), F.lit(0.0)))
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def box_size(d: dict[str, Column]) -> Column:
    """Struct w, h: the smoothed box, else xywh, else xyxy; each at least 1."""
    own = F.when(d["xyxy"].isNotNull(), F.array(d["xyxy"][2] - d["xyxy"][0], d["xyxy"][3] - d["xyxy"][1]))
    p = F.coalesce(F.when(d["smoothed_xywh"].isNotNull(), F.slice(d["smoothed_xywh"], 3, 2)), F.when(d["xywh"].isNotNull(), F.slice(d["xywh"], 3, 2)), own, F.array(F.lit(1.0), F.lit(1.0)))
    return F.struct(F.greatest(F.lit(1.0), p[0]).alias("w"), F.greatest(F.lit(1.0), p[1]).alias("h"))


def frame_time(frame: Column, fps: float, first: int = 0) -> Column:
    """Milliseconds of a frame; ``first`` = 1 where a frame is counted before its time is taken."""
    return ((frame + first) / F.lit(float(fps)) * 1000).cast("bigint")


def resampled(items: Column, n: int = 30) -> Column:
    """Every item if there are at most n, else n of them at evenly spaced places."""
    last = F.size(items) - 1
    return F.when(F.size(items) <= n, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: items[F.floor(i * last / (n - 1)).cast("int")]))


def box_normalised(points: Column) -> Column:
    """2-D points moved and scaled by their own range."""

    def ranges(p: Column) -> Column:
        xs, ys = F.transform(p, lambda q: q[0]), F.transform(p, lambda q: q[1])
        return F.struct(p.alias("p"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))

    def scaled(s: Column) -> Column:
        return F.transform(s["p"], lambda p: F.array((p[0] - s["x0"]) / (s["x1"] - s["x0"] + EPSILON), (p[1] - s["y0"]) / (s["y1"] - s["y0"] + EPSILON)))

    return let(let(points, ranges), scaled)


# Court features for calibration: id -> (kind, family, points or (centre, radius, first and last degree)).
PRIMITIVES = {
    "far_sideline": ("line", "sideline", [[0, 0], [2865, 0]]),
    "near_sideline": ("line", "sideline", [[0, 1524], [2865, 1524]]),
    "left_baseline": ("line", "baseline", [[0, 0], [0, 1524]]),
    "right_baseline": ("line", "baseline", [[2865, 0], [2865, 1524]]),
    "left_lane_line": ("line", "lane", [[580, 517], [580, 1007]]),
    "right_lane_line": ("line", "lane", [[2285, 517], [2285, 1007]]),
    "left_free_throw_line": ("line", "lane", [[580, 517], [580, 1007]]),
    "right_free_throw_line": ("line", "lane", [[2285, 517], [2285, 1007]]),
    "left_three_point_arc": ("arc", "three_point_arc", [[160, 762], [675, 0], [-72, 72]]),
    "right_three_point_arc": ("arc", "three_point_arc", [[2705, 762], [675, 0], [108, 252]]),
    "left_rim": ("point", "rim", [[160, 762]]),
    "right_rim": ("point", "rim", [[2705, 762]]),
}


def primitive_rows(spark):
    """The court features as a table: primitive_id, kind, family, x0, y0, x1, y1, radius, a0, a1."""
    rows = []
    for name, (kind, family, p) in PRIMITIVES.items():
        end = p[1] if kind == "line" else [None, None]
        radius, angles = (p[1][0], p[2]) if kind == "arc" else (None, [None, None])
        rows.append((name, kind, family, *p[0], *end, radius, *angles))
    return spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows], "primitive_id string, kind string, family string, x0 double, y0 double, x1 double, y1 double, radius double, a0 double, a1 double")


def world_point(alpha: Column) -> Column:
    """Struct x, y of a sample of the court feature in the current row; alpha is limited to [0, 1]."""
    a = clip01(alpha)
    angle = F.radians(lerp(F.col("a0"), F.col("a1"), a))
    x = F.when(F.col("kind") == "point", F.col("x0")).when(F.col("kind") == "line", lerp(F.col("x0"), F.col("x1"), a)).otherwise(F.col("x0") + F.col("radius") * F.cos(angle))
    y = F.when(F.col("kind") == "point", F.col("y0")).when(F.col("kind") == "line", lerp(F.col("y0"), F.col("y1"), a)).otherwise(F.col("y0") + F.col("radius") * F.sin(angle))
    return F.struct(x.alias("x"), y.alias("y"))


def fit_homography(pixels: np.ndarray, court: np.ndarray) -> np.ndarray | None:
    """The homography of at least four pairs by the direct linear transform (smallest singular vector); None for fewer."""
    if len(pixels) < 4:
        return None
    rows = []
    for (u, v), (x, y) in zip(pixels, court, strict=True):
        rows += [[-u, -v, -1, 0, 0, 0, u * x, v * x, x], [0, 0, 0, -u, -v, -1, u * y, v * y, y]]
    h = np.linalg.svd(np.array(rows, float))[2][-1]
    return h / h[-1] if abs(h[-1]) > 1e-12 else h


def extrinsics(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of a plane's homography under intrinsics ``k``; the first column's length is the scale, SVD makes the rotation orthonormal.

    ``h`` may be a stack of matrices (n, 3, 3); the results are stacks too.
    """
    b = np.linalg.inv(k) @ np.reshape(h, (*np.shape(h)[:-1], 3, 3) if np.shape(h)[-1] == 9 else np.shape(h))
    b = b / np.linalg.norm(b[..., 0], axis=-1)[..., None, None]
    r1, r2 = b[..., 0], b[..., 1]
    u, _, vt = np.linalg.svd(np.stack([r1, r2, np.cross(r1, r2)], -1))
    return u @ vt, b[..., 2]


def camera_poses(h: Column, k: np.ndarray) -> Column:
    """Struct rotation (nine doubles) and translation (three) of homographies; null where there is none, or it is singular."""

    @F.pandas_udf("rotation array<double>, translation array<double>")
    def solve(column: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"rotation": [None] * len(column), "translation": [None] * len(column)}, dtype=object)
        whole = [i for i, m in enumerate(column) if m is not None and len(m) == 9 and np.isfinite(m).all() and abs(np.linalg.det(np.reshape(m, (3, 3)))) > 0]
        if whole:
            r, t = extrinsics(np.stack([np.asarray(column.iloc[i], float) for i in whole]), k)
            for i, rotation, translation in zip(whole, r, t, strict=True):
                out.at[i, "rotation"], out.at[i, "translation"] = rotation.ravel().tolist(), translation.tolist()
        return out

    return solve(h)


def look_at(camera: list[float], target: list[float]) -> np.ndarray:
    """Rotation whose rows are right, up and forward of a camera that looks at a target (z is up)."""
    forward = np.subtract(target, camera).astype(float)
    forward /= np.linalg.norm(forward) + EPSILON
    right = np.cross([0.0, 0.0, 1.0], forward)
    if np.linalg.norm(right) < EPSILON:
        right = np.array([1.0, 0.0, 0.0])
    right /= np.linalg.norm(right) + EPSILON
    return np.stack([right, np.cross(forward, right), forward])


def pinhole(x: Column, y: Column, z: Column, k: np.ndarray, r: np.ndarray, t: np.ndarray, noise: float = 0.0, seed: int = 0) -> Column:
    """Struct u, v of a world point in a camera; the divisor gets EPSILON added; ``noise`` adds seeded normal errors."""
    p = k @ np.concatenate([r, np.reshape(t, (3, 1))], 1)
    dot = lambda row: x * float(row[0]) + y * float(row[1]) + z * float(row[2]) + float(row[3])
    w = dot(p[2]) + EPSILON
    error = (lambda s: F.randn(seed + s) * noise) if noise > 0 else (lambda s: F.lit(0.0))
    return F.struct((dot(p[0]) / w + error(0)).alias("u"), (dot(p[1]) / w + error(1)).alias("v"))


def motion_states(deltas, clip: str = "clip_id", frame: str = "frame_idx"):
    """The camera state of each clip after all its motions (column ``delta``) in frame order: h, confidence, panning frames.

    The product of matrices is ordered, so it is a fold over the clip's sorted motions; a clip bounds their number.
    """
    ordered = deltas.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(F.col(frame), "delta"))).alias("d"))
    start = F.struct(F.array(*map(F.lit, IDENTITY)).alias("h"), F.lit(1.0).alias("confidence"), F.lit(0).alias("panning"))

    def step(s: Column, d: Column) -> Column:
        return let(motion_update(s, d["delta"]), lambda n: F.struct(n["h"].alias("h"), n["confidence"].alias("confidence"), (s["panning"] + n["panning"].cast("int")).alias("panning")))

    return ordered.select(clip, F.aggregate("d", start, step).alias("s")).select(clip, "s.*")
