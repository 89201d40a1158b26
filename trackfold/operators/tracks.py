"""Track operators: counts, best ball, Kalman smoothing, sliding windows, gap filling.

A filter's gains depend only on a row's number within its track, so every step is an affine map of the state, and a track
is a chain of such maps.  Tracks are cut into blocks of frames; each block's maps are composed, the blocks' maps are
chained, and then every block runs from its own first state.  So no track is bound to one task.  Within a block the filter's
own steps are taken in their order, for all blocks of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ("clip_id", "track_id")


def frame_counts(detections: DataFrame) -> DataFrame:
    """Distinct frames of each track."""
    return detections.select(*TRACK, "frame_idx").distinct().groupBy(*TRACK).agg(F.count("*").alias("n_frames"))


def best_ball(balls: DataFrame, order: str) -> DataFrame:
    """The most confident ball of each frame; of equal ones the first in ``order``."""
    w = Window.partitionBy("clip_id", "frame_idx").orderBy(F.desc("conf"), F.col(order))
    return balls.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_ball(balls: DataFrame, order: str) -> DataFrame:
    """The last ball of each frame in ``order``."""
    w = Window.partitionBy("clip_id", "frame_idx").orderBy(F.desc(order))
    return balls.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Frames of a block of a track; noise of the one-dimensional filter; the team that every new track gets.
BLOCK = 4096
PROCESS_NOISE, MEASUREMENT_NOISE = 1e-4, 1e-2
HOME_TEAM = 1


def kalman_step(x: float, p: float, z: float, process: float, measurement: float) -> tuple[float, float]:
    """One step of the one-dimensional filter: state and variance after a measurement."""
    prior = p + process
    gain = prior / (prior + measurement)
    return x + gain * (z - x), (1 - gain) * prior


def _settled(step: Callable[[tuple], tuple], state: tuple, most: int = 1 << 20) -> np.ndarray:
    """The first element of each further state (gains), up to where they do not change any more."""
    out: list = []
    while len(out) < most:
        gains, state = step(state)
        if out and gains == out[-1]:
            break
        out.append(gains)
    return np.array(out)


def gains_1d(process: float, measurement: float) -> tuple[np.ndarray, np.ndarray]:
    """Maps and inputs of the second, third ... row: x -> (1 - g) x + g z."""

    def step(state: tuple) -> tuple:
        prior = state[0] + process
        gain = prior / (prior + measurement)
        return gain, ((1 - gain) * prior,)

    g = _settled(step, (1.0,))
    return (1 - g)[:, None, None], g[:, None]


def gains_2d(dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Maps and inputs of (position, velocity) of one axis; both axes share them."""

    def step(state: tuple) -> tuple:
        a, b, e = state
        a, b, e = a + 2 * dt * b + dt * dt * e + 1.0, b + dt * e, e + 4.0
        k1, k2 = a / (a + 9.0), b / (a + 9.0)
        return (k1, k2), ((1 - k1) * a, (1 - k1) * b, e - k2 * b)

    k = _settled(step, (25.0, 0.0, 25.0))
    k1, k2 = k[:, 0], k[:, 1]
    return np.stack([np.stack([1 - k1, (1 - k1) * dt], 1), np.stack([-k2, 1 - k2 * dt], 1)], 1), k


def chained(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps x -> a x + b composed with all before them in their stretch; stretches begin where ``first`` is set.

    Each round doubles the number of maps that are composed, so a stretch of n rows takes log2(n) rounds.
    """
    a, b = a.copy(), b.copy()
    at = np.arange(len(a))
    begin = np.maximum.accumulate(np.where(first, at, 0))
    d, longest = 1, int((at - begin).max()) if len(a) else 0
    while d <= longest:
        here = np.flatnonzero(at - d >= begin)
        before = here - d
        b[here], a[here] = b[here] + a[here] @ b[before], a[here] @ a[before]
        d *= 2
    return a, b


def stepped(n: np.ndarray, z: np.ndarray, first: np.ndarray, state: np.ndarray, gains: np.ndarray, dt: float) -> np.ndarray:
    """The filter's states (rows x size x axes), one step after the other, of all stretches at once.

    Stretches begin where ``first`` is set, with ``state`` (stretches x size x axes); row 1 of a track only starts it.
    """
    out = np.zeros((len(n), *state.shape[1:]))
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(n)))
    state, gain = state.copy(), gains[np.clip(n - 2, 0, len(gains) - 1)]
    order = np.argsort(-size, kind="stable")
    begin, size, state = begin[order], size[order], state[order]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))  # stretches longer than k come first
        row, s = begin[:live] + k, state[:live]
        if s.shape[1] == 2:
            s[:, 0] += dt * s[:, 1]
        s += gain[row][:, :, None] * (z[row] - s[:, 0])[:, None, :]
        one = n[row] == 1
        s[one] = 0.0
        s[one, 0] = z[row[one]]
        out[row] = s
    return out


def _maps(n: np.ndarray, z: np.ndarray, gains: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The map of each row from its number within its track (from 1) and its measurements (rows x axes)."""
    maps, inputs = gains
    k = np.clip(n - 2, 0, len(maps) - 1)
    a, b = maps[k], inputs[k][:, :, None] * z[:, None, :]
    one = n == 1
    a[one] = 0.0
    b[one] = 0.0
    b[one, 0] = z[one]
    return a, b


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row's keys differ from those before it; the first row counts."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def filtered(rows: DataFrame, values: list[str], gains: tuple[np.ndarray, np.ndarray], names: list[str], dt: float = 0.0) -> DataFrame:
    """``rows`` with the state of a filter of the measurements ``values`` after each row: one column for each element and axis.

    Rows have clip_id, track_id, frame_idx (no nulls) and are taken in frame order within a track.

    Rows are numbered by a window just before they go to Python: a window, unlike ``repartition``, is a requirement that
    Spark keeps when it changes joins and reads while a query runs, so a block always comes whole and in order.
    """
    size, axes = gains[0].shape[1], len(values)
    shared = rows.sparkSession.sparkContext.broadcast(gains)
    keys, columns = [*TRACK, "__block"], rows.columns
    dealt = rows.withColumn("__block", F.floor(F.col("frame_idx") / BLOCK))
    order = Window.partitionBy(*TRACK).orderBy("__block")
    blocks = dealt.groupBy(*keys).agg(F.count("*").alias("__n"))
    blocks = blocks.withColumn("__from", F.sum("__n").over(order) - F.col("__n")).withColumn("__last", F.lead("__n").over(order).isNull())

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx")))

    def sequences(batches):
        """Keys, numbers within the track, measurements and maps of each batch; a block may go on in the next batch."""
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            first = _changes(key)
            goes_on = before == tuple(k[0] for k in key)
            before = tuple(k[-1] for k in key)
            n = batch.column("__from").to_numpy() + batch.column("__row").to_numpy()
            z = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in values], 1)
            yield batch, key, first, goes_on, n, z

    def compose(batches):
        for number, (_, key, first, _, n, z) in enumerate(sequences(batches)):
            a, b = chained(*_maps(n, z, shared.value), first)
            ends = np.append(np.flatnonzero(first)[1:], len(first)) - 1
            flat = [pa.array(list(m[ends].reshape(len(ends), -1)), pa.list_(pa.float64())) for m in (a, b)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[ends], pa.int64()) for k in key), pa.array(np.full(len(ends), number, np.int64)), *flat], names=[*keys, "piece", "a", "b"])

    def enter(batches):
        """The state in which each block but a track's first begins, from the pieces of the blocks before it."""
        track, state = None, np.zeros((size, axes))
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in TRACK]
            first = _changes(key)
            a = batch.column("a").flatten().to_numpy().reshape(-1, size, size)
            b = batch.column("b").flatten().to_numpy().reshape(-1, size, axes)
            if track == tuple(k[0] for k in key):
                b = b.copy()
                b[0] += a[0] @ state
            _, b = chained(a, b, first)
            track, state = tuple(k[-1] for k in key), b[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TRACK), pa.array(batch.column("__block").to_numpy() + 0), batch.column("piece"), pa.array(list(b.reshape(len(b), -1)), pa.list_(pa.float64()))], names=[*keys, "piece", "state"])

    kinds = "clip_id long, track_id long, __block long, piece long"
    whole = dealt.join(blocks, keys)
    pieces = in_order(whole.where("NOT __last")).mapInArrow(compose, f"{kinds}, a array<double>, b array<double>")
    # the state after a block is that after its last piece; it enters the track's next block
    after = pieces.withColumn("__row", F.row_number().over(Window.partitionBy(*TRACK).orderBy("__block", "piece"))).mapInArrow(enter, f"{kinds}, state array<double>")
    after = after.groupBy(*keys).agg(F.max_by("state", "piece").alias("__state"))
    entered = blocks.join(after, keys, "left").withColumn("__enter", F.lag("__state").over(order)).select(*keys, "__from", "__enter")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{n} double" for n in names)])

    def run(batches):
        last = np.zeros((size, axes))
        for batch, _, first, goes_on, n, z in sequences(batches):
            begins = np.flatnonzero(first)
            state = np.zeros((len(begins), size, axes))
            if batch.column("__enter").null_count < batch.num_rows:
                for k, entered_with in enumerate(batch.column("__enter").take(pa.array(begins)).to_pylist()):
                    if entered_with is not None:
                        state[k] = np.reshape(entered_with, (size, axes))
            if goes_on:
                state[0] = last
            b = stepped(n, z, first, state, shared.value[1], dt)
            last = b[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(b[:, i, j]) for i in range(size) for j in range(axes))], names=[*columns, *names])

    return in_order(dealt.join(entered, keys)).mapInArrow(run, schema)


def kalman_1d(rows: DataFrame, value: str, process: float = PROCESS_NOISE, measurement: float = MEASUREMENT_NOISE) -> DataFrame:
    """``value`` of each track smoothed by a one-dimensional filter (column ``smooth``); the first value is taken as it is."""
    return filtered(rows.select(*TRACK, "frame_idx", F.col(value).cast("double").alias("z")), ["z"], gains_1d(process, measurement), ["smooth"])


def kalman_2d(rows: DataFrame, fps: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """x and y of each track smoothed by a constant-velocity filter: sx, sy, svx, svy; the first row only starts it.

    The time step is 1 / fps, whatever gaps there are.
    """
    base = rows.select(*TRACK, "frame_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *extra)
    dt = 1.0 / max(fps, 1e-6)
    return filtered(base, ["x", "y"], gains_2d(dt), ["sx", "sy", "svx", "svy"], dt)


def smooth_motion(rows: DataFrame, fps: float) -> DataFrame:
    """Smoothed centre, velocity and box (half of its own and half of the previous size) and speed of every detection."""
    s = kalman_2d(rows, fps, ("w", "h"))
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    half = lambda c: (F.col(c) + F.lag(c, 1).over(w)) * 0.5
    return s.withColumn("sw", F.coalesce(half("w"), F.col("w"))).withColumn("sh", F.coalesce(half("h"), F.col("h"))).withColumn("motion_speed", F.sqrt(F.col("svx") ** 2 + F.col("svy") ** 2))


def trailing(rows: DataFrame, value: Column | str, n: int, name: str, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """``rows`` with the list of the last ``n`` values of each group, the current one included."""
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-(n - 1), 0)
    return rows.withColumn(name, F.collect_list(value).over(w))


def apex(rows: DataFrame, z: str, n: int = 60, least: int = 10) -> DataFrame:
    """The highest z of the last ``n`` rows and its frame (the last of equal ones); null where fewer than ``least`` are there."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(-(n - 1), 0)
    best = F.max(F.struct(F.col(z).alias("z"), F.col("frame_idx").alias("f"))).over(w)
    enough = F.count("*").over(w) >= least
    return rows.withColumn("__b", F.when(enough, best)).withColumn("apex_z", F.col("__b.z")).withColumn("apex_frame", F.col("__b.f")).drop("__b")


def fill_gaps(rows: DataFrame, max_gap: int = 3, group: str = "track_id", segment: str | None = None) -> DataFrame:
    """Interpolated rows for gaps of at most ``max_gap`` frames between two active rows of a track.

    Both ends must lie in one segment, if that is given; a frame that has the track already gets no row.
    """
    w = Window.partitionBy("clip_id", group).orderBy("frame_idx")
    ends = ["frame_idx", "x", "y", "w", "h", "active"] + ([segment] if segment else [])
    pairs = rows.withColumn("n", F.lead(F.struct(*ends)).over(w)).where("n IS NOT NULL AND active AND n.active")
    gap = F.col("n.frame_idx") - F.col("frame_idx") - 1
    pairs = pairs.where((gap >= 1) & (gap <= max_gap))
    if segment:
        pairs = pairs.where(F.col(segment) == F.col(f"n.{segment}"))
    made = pairs.withColumn("f", F.explode(F.sequence(F.col("frame_idx") + 1, F.col("n.frame_idx") - 1)))
    alpha = (F.col("f") - F.col("frame_idx")) / (F.col("n.frame_idx") - F.col("frame_idx"))
    mid = lambda c: (F.col(c) + (F.col(f"n.{c}") - F.col(c)) * alpha).alias(c)
    made = made.select("clip_id", group, F.col("f").alias("frame_idx"), *map(mid, "xywh"))
    return made.join(rows.select("clip_id", group, "frame_idx").distinct(), ["clip_id", group, "frame_idx"], "left_anti")


def repaired(rows: DataFrame, max_gap: int = 3) -> DataFrame:
    """Observed rows together with the interpolated ones; ``synthesized`` tells them apart."""
    observed = rows.select("clip_id", "track_id", "frame_idx", *"xywh", F.lit(False).alias("synthesized"))
    return observed.unionByName(fill_gaps(rows, max_gap).withColumn("synthesized", F.lit(True)))
