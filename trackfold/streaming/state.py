"""Keyed state of event streams: the ledger's waiting baskets, and the table of tracks.

Both are stateful processors over typed state in the RocksDB store: lists and values by key, which Spark checkpoints and
restores.  A timer in event time takes baskets out that no signal can reach any more, so state does not grow with a game.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import HINT_POINTS, WINDOW_MS, Waiting
from ..operators.tracks import HOME_TEAM, MEASUREMENT_NOISE, PROCESS_NOISE, kalman_step

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = 30
LEDGER = "game_id long, seq long, at_seq long, kind string, player_id long, team_id long, points long"
TRACKS = "clip_id long, track_id long, frame_idx long, court_x double, court_y double, team int, seen long, poses long"
# groups are small and many, so processors take and give rows: a frame for each group would cost more than its rows
_ENTRY, _TRACK = (Row(*(c.split()[0] for c in schema.split(", "))) for schema in (LEDGER, TRACKS))


def with_typed_state(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; a provider that the session names itself stays."""
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


@contextmanager
def _by_value():
    """Processors travel with their code: the worker that Spark starts on the driver's side gets no files of the session."""
    modules = [sys.modules[c.__module__] for c in (LedgerState, Waiting, kalman_step)]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)


class LedgerState(StatefulProcessor):
    """Events of a game become official, baskets when a signal takes them; waiting ones are a list state."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, t_ms long, player_id long, team_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting, out = Waiting(self.window_ms, self.waiting.get()), []
        last = None
        for _, seq, kind, t_ms, player_id, team_id, points, _ in sorted(rows, key=lambda r: r[1]):
            if kind == "MadeBasket":
                waiting.add(seq, t_ms, player_id, team_id)
                last = max(last or 0, t_ms)
            elif kind == "ThreePointSignal":
                if hit := waiting.take(t_ms):
                    out.append(_ENTRY(key[0], hit[0], seq, "MadeBasket", hit[2], hit[3], HINT_POINTS if points is None else points))
            else:
                out.append(_ENTRY(key[0], seq, seq, kind, player_id, team_id, points))
        self._keep(waiting)
        if last is not None:
            self.handle.registerTimer(last + self.window_ms + 1)
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = Waiting(self.window_ms, self.waiting.get())
        waiting.drop_before(timerValues.getCurrentWatermarkInMs())
        self._keep(waiting)
        return iter(())

    def _keep(self, waiting: Waiting) -> None:
        if rows := waiting.rows():
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


class TrackState(StatefulProcessor):
    """A track's filters and the moments of its last poses, made when its first detection comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.track = handle.getValueState("track", "x double, y double, p double, team int, seen long")
        self.recent = handle.getListState("recent", "frame_idx long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        track = tuple(self.track.get()) if self.track.exists() else None
        recent = [int(r[0]) for r in self.recent.get()]
        out = []
        for _, _, frame_idx, at_x, at_y, has_pose in sorted(rows, key=lambda r: r[2]):
            at_x, at_y = (float("nan") if v is None else float(v) for v in (at_x, at_y))
            if track is None:
                track = (at_x, at_y, 1.0, HOME_TEAM, 0)
            else:
                x, p = kalman_step(track[0], track[2], at_x, PROCESS_NOISE, MEASUREMENT_NOISE)
                y, _ = kalman_step(track[1], track[2], at_y, PROCESS_NOISE, MEASUREMENT_NOISE)
                track = (x, y, p, *track[3:])
            track = (*track[:4], track[4] + 1)
            if has_pose:
                recent = [*recent, frame_idx][-HISTORY:]
            out.append(_TRACK(*key, frame_idx, track[0], track[1], track[3], track[4], len(recent)))
        self.track.update(track)
        if recent:
            self.recent.put([(f,) for f in recent])
        return iter(out)

    def close(self) -> None:
        pass


def ledger(stream: DataFrame, window_ms: int = WINDOW_MS, late: str = "1 second") -> DataFrame:
    """The ledger's history (as ``operators.ledger.validated``) of a stream of events with game_id, seq, kind, t_ms, player_id, team_id, points.

    ``t_ms`` is the event time (from 0); rows that are later than ``late`` are dropped.  Within a game rows come in seq
    order, over batches too.  A basket leaves the state when a signal takes it, or when the watermark passes the end of its window.
    """
    with_typed_state(stream.sparkSession)
    # one more, since the first watermark is 0 and a row at the watermark is late already
    timed = stream.select("game_id", "seq", "kind", "t_ms", "player_id", "team_id", "points", F.timestamp_millis(F.col("t_ms") + 1).alias("ts")).withWatermark("ts", late)
    with _by_value():
        return timed.groupBy("game_id").transformWithState(LedgerState(window_ms), LEDGER, "append", "eventTime")


def tracks(stream: DataFrame) -> DataFrame:
    """Every detection (clip_id, track_id, frame_idx, x, y, has_pose) with its track's smoothed position, team, rows so far and poses at hand.

    A track is made when its id is first seen; within a track rows come in frame order, over batches too.
    """
    with_typed_state(stream.sparkSession)
    rows = stream.select("clip_id", "track_id", "frame_idx", "x", "y", "has_pose")
    with _by_value():
        return rows.groupBy("clip_id", "track_id").transformWithState(TrackState(), TRACKS, "append", "none")


def run_available(result: DataFrame, path: str, checkpoint: str, last: bool = True) -> DataFrame:
    """Run a stream over all input that is there, append to Parquet files at ``path``, and read them.

    Started again with the same checkpoint it takes only new input.  A run that is not the ``last`` one leaves out the
    empty batch behind it, which only fires timers: they fire in the next run.
    """
    spark, empty = result.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, str(last and before == "true").lower())
    try:
        query = result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
