"""Game ledger: possession context, delayed validation of baskets, scores and box scores.

An event row has game_id, seq (order), kind, t_ms, player_id, team_id, to_id, points, origin, x, y.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import in_rim, zone
from ..functions.geometry import RIM_Z

WINDOW_MS, HINT_POINTS = 2000, 3
TRANSITION_ORIGINS = ["Steal", "Rebound", "Turnover"]


class Waiting:
    """Baskets (seq, t_ms, player, team) of a game that wait for a signal, kept in order of time."""

    def __init__(self, window_ms: int, rows: Iterable[tuple] = ()):
        self.window_ms = window_ms
        self._sorted = sorted((r[1], r[0], r[2], r[3]) for r in rows)

    def add(self, seq: int, t_ms: int, player: int, team: int) -> None:
        insort(self._sorted, (t_ms, seq, player, team))

    def take(self, t_ms: int) -> tuple | None:
        """The basket that came first of those that a signal at ``t_ms`` can reach; it waits no more."""
        low, high = bisect_left(self._sorted, (t_ms - self.window_ms,)), bisect_right(self._sorted, (t_ms, float("inf")))
        if low >= high:
            return None
        at = min(range(low, high), key=lambda i: self._sorted[i][1])
        t, seq, player, team = self._sorted.pop(at)
        return seq, t, player, team

    def drop_before(self, t_ms: int) -> None:
        """Take out the baskets that no signal at ``t_ms`` or later can reach."""
        del self._sorted[: bisect_left(self._sorted, (t_ms - self.window_ms,))]

    def rows(self) -> list[tuple]:
        return [(seq, t, player, team) for t, seq, player, team in self._sorted]


def with_possession(events: DataFrame, game: str = "game_id") -> DataFrame:
    """Every event with the possession after it: number, team, handler, start, dribbles, passes, zone, transition.

    A possession begins with PossessionChange.  A Dribble counts only for the handler, sets the zone, and ends the
    transition within the paint; a Pass by anyone counts, moves the handler and sets the zone.
    """
    order = Window.partitionBy(game).orderBy("seq")
    d = events.withColumn("possession", F.count_if(F.col("kind") == "PossessionChange").over(order))
    own = Window.partitionBy(game, "possession").orderBy("seq")
    some = F.col("possession") > 0
    change, passed = F.col("kind") == "PossessionChange", (F.col("kind") == "Pass") & some
    gives = F.when(change, F.col("player_id")).when(passed, F.col("to_id"))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("handler_before", F.last(gives, ignorenulls=True).over(before))
    d = d.withColumn("handler", F.last(gives, ignorenulls=True).over(own))
    d = d.withColumn("possession_team", F.first(F.when(change, F.col("team_id")), ignorenulls=True).over(own))
    counted = some & (F.col("kind") == "Dribble") & F.col("handler_before").eqNullSafe(F.col("player_id"))
    d = d.withColumn("__dribble", counted)
    here = F.when(F.col("__dribble") | passed, zone(F.col("x"), F.col("y"), F.col("possession_team") == 1))
    d = d.withColumn("__zone", here)
    d = d.withColumns(
        {
            "start_ms": F.first(F.when(change, F.col("t_ms")), ignorenulls=True).over(own),
            "dribbles": F.count_if(F.col("__dribble")).over(own),
            "passes": F.count_if(passed).over(own),
            "zone": F.when(some, F.coalesce(F.last("__zone", ignorenulls=True).over(own), F.lit("Backcourt"))),
            "transition": F.when(some, F.first(F.when(change, F.coalesce(F.col("origin").isin(TRANSITION_ORIGINS), F.lit(False))), ignorenulls=True).over(own) & (F.count_if(F.col("__dribble") & F.col("__zone").eqNullSafe("Paint")).over(own) == 0)),
        }
    )
    return d.drop("handler_before", "__dribble", "__zone")


def rim_proposals(balls: DataFrame, game: str = "game_id") -> DataFrame:
    """A two-point basket of player 0, team 1 for every ball row within a rim (at rim height), without deduplication."""
    return balls.where(in_rim(F.col("x"), F.col("y"), F.lit(RIM_Z))).select(game, "seq", F.lit("MadeBasket").alias("kind"), "t_ms", F.lit(0).cast("long").alias("player_id"), F.lit(1).cast("long").alias("team_id"), F.lit(2).cast("long").alias("points"))


def validated(events: DataFrame, game: str = "game_id", window_ms: int = WINDOW_MS, expire: bool = False) -> DataFrame:
    """The ledger's history: rows as they become official, in order: game, seq, at_seq, kind, player_id, team_id, points.

    A MadeBasket waits until a ThreePointSignal row at t with t0 <= t <= t0 + window comes; each signal takes the oldest
    such basket and gives it its points.  Other events are official at once.  Waiting baskets never expire by themselves
    (``expire`` drops those that no later signal can reach).  Rows stream through one task for each game in seq order.
    """
    cols = [game, "seq", "kind", "t_ms", "player_id", "team_id", "points"]
    base = events.select(*cols).repartition(game).sortWithinPartitions(game, "seq")

    def run(batches):
        now, waiting = None, Waiting(window_ms)
        for batch in batches:
            out = []
            for g, seq, kind, t, player, team, points in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if (g,) != now:
                    now, waiting = (g,), Waiting(window_ms)
                if kind == "MadeBasket":
                    waiting.add(seq, t, player, team)
                elif kind == "ThreePointSignal":
                    if expire:
                        waiting.drop_before(t)
                    if hit := waiting.take(t):
                        out.append((g, hit[0], seq, "MadeBasket", hit[2], hit[3], HINT_POINTS if points is None else points))
                else:
                    out.append((g, seq, seq, kind, player, team, points))
            if out:
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[game, "seq", "at_seq", "kind", "player_id", "team_id", "points"])

    return base.mapInArrow(run, f"{game} long, seq long, at_seq long, kind string, player_id long, team_id long, points long")


def box_score(history: DataFrame, game: str = "game_id") -> DataFrame:
    """Points, makes, attempts, rebounds, steals and fouls of each player."""
    k = F.col("kind")
    made = k == "MadeBasket"
    return history.where(k.isin("MadeBasket", "MissedBasket", "Rebound", "Steal", "Foul")).groupBy(game, "player_id").agg(
        F.coalesce(F.sum(F.when(made, F.col("points"))), F.lit(0)).alias("points"),
        F.count_if(made).alias("fgm"),
        F.count_if(made | (k == "MissedBasket")).alias("fga"),
        F.count_if(k == "Rebound").alias("rebounds"),
        F.count_if(k == "Steal").alias("steals"),
        F.count_if(k == "Foul").alias("fouls"),
    )


def running_score(history: DataFrame, game: str = "game_id", order: str = "at_seq") -> DataFrame:
    """Baskets with the score after each: team 1, and everyone else."""
    w = Window.partitionBy(game).orderBy(order)
    made = history.where("kind = 'MadeBasket'")
    side = lambda one: F.coalesce(F.sum(F.when((F.col("team_id") == 1) == F.lit(one), F.col("points"))).over(w), F.lit(0))
    return made.withColumn("score_1", side(True)).withColumn("score_2", side(False))


def summary(events: DataFrame, game: str = "game_id") -> DataFrame:
    """Events in all, and official points by team."""
    official = (F.col("kind") == "MadeBasket") & F.coalesce(F.col("is_official"), F.lit(False))
    points = lambda one: F.coalesce(F.sum(F.when(official & ((F.col("team_id") == 1) == F.lit(one)), F.col("points"))), F.lit(0))
    return events.groupBy(game).agg(F.count("*").alias("total_events"), points(True).alias("points_1"), points(False).alias("points_2"))
