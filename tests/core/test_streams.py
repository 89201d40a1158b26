"""Streams with state against the batch operators, restarts, and state that shrinks."""

import random

import pytest

from trackfold.operators import ledger, tracks
from trackfold.streaming import state

EVENTS = "game_id long, seq long, kind string, t_ms long, player_id long, team_id long, points long"


def events(n=240, games=3):
    rng = random.Random(6)
    kinds = ["MadeBasket", "MadeBasket", "ThreePointSignal", "Pass", "Foul"]
    return [(g, s, rng.choice(kinds), 1000 * (s // 3) + rng.randrange(300), rng.randrange(5), 1 + s % 2, rng.choice([None, 2, 3])) for s in range(n) for g in range(games)]


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ledger_stream_equals_the_batch_and_restarts(spark, tmp_path):
    rows = events()
    parts = [[r for r in rows if 60 * k <= r[1] < 60 * (k + 1)] for k in range(4)]
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        return state.run_available(state.ledger(stream), out, mark)

    for part in parts[:2]:
        write(spark, part, EVENTS, source)
    half = plain(run())
    assert half == plain(ledger.validated(spark.createDataFrame(parts[0] + parts[1], EVENTS)))
    assert plain(run()) == half  # nothing new: nothing twice
    for part in parts[2:]:  # a new query goes on from the checkpoint, with the baskets that wait
        write(spark, part, EVENTS, source)
    assert plain(run()) == plain(ledger.validated(spark.createDataFrame(rows, EVENTS)))
    left = spark.read.format("statestore").option("stateVarName", "waiting").load(mark).count()
    assert 0 < left < sum(r[2] == "MadeBasket" for r in rows) / 4  # those of the last seconds


def test_ledger_reads_other_columns_and_null_points(spark, tmp_path):
    rows = [(1, 0, "MadeBasket", 100, 5, 1, 2, "x"), (1, 1, "MadeBasket", 200, 6, 2, 2, "x"), (1, 2, "ThreePointSignal", 250, 0, 0, None, "x"), (1, 3, "ThreePointSignal", 9000, 0, 0, 3, "x"), (2, 0, "ThreePointSignal", 10, 0, 0, 3, "x")]
    write(spark, rows, EVENTS + ", ts string", tmp_path / "in")
    stream = spark.readStream.schema(EVENTS + ", ts string").parquet(str(tmp_path / "in"))
    assert plain(state.run_available(state.ledger(stream), str(tmp_path / "out"), str(tmp_path / "mark"))) == [(1, 0, 2, "MadeBasket", 5, 1, 3)]


def test_ledger_stream_takes_rows_without_players_and_runs_that_are_not_the_last(spark, tmp_path):
    rows = [(g, s, "Foul" if s % 2 else "MadeBasket", 1000 * s, None if s % 4 == 1 else s, 1, None) for s in range(8) for g in (1, 2)]
    rows += [(g, 8, "ThreePointSignal", 7000, None, None, None) for g in (1, 2)]
    for k, last in ((0, False), (1, True)):
        write(spark, [r for r in rows if (r[1] < 4) == (k == 0)], EVENTS, tmp_path / "in")
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        out = state.run_available(state.ledger(stream), str(tmp_path / "out"), str(tmp_path / "mark"), last=last)
    assert plain(out) == plain(ledger.validated(spark.createDataFrame(rows, EVENTS)))


def test_track_table_equals_the_batch_filter(spark, tmp_path):
    rng = random.Random(2)
    schema = "clip_id long, track_id long, frame_idx long, x double, y double, has_pose boolean"
    rows = [(c, t, f, rng.random() * 100, rng.random() * 50, f % 2 == 0) for f in range(90) for c in (1, 2) for t in (3, 4) if rng.random() < 0.9]
    for k in range(3):
        write(spark, [r for r in rows if 30 * k <= r[2] < 30 * (k + 1)], schema, tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.clip_id, r.track_id, r.frame_idx): r for r in state.run_available(state.tracks(stream), str(tmp_path / "out"), str(tmp_path / "mark")).collect()}
    assert len(got) == len(rows)
    df = spark.createDataFrame(rows, schema)
    for column in ("x", "y"):
        for r in tracks.kalman_1d(df, column).collect():
            assert getattr(got[r.clip_id, r.track_id, r.frame_idx], f"court_{column}") == pytest.approx(r.smooth, abs=1e-9)
    last = [got[max(k for k in got if k[:2] == key)] for key in {k[:2] for k in got}]
    assert all(r.team == 1 and r.poses == 30 and r.seen > 60 for r in last)


def test_waiting_baskets():
    w = ledger.Waiting(2000)
    for seq, t in ((0, 500), (1, 100), (2, 400), (3, 9000)):
        w.add(seq, t, seq, 1)
    assert w.take(450) == (1, 100, 1, 1) and w.take(2300) == (0, 500, 0, 1) and w.take(50) is None
    w.drop_before(2401)
    assert w.rows() == [(3, 9000, 3, 1)]
