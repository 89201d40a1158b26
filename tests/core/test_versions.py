"""Writers that fail, repeat and collide; readers see whole versions."""

import pytest
from pyspark.sql import functions as F

from trackfold.operators import review
from trackfold.sources import stores, versions

SCHEMA = "clip_id string, version long"


def table(spark, path):
    return versions.VersionedTable(spark, str(path), SCHEMA)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_upserts_replace_and_add(spark, tmp_path):
    t = table(spark, tmp_path)
    assert content(t) == [] and t.current().number == 0
    t.append(rows(spark, [("a", 1), ("b", 1), ("b", 1)]), "one")
    assert t.upsert(rows(spark, [("b", 2), ("c", 2)]), "clip_id").number == 2
    assert content(t) == [("a", 1), ("b", 2), ("c", 2)]
    before = t.current()
    t.upsert(rows(spark, [("c", 3), ("c", 4)]), "clip_id")
    assert content(t) == [("a", 1), ("b", 2), ("c", 3), ("c", 4)]
    after = t.current()
    assert len([b for b in before.folders if before.folders[b] != after.folders[b]]) == 1  # one bucket was rewritten
    assert sorted(tuple(r) for r in t.read(before).collect()) == [("a", 1), ("b", 2), ("c", 2)]  # a reader of the old version
    t.append(rows(spark, [("d", 5)]), "two")
    t.upsert(rows(spark, []), "clip_id")
    t.upsert(rows(spark, [("d", 6), (None, 7)]), "clip_id")
    assert {r.clip_id: r.version for r in t.read().where("clip_id IS NULL OR clip_id = 'd'").collect()} == {"d": 6, None: 7}


def test_a_batch_is_written_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for _ in range(2):
        t.append(rows(spark, [("a", 1)]), "one")
    t.append(rows(spark, [("a", 1)]), "two")
    assert content(t) == [("a", 1), ("a", 1)] and t.current().number == 2


def test_failed_writers_leave_the_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(rows(spark, [("a", 1)]), "one")
    broken = rows(spark, [("b", 2)]).withColumn("version", F.raise_error(F.lit("lost")).cast("long"))
    for write in (lambda: t.append(broken, "two"), lambda: t.upsert(broken, "clip_id")):
        with pytest.raises(Exception, match="lost"):
            write()
    monkeypatch.setattr(t, "_commit", lambda v: (_ for _ in ()).throw(OSError("the writer died")))
    with pytest.raises(OSError, match="died"):
        t.upsert(rows(spark, [("a", 9)]), "clip_id")
    monkeypatch.undo()
    assert content(t) == [("a", 1)] and t.current().number == 1
    t.append(rows(spark, [("b", 2)]), "two")  # repeated, it succeeds
    assert content(t) == [("a", 1), ("b", 2)]


def test_of_two_writers_one_begins_again(spark, tmp_path, monkeypatch):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.append(rows(spark, [("a", 1)]), "one")
    with pytest.raises(versions.Conflict, match="not 0"):
        two.append(rows(spark, [("b", 1)]), "two", expected=0)
    seen = one.current()
    two.upsert(rows(spark, [("b", 1)]), "clip_id")
    with monkeypatch.context() as m:  # this writer read the version before the other's commit
        m.setattr(one, "current", lambda: seen)
        with pytest.raises(versions.Conflict, match="another writer"):
            one.upsert(rows(spark, [("c", 1)]), "clip_id")
    assert content(one) == [("a", 1), ("b", 1)]
    tries = []

    def step():
        tries.append(1)
        if len(tries) == 1:
            raise versions.Conflict("first")
        return one.upsert(rows(spark, [("c", 1)]), "clip_id")

    assert versions.retried(step).number == 3 and content(one) == [("a", 1), ("b", 1), ("c", 1)]


def test_feedback_is_validated_then_appended(spark, tmp_path):
    frames = spark.createDataFrame([("x", 1), ("x", 2)], "clip_id string, frame_idx long")
    tracks = spark.createDataFrame([("x", 1, 7)], "clip_id string, frame_idx long, track_id int")
    schema = stores.FEEDBACK
    given = [
        ("x", 1, 33, "track_error", "t", "7", None),  # no note is needed
        ("x", 1, 33, "track_error", "t", "", "n"),
        ("x", 2, 66, "track_error", None, None, "n"),
        ("x", 2, 66, "other", "t", None, "n"),
        ("y", 2, 66, "track_error", "t", None, "n"),
        ("x", 9, 66, "track_error", "t", None, "n"),
        ("x", 2, 66, "track_error", "t", "7", "n"),
        (None, 2, 66, "track_error", "t", "7", "n"),
    ]
    feedback = spark.createDataFrame(given, schema)
    store = stores.feedback_store(spark, str(tmp_path / "f"))
    for _ in range(2):
        version, refused = stores.append_feedback(store, feedback, frames, tracks, "one")
    assert version.number == 1 and store.read().count() == 2
    assert sorted(r.problem for r in refused.collect()) == ["clip", "frame", "issue_type", "missing_field", "missing_field", "track"]
    assert review.validated_feedback(feedback.limit(0), frames, tracks).count() == 0


def test_calibrations_of_a_store(spark, tmp_path):
    m = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    store = stores.calibration_store(spark, str(tmp_path / "c"))
    stores.upsert_calibrations(store, spark.createDataFrame([("a", m), ("b", m)], "clip_id string, h_matrix array<array<double>>"))
    stores.upsert_calibrations(store, spark.createDataFrame([("b", {"7": m, "9": m})], "clip_id string, h_sequence map<string,array<array<double>>>"))
    got = sorted(((r.clip_id, r.frame_idx, len(r.h)) for r in stores.homographies(store).collect()), key=str)
    assert got == [("a", None, 9), ("b", 7, 9), ("b", 9, 9)]
