"""Every query with SQL is run in both engines over the smallest tables; the others are held against plain restatements."""

import math
import os
from collections import defaultdict

import duckdb
import pytest

from trackfold.operators import attribution, ledger
from trackfold.plans import catalogue, people

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # the smallest tables have no candidates of links
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return float(value) if hasattr(value, "quantize") else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_spark_equals_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


def test_validated_baskets_equal_a_plain_fold(spark):
    games = defaultdict(list)
    for r in people.ledger_events(spark, DATA).orderBy("game_id", "seq").collect():
        games[r.game_id].append(r)
    want = []
    for g, rows in games.items():
        waiting = []
        for r in rows:
            if r.kind == "MadeBasket":
                waiting.append(r)
            elif r.kind == "ThreePointSignal":
                hit = next((w for w in waiting if w.t_ms <= r.t_ms <= w.t_ms + ledger.WINDOW_MS), None)
                if hit is not None:
                    waiting.remove(hit)
                    want.append((g, hit.seq, r.seq, "MadeBasket", hit.player_id, hit.team_id, r.points))
            else:
                want.append((g, r.seq, r.seq, r.kind, r.player_id, r.team_id, r.points))
    got = catalogue.QUERIES["sts_06_joi_15_validated_baskets"](spark, DATA)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_bridged_rows_lie_in_gaps(spark):
    links = {(r.clip_id, r.succ): r for r in people._links(spark, DATA).collect()}
    rows = catalogue.QUERIES["sts_10_bridged_rows"](spark, DATA).collect()
    frames = {(r.clip_id, r.frame_idx) for r in rows}
    inside = {(link.clip_id, f) for link in links.values() for f in range(link.end_frame + 1, link.start_frame)}
    assert frames <= inside


def test_rule_table_must_be_whole():
    attribution.validate_rules(attribution.RULES)
    with pytest.raises(ValueError, match="lack"):
        attribution.validate_rules({k: v for k, v in attribution.RULES.items() if k != "steal"})


def test_bridged_rows_work_out_tracks_and_links_once(spark):
    """What several steps read is written once; the last step does not go back to the events."""
    made = catalogue.QUERIES["sts_10_bridged_rows"](spark, DATA)
    assert made.inputFiles() and not any("events.parquet" in f for f in made.inputFiles())


def test_joints_are_worked_out_once(spark):
    """No filter that Spark infers for a generator repeats the joints."""
    for name in ("prj_04_lift_joints", "prj_05_lift_on_floor", "prj_23_box_normalise"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "transform(" in line]


def test_audit_files_are_made_of_a_written_report(spark, monkeypatch):
    from trackfold.sources import reports

    seen = []
    write = reports.write_audit
    monkeypatch.setattr(reports, "write_audit", lambda report, *rest: (seen.append(report), write(report, *rest)))
    catalogue.QUERIES["snk_09_srt_06_audit_files"](spark, DATA)
    assert seen and not any("events.parquet" in f for f in seen[0].inputFiles())


def test_hypotheses_work_out_tracks_once(spark):
    made = catalogue.QUERIES["sco_06_srt_04_hypotheses"](spark, DATA)
    assert made.inputFiles() and not any("events.parquet" in f for f in made.inputFiles())


def test_pairs_of_tracks_take_one_exchange(spark):
    """The events are dealt by clip while they are narrow; ends of tracks and their pairs are not shuffled."""
    for name in ("joi_06_sco_04_link_candidates", "joi_07_hypothesis_candidates", "sco_05_win_10_selected_links"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan


def shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_hypotheses_shuffle_events_once_and_not_all_candidates(spark):
    events = spark.read.parquet(f"{LARGER}/events.parquet").count()
    candidates = catalogue.QUERIES["joi_07_hypothesis_candidates"](spark, LARGER).count()
    before = shuffled(spark)
    catalogue.QUERIES["sco_06_srt_04_hypotheses"](spark, LARGER).collect()
    assert 0 < sum(n for s, n in shuffled(spark).items() if s not in before) < events + candidates
