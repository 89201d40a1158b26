import random

import pytest
from pyspark.sql import functions as F

from trackfold.operators import sampling


def clips(spark, n=20, parts=1, seed=0):
    rows = [(f"c{i}", 151 + 37 * i) for i in range(n)] + [("short", 150), ("none", None), (None, 900)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "clip_id string, frames long").repartition(parts)


def draws(df, cap, seed=1, **more):
    return sorted(tuple(r) for r in sampling.sampled(df, cap, seed, **more).collect())


@pytest.mark.parametrize("by_length", [False, True])
def test_same_for_any_partitions_and_order(spark, by_length):
    want = draws(clips(spark), 500, by_length=by_length, most=None)
    assert [d[0] for d in want] == list(range(500))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert draws(clips(spark, parts=7, seed=5), 500, by_length=by_length, most=None) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert draws(clips(spark), 500, seed=2, by_length=by_length, most=None) != want
    assert draws(clips(spark), 200, by_length=by_length, most=None) == want[:200]


@pytest.mark.parametrize("by_length", [False, True])
def test_frequencies(spark, by_length):
    """Chi-square over 20 clips: with 19 degrees of freedom beyond 43.8 once in a thousand."""
    n = 20_000
    got = {r.clip_id: r.n for r in sampling.sampled(clips(spark), n, 11, by_length=by_length, most=None).groupBy("clip_id").agg(F.count("*").alias("n")).collect()}
    weight = {f"c{i}": (151 + 37 * i) if by_length else 1 for i in range(20)}
    total = sum(weight.values())
    assert set(got) == set(weight)
    assert sum((got[c] - n * w / total) ** 2 / (n * w / total) for c, w in weight.items()) < 43.8


def test_starts_fit_and_reach_both_ends(spark):
    rows = draws(spark.createDataFrame([("a", 153)], "clip_id string, frames long"), 400, most=None)
    assert {r[3] for r in rows} == {0, 1, 2, 3}
    assert all(r[4] == r[3] / 30.0 for r in rows)


def test_cap_heavy_clips_and_nothing_to_draw(spark):
    few = spark.createDataFrame([("a", 200), ("b", 300), ("b", 300)], "clip_id string, frames long")
    assert len(draws(few, 50)) == 7  # two for each row and one more
    heavy = spark.createDataFrame([(f"c{i}", 151) for i in range(200)] + [("big", 10**12)], "clip_id string, frames long")
    got = draws(heavy, 300, by_length=True, most=None)
    assert len(got) == 300 and all(r[1] == "big" for r in got)
    assert draws(few.where("frames < 0"), 50) == []
    assert draws(few, 0) == []
