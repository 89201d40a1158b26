"""Canonical ids and hypothesis groups: rounds on long chains, and results of plain walks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from trackfold.operators import components, identity

LINKS = "clip_id long, pred long, succ long, gap long, score double"


@pytest.fixture
def rounds(monkeypatch):
    """How many tables were written."""
    count = []

    def counted(df, real=components.saved):
        count.append(1)
        return real(df)

    monkeypatch.setattr(components, "saved", counted)
    monkeypatch.setattr(identity, "saved", counted)
    return count


def walked(links):
    """Links applied one by one: a successor takes its predecessor's id of that moment."""
    ids = {}
    for clip, pred, succ, gap, score in sorted(links, key=lambda r: (r[0], -r[4], r[3], r[2])):
        ids[clip, succ] = ids.get((clip, pred), pred)
    return sorted((c, t, i) for (c, t), i in ids.items())


@pytest.mark.parametrize("falling", [True, False])
def test_a_chain_of_a_thousand_links(spark, rounds, falling):
    links = [(1, i, i + 1, 1, 0.9 - i * 1e-4 if falling else 0.5 + i * 1e-4) for i in range(1000)]
    got = sorted(tuple(r) for r in identity.canonical_ids(spark.createDataFrame(links, LINKS)).collect())
    assert got == walked(links)
    assert {r[2] for r in got} == ({0} if falling else set(range(1000)))
    assert len(rounds) <= (math.ceil(math.log2(1000)) + 2 if falling else 1)


def test_chains_of_any_order(spark):
    rng = random.Random(8)
    links = []
    for clip in range(6):
        tracks = list(range(60))
        rng.shuffle(tracks)
        links += [(clip, a, b, rng.randint(1, 3), rng.choice([0.7, 0.8, 0.9])) for a, b in zip(tracks, tracks[1:], strict=False) if rng.random() < 0.9]
    assert sorted(tuple(r) for r in identity.canonical_ids(spark.createDataFrame(links, LINKS)).collect()) == walked(links)
    assert identity.canonical_ids(spark.createDataFrame([], LINKS)).count() == 0


def grouped(links):
    top = {}

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for clip, pred, succ, *_ in links:
        top[find((clip, "p", pred))] = find((clip, "s", succ))
    least = {}
    for clip, pred, succ, *_ in links:
        root = find((clip, "p", pred))
        least[root] = min(least.get(root, (pred, succ)), (pred, succ))
    return sorted((c, p, s, *least[find((c, "p", p))]) for c, p, s, *_ in links)


def groups(spark, links):
    out = identity.hypothesis_groups(spark.createDataFrame(links, LINKS)).select("clip_id", "pred", "succ", "group_key.pred", "group_key.succ")
    return sorted(tuple(r) for r in out.collect())


def test_groups_along_a_long_path(spark, rounds):
    ids = list(range(500))
    random.Random(3).shuffle(ids)
    links = [(1, ids[i], ids[i + k], 1, 0.6) for i in range(499) for k in (0, 1)]  # one path of a thousand ends
    assert groups(spark, links) == grouped(links)
    assert len(rounds) <= 2 * math.ceil(math.log2(1000))


def test_groups_of_any_shape(spark):
    rng = random.Random(5)
    links = sorted({(rng.randrange(3), rng.randrange(80), rng.randrange(80)) for _ in range(150)})
    links = [(*r, 1, 0.6) for r in links] + [(9, 1, 2, 1, 0.6)] + [(8, 0, i, 1, 0.6) for i in range(100)]
    assert groups(spark, links) == grouped(links)
    assert groups(spark, []) == []


def test_smallest_nodes_of_edges():
    rng = random.Random(4)
    for n in (0, 1, 5, 300):
        links = [(rng.randrange(3), 2 * rng.randrange(100), 2 * rng.randrange(100) + 1) for _ in range(n)]
        links += [(7, 2 * (i // 2), 2 * ((i + 1) // 2) + 1) for i in range(n)]  # a path
        part, a, b = (np.array([r[i] for r in links], np.int64) for i in range(3))
        label, group, ends = components.smallest_nodes(part, a, b)
        assert all(len({*zip(part.tolist(), x.tolist(), strict=True)}) == len({*zip(part.tolist(), x.tolist(), n.tolist(), strict=True)}) for x, n in zip((a, b), ends, strict=True))
        want = [min(2 * p, 2 * s + 1) for p, s in _members(links)]
        assert label.tolist() == want
        assert len({*zip(part.tolist(), group.tolist(), strict=True)}) == len({*group.tolist()}) == len({*zip(part.tolist(), want, strict=True)})


def _members(links):
    """(smallest predecessor, smallest successor) of each link's component."""
    least = {}
    todo = True
    while todo:
        todo = False
        for clip, a, b in links:
            both = (min(a // 2, least.get((clip, a), (a // 2,))[0], least.get((clip, b), (a // 2,))[0]), min(b // 2, least.get((clip, a), (0, b // 2))[1], least.get((clip, b), (0, b // 2))[1]))
            for end in ((clip, a), (clip, b)):
                if least.get(end) != both:
                    least[end] = both
                    todo = True
    return [least[clip, a] for clip, a, _ in links]


def test_batches_end_where_clips_do(monkeypatch):
    monkeypatch.setattr(identity, "BATCH", 10)
    clips = ["a"] * 4 + ["b"] * 9 + ["c"] * 25 + ["d"] * 2
    batches = [pa.RecordBatch.from_pydict({"clip_id": clips[i : i + 3]}) for i in range(0, 40, 3)]
    got = [t.column("clip_id").to_pylist() for t in identity._by_clips(iter(batches))]
    assert sum(got, []) == clips
    assert [sorted(set(t)) for t in got[:2]] == [["a"], ["b"]]  # only "c", which is too large, is cut
    assert not {"a", "b", "d"} & {c for x, y in zip(got, got[1:], strict=False) for c in set(x) & set(y)}
    assert list(identity._by_clips(iter([]))) == []


def test_hypotheses_of_scattered_candidates(spark):
    """Clips that lie in many batches, any choice of links: as a plain walk gives it."""
    rng = random.Random(6)
    links = [(*r, rng.randint(1, 3), rng.choice([0.55, 0.6, 0.61, 0.7, 0.9])) for r in sorted({(rng.randrange(4), rng.randrange(40), rng.randrange(40)) for _ in range(130)})]
    chosen = [r for r in links if rng.random() < 0.1] + [(0, 777, 778, 1, 0.9)]
    of = {(c, p, s): (gp, gs) for c, p, s, gp, gs in grouped(links)}
    groups_ = {}
    for r in links:
        groups_.setdefault((r[0], *of[r[:3]]), []).append(r)
    want = []
    for (clip, gp, gs), rows in groups_.items():
        rows = sorted(rows, key=lambda r: (-r[4], r[3], r[2], r[1]))
        taken = [r in chosen for r in rows]
        other = max((r[4] for r, t in zip(rows, taken, strict=True) if not t), default=0.0)
        group_status = "deferred" if not any(taken) else "ambiguous_selected" if other >= rows[0][4] - 0.05 else "selected"
        for rank, (r, t) in enumerate(list(zip(rows, taken, strict=True))[:3], 1):
            status = "selected" if t else "alternate" if any(taken) else "deferred"
            want.append((clip, gp, gs, rank, *r[1:], round(rows[0][4] - r[4], 4), status, group_status, len(rows)))
    rng.shuffle(links)
    made = identity.hypotheses(spark.createDataFrame(links, LINKS).repartition(7), spark.createDataFrame(chosen, LINKS))
    assert sorted(tuple(r) for r in made.collect()) == sorted(want)


def test_selection_of_scattered_candidates(spark):
    """What batches select by themselves is put right for clips that lie in several."""
    rng = random.Random(9)
    pairs = sorted({(rng.randrange(6), rng.randrange(30), rng.randrange(30)) for _ in range(160)})
    links = spark.createDataFrame([(*r, rng.randint(1, 3), rng.choice([0.6, 0.7, 0.75, 0.77, 0.84, 0.9, 0.96])) for r in pairs], LINKS)
    linked = links.withColumn("linked", (links.score >= 0.7) & (links.pred % 5 != 0))
    want = sorted(tuple(r) for r in identity.hypotheses(links, identity.selected(linked.where("linked"))).collect())
    assert {r[9] for r in want} == {"selected", "alternate", "deferred"}
    for n in (1, 7):
        assert sorted(tuple(r) for r in identity.hypotheses(linked.repartition(n)).collect()) == want


def test_selection_in_a_batch(spark):
    rng = random.Random(2)
    for n in (0, 1, 60):
        pairs = sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(n)})
        links = [(1, *r, 1, rng.choice([0.03, 0.5, 0.6, 0.66, 0.7])) for r in pairs]
        ends, score = (np.array([r[1] for r in links], int), np.array([r[2] for r in links], int)), np.array([r[4] for r in links], float)
        got = [r[:3] for r, taken in zip(links, identity._unrivalled(ends, score), strict=True) if taken]
        assert got == sorted(tuple(r)[:3] for r in identity.selected(spark.createDataFrame(links, LINKS)).collect())
