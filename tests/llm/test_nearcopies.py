import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from trackfold.llm import nearcopies
from trackfold.llm.words import word_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    """Probability Jaccard by its definition, for weights 1 + ln(count)."""
    x, y = ({k: 1 + math.log(n) for k, n in c.items()} for c in (a, b))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def fast(a, b):
    """The same for large sets (held against ``similarity`` below)."""
    number = {k: n for n, k in enumerate(a.keys() | b.keys())}
    sets = [sorted((number[k], 1 + math.log(n)) for k, n in c.items()) for c in (a, b)]
    return nearcopies.probability_jaccard(*(np.array(x, t) for s in sets for x, t in zip(zip(*s, strict=True), (np.uint64, float), strict=True)))


def classes(rows):
    """Brute force: the smallest key of each connected component of probability Jaccard >= 0.8."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            owners[k].append(i)
    pairs = {(i, j) for o in owners.values() for n, j in enumerate(o) for i in o[:n]}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in sorted(pairs):
        a, b = sets[i], sets[j]
        # the overlap of the weights is never below the similarity
        if len(a & b) >= 0.5 * len(a | b) and root(i) != root(j) and fast(a, b) >= 0.8 - 1e-9:
            up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return {i: min(rows[j][0] for j in g) for g in groups.values() for i in g}


def fixture(seed=4, n_groups=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.choice([4, 8, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", ", "]).join(copy))
    texts += ["a b", "a b", "A, b!", "a b c", "same line here\n" * 40, "same line here\n" * 41, " ".join(words * 3)]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 2**40, 60).astype(np.uint64)
    weight = rng.integers(1, 5, 60).astype(float)
    w1, w2 = weight.copy(), weight.copy()
    w1[:15], w2[15:30] = 0, 0
    w2[30:40] *= 3
    parts = [np.flatnonzero(w1), np.flatnonzero(w2)]
    elements = np.concatenate([x[p] for p in parts])
    sig = nearcopies.prob_min_hash(elements, np.concatenate([w1[parts[0]], w2[parts[1]]]), np.array([0, len(parts[0]), len(elements)]), 4096)
    want = sum(1 / sum(max(w1[j] / w1[i], w2[j] / w2[i]) for j in range(60)) for i in range(60) if w1[i] and w2[i])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_exact_similarity():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = (Counter(dict(zip(map(int, rng.integers(0, 40, 25)), map(int, rng.integers(1, 9, 25)), strict=True))) for _ in range(2))
        sets = [(np.array(sorted(c), np.uint64), 1 + np.log([c[k] for k in sorted(c)])) for c in (a, b)]
        assert abs(nearcopies.probability_jaccard(*sets[0], *sets[1]) - similarity(a, b)) < 1e-12


def test_groups_have_the_components_of_all_links():
    rows = fixture(7)
    label = nearcopies.linked(pa.array([t for _, t in rows]), np.full(len(rows), 2))
    assert dict(enumerate(label.tolist())) == classes(rows)


def test_counts_matter():
    base = [f"w{k}" for k in range(104)]
    heavy = " ".join(base) + " " + "x1 x2 x3 x4 x5 x6 " * 1000
    rows = [(0, heavy), (1, " ".join([*base, "x1 x2 x3 x4 x5 x6"])), (2, heavy + " end")]
    assert nearcopies.linked(pa.array([t for _, t in rows]), np.full(3, 2)).tolist() == [classes(rows)[i] for i in range(3)]


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = fixture()
    want = classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' node", "1 bands", "2 key")
    for block, hubs in ((512, 16), (3, 2)):
        monkeypatch.setattr(nearcopies, "BLOCK_MEMBERS", block)
        monkeypatch.setattr(nearcopies, "HUBS", hubs)
        got = {r.doc_id: r.class_id for r in nearcopies.near_copies(docs).collect()}
        assert got == {rows[i][0]: c for i, c in want.items()}
    kept = nearcopies.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"x{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, "?!"), (4, long), (4, long), (None, long + " y"), (5, long.upper()), (6, "other words"), (6, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nearcopies.near_copies(docs).collect()
    assert len(got) == len(rows)
    assert {r.class_id for r in got if r.doc_id in (None, 4, 5)} == {None}
    kept = sorted(((r.doc_id, r.text) for r in nearcopies.without_near_copies(docs).collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (3, "?!"), (None, long + " y"), (6, "other words"), (6, "quite another text")], key=str)
    twice = spark.createDataFrame([(4, long), (4, long)], "doc_id long, text string")
    assert nearcopies.without_near_copies(twice).count() == 1
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_sets_of_a_slice():
    data = np.frombuffer(b"a b c d e f a b c d e", np.uint8)
    hashes, _, _, first = word_table(data, np.array([0, len(data)]))
    _, count, at = nearcopies.weighted_sets(hashes, first)
    assert sorted(count.tolist()) == [1] * 5 + [2] and at.tolist() == [0, 6]


def test_a_bucket_whose_members_are_no_copies(spark, monkeypatch):
    """Links that only the second round can find: hubs reach few members of a bucket that is a chain."""
    rng = random.Random(1)
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signs = nearcopies.signed(docs).collect()
    assert len(signs) == 60
    monkeypatch.setattr(nearcopies, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(nearcopies, "HUBS", 1)
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(docs).collect()}
    assert got == {rows[i][0]: c for i, c in classes(rows).items()}


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {rows[i][0]: c for i, c in classes([(k, t) for k, t in rows]).items()}
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(docs).collect()}
    copies = [k for k, c in want.items() if k != c]
    assert len(copies) > 20 and sum(got[k] == want[k] for k in copies) >= 0.99 * len(copies)
    assert all(got[k] == k for k, c in want.items() if k == c)


def test_very_long_text(spark):
    long = " ".join(f"v{k * 7919 % 199999}" for k in range(150000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, long[: len(long) // 4])], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nearcopies.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven eight"
    names = "doc_id long, text string, __gone string, __gone_hash long, __same int, __SAME_HASH int, __h int, class_id int, text_hash int"
    docs = spark.createDataFrame([(1, text, "a", 1, 2, 3, 4, 5, 6), (2, text, "b", 1, 2, 3, 4, 5, 6), (1, text, "c", 1, 2, 3, 4, 5, 6), (3, None, "d", 1, 2, 3, 4, 5, 6)], names)
    out = nearcopies.without_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
