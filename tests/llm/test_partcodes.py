import hashlib
import math
import os
import random

import numpy as np
import pytest

from trackfold.llm import partcodes, queries

DATA = "/root/testdata/sf0.001"


def plainly(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract over lists of Python integers, every vector by itself; rows are (key, vector, label)."""
    kept = [(k, [math.floor(scale * float(np.float32(v))) for v in x], label) for k, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for size in {len(x) for _, x, _ in kept}:
        mine = [r for r in kept if len(r[1]) == size]
        cut = lambda x: [x[size * p // parts : size * (p + 1) // parts] for p in range(parts)]
        books = list(zip(*(cut(x) for _, x, _ in sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]), strict=True))

        def near(book, v):
            d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
            return d.index(min(d)), min(d)

        for _ in range(rounds):
            new = []
            for p in range(parts):
                groups = {}
                for _, x, _ in mine:
                    v = cut(x)[p]
                    groups.setdefault(near(books[p], v)[0], []).append(v)
                new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
            books = new
        digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
        for k, x, label in mine:
            found = [near(books[p], v) for p, v in enumerate(cut(x))]
            out.append([k, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found), label, digest])
    of = {}
    for _, _, e, label, _ in out:
        of[label] = of.get(label, 0) + e
    return sorted(((k, c, e, of[label], d) for k, c, e, label, d in out), key=str)


def compressed(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(k, x, label, 1) for k, x, label in rows], f"vec_id long, embedding array<{kind}>, label string, code int").repartition(3)
    return sorted((tuple(r) for r in partcodes.compressed(df, **more).collect()), key=str)


def test_equals_plain_lists(spark):
    rng = random.Random(3)
    grid = [-0.5, -0.25, -1 / 4096, 0.0, 1e-5, 0.3]
    rows = [(i, [rng.choice(grid) for _ in range(16)], rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(1000 + i, [0.1 * (i % 3)] * 16, "hot") for i in range(120)]  # copies of three vectors
    rows += [(5, [0.7] * 16, "a"), (5, [0.7] * 16, "a"), (None, [0.2] * 16, None)]
    rows += [(7, None, "a"), (8, [None] * 16, "a"), (9, [math.nan] * 16, "a"), (10, [math.inf] + [0.0] * 15, "b")]
    rows += [(2000 + i, [rng.random() for _ in range(11)], "z") for i in range(20)]  # a length that eight does not divide
    rows += [(3000, [], "z"), (3001, [0.5, 0.25, 0.125], "y")]
    want = plainly(rows)
    assert compressed(spark, rows) == want
    assert len(want) == len(rows) - 4


def test_few_vectors_and_other_parameters(spark):
    rows = [(i, [0.01 * i, -0.02 * i, 0.5, 0.25], "a") for i in range(5)]
    assert compressed(spark, rows) == plainly(rows)
    assert compressed(spark, rows, parts=2, entries=3, rounds=2, scale=10) == plainly(rows, 2, 3, 2, 10)
    assert compressed(spark, []) == []
    with pytest.raises(ValueError, match="256"):
        compressed(spark, rows, entries=300)


def test_large_components(spark):
    """Beyond 64 bits distances are still exact; what no column can hold is null."""
    rows = [(i, [float(np.float32(3e9 * (i + 1)))] * 8, "a") for i in range(20)] + [(100, [0.5] * 8, "b")]
    got = {r[0]: r for r in compressed(spark, rows)}
    fits = lambda e: e if e < 1 << 63 else None
    for k, c, e, le, d in plainly(rows):
        assert got[k] == (k, c, fits(e), fits(le), d)
    with pytest.raises(Exception, match="too large"):
        compressed(spark, [(1, [1e19] * 8, "a")])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_equals_plain_lists(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    df = queries.op11_part_codes(spark, DATA)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == plainly(rows)
