import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from trackfold.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [] if text is None else WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = ["a", "b", "Ab", "é", "中文", "x1", "zz", "the"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.choice([1, 3, 12, 13, 14, 40]))) for k in range(12)] + [(100, None), (101, ""), (102, "..."), (7, "Ab zz")]
    docs = [(k, make(rng.randint(0, 30))) for k in range(40)]
    for k in range(40, 90):
        item = rng.choice(items)[1] or ""
        docs.append((k, make(rng.randint(0, 300)) + "\n-- " + item.upper() + ". " + make(rng.randint(0, 20))))
    docs += [(90, None), (91, ""), (92, "!!!"), (93, make(30000) + items[3][1]), (94, docs[50][1]), (94, docs[50][1])]
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_report_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    docs, items = fixture()
    items = [i for i in items if i[1] is None or len(words(i[1])) > 2] if block > 100 else items
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' n_words", "1 items")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contamination_report(d, b)
    rows = sorted(tuple(r)[:6] for r in got.collect())
    assert rows == sorted(brute(docs, items))
    kept = contamination.decontaminate(d, b)
    assert kept.columns == d.columns
    clean = sorted(r[0] for r in brute(docs, items) if not r[5])
    assert sorted(r.doc_id for r in kept.collect()) == clean


def longest(docs, items, width=13):
    """Brute force: (doc, [(doc_word, n_words, item, item_word)]) of all maximal matches that hold a window."""
    out = {}
    every = [(str(k), words(t)) for k, t in items]
    for doc, text in docs:
        w, best = words(text), {}
        for i in range(len(w)):
            for name, v in every:
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n and (n >= width or (j == 0 and n == len(v))):
                        best.setdefault(i, []).append((i, n, name, j))
        # the length at a place is that of the longest match with any part of an item, where a window begins
        full = {}
        for i in best:
            full[i] = max(next((n for n in range(min(len(w) - i, len(v) - j), 0, -1) if w[i : i + n] == v[j : j + n]), 0) for _, v in every for j in range(len(v)))
        found = []
        for i, n in full.items():
            if full.get(i - 1) != n + 1:
                found += [(i, n, name, j) for name, v in every for j in range(len(v)) if v[j : j + n] == w[i : i + n]]
        out.setdefault(doc, []).append(sorted(found))
    return {k: sorted(v) for k, v in out.items()}


def test_longest_matches_and_places(spark):
    passage = [f"w{i}" for i in range(60)]
    items = [(9, " ".join(passage)), (10, "x " + " ".join(passage[5:45])), (11, "one two three"), (12, " ".join(["q r"] * 10))]
    docs = [(k, f"zero{k} " + " ".join(passage[5 + k : 46 + k]) + f" end{k} one two three") for k in range(4)]
    docs += [(k, " ".join(passage[5:45]) + " and more") for k in range(10, 14)] + [(20, " ".join(["q r"] * 13)), (21, "one two"), (22, None)]
    report = contamination.contamination_report(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r for r in report.collect()}
    want = longest(docs, items)
    for k, r in got.items():
        assert [sorted(tuple(m) for m in r.matches)] == want[k], k
        assert r.longest_match == max((m[1] for m in want[k][0]), default=0)
    assert got[10].longest_match == 40 and {m.item for m in got[10].matches} == {"9", "10"}


def test_a_benchmark_of_many_blocks(spark):
    """30 MB in four blocks; one item is larger than a block."""
    passage = [f"p{i}" for i in range(50)]
    filler = lambda k, n: " ".join(f"f{k}x{i}" for i in range(n))
    items = [(k, filler(k, 60000)) for k in range(30)] + [(100, filler(100, 900000)), (101, " ".join(passage))]
    assert sum(len(t) for _, t in items) > 27e6 and len(items[30][1]) > contamination.BLOCK_BYTES
    parts = list(contamination._parts(*items[30], 13))
    assert len(parts) > 1 and max(len(p[1]) for p in parts) <= contamination.BLOCK_BYTES
    border = parts[1][2]
    big = items[30][1].split()
    docs = [(k, "start " + " ".join(items[k][1].split()[100:120]) + " end") for k in range(30)]
    docs += [(50, " ".join(big[border - 20 : border + 40])), (51, " ".join(passage)), (51, " ".join(passage)), (52, "nothing here"), (53, None), (54, " ".join(passage[:30]) + " gap " + " ".join(items[3][1].split()[7:27]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated, r.longest_match) for r in contamination.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), b).collect())
    want = [(k, 22, 20, 1, True, 20) for k in range(30)] + [(51, 50, 50, 1, True, 50)] * 2 + [(52, 2, 0, 0, False, 0), (53, 0, 0, 0, False, 0), (54, 51, 50, 2, True, 30)]
    assert [g for g in got if g[0] != 50] == want
    assert [g[1:5] for g in got if g[0] == 50] == [(60, 60, 1, True)]


def test_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = spark.createDataFrame([(1, "a b c")], schema)
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination.contamination_report(docs, items).collect()] == [False]
    assert contamination.contamination_report(spark.createDataFrame([], schema), items).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, 7, "x"), (2, "clean", 8, "y")], "doc_id long, text string, __TF_hits int, __own string")
    out = contamination.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "clean", 8, "y")]
