import hashlib
import os
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trackfold.llm import bytebpe, common, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = "aeinot ▁ab\n\n  中é\U0001f600.,'\x00s'tll've 12٣ 　\u0085"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    # letters, numbers, marks and unassigned code points of all planes
    points = [c for c in (rng.randrange(0x20, 0x32400) for _ in range(6000)) if not 0xD800 <= c < 0xE000]
    made += ["".join(map(chr, points[i : i + 30])) for i in range(0, len(points), 30)]
    made += ["".join(rng.choice("ACGT") for _ in range(1500)), "a" * 2000, "ab" * 900, " " * 2000, "=" * 999, "naïve日本語" * 100, "word " * 20_000]
    return [*made, "", " ", "x", None]


def test_ids_and_bytes_equal_the_library(spark, library):
    all_ = texts()
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(all_)], "doc_id long, text string, n int, ids string, bpe_ids string").repartition(4)
    got = {r.doc_id: r for r in bytebpe.encode_decode(docs, PATH, PATTERN).collect()}
    assert len(got) == len(all_)
    for i, t in enumerate(all_):
        assert got[i].bpe_ids == library.encode_ordinary(t or ""), repr(t)[:80]
        assert bytes(got[i].bpe_bytes) == (t or "").encode() and got[i].ids == "x" and got[i].n == 1


def test_letters_and_numbers_are_those_of_the_library(spark, library):
    pattern = bytebpe.java_pattern(spark, r"\p{L}+|\p{N}+|.")
    for kind, front in (("L", "a"), ("N", "1")):
        points = sorted(bytebpe._class_of_library(kind))
        text = "\n".join(front + chr(c) for c in points)
        one = spark.createDataFrame([(text,)], "t string").select(F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))).first()[0]
        assert one == len(points)


def test_words_by_literal_and_by_join_agree(spark, library, monkeypatch):
    rows = [(i % 3, t) for i, t in enumerate(["the cat sat on the mat", "the the the", "zyzzyva quux the", None, ""])]
    rows += [(7, "copies of one text")] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def digests():
        return sorted(tuple(r) for r in bytebpe.token_digests(docs, PATH, PATTERN).collect())

    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert digests() == sorted(want)
    monkeypatch.setattr(bytebpe, "COMMON", 0)  # no word is in the plan
    assert digests() == sorted(want)


def test_short_and_long_words_merge_alike(spark, monkeypatch):
    words = spark.createDataFrame([("".join(random.Random(i).choice("abno ") for _ in range(40)),) for i in range(60)], "w string")
    vocabulary = bytebpe.Vocabulary(spark, PATH, PATTERN)

    def ids():
        folded = bytebpe._let(vocabulary.table, lambda t: bytebpe.fold_ids(t, F.encode("w", "UTF-8")))
        return [r[0] for r in words.select(folded).collect()]

    want = ids()
    monkeypatch.setattr(bytebpe, "SHORT", 0)
    assert ids() == want
    monkeypatch.setattr(bytebpe, "SHORT", 1000)
    assert ids() == want


def test_a_round_that_would_overtake_merges_one_pair(spark, tmp_path, library):
    """Ranks that are not in the order of training: (ab)(a) has a smaller rank than ab."""
    import base64

    extra = [b"aba", b"ab", b"ba", b"bab", b"abab"]
    pieces = [*(bytes([b]) for b in range(256)), *extra]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for r, p in enumerate(pieces)))
    own = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(str(path)), special_tokens={})
    rng = random.Random(5)
    all_ = ["".join(rng.choice("ab") for _ in range(n)) for n in (5, 20, 33, 50, 64, 80, 200) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string")
    got = {r.doc_id: r.bpe_ids for r in bytebpe.encode_decode(docs, str(path), PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in enumerate(all_)}


def test_spread_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 300)], "k long, v long").repartition(3)
    table = spark.createDataFrame([(k, str(k)) for k in range(0, 250)], "k long, name string")
    out = common.spread_join(rows, table, "k")
    assert out.columns == ["k", "v", "name"]
    assert sorted(tuple(r) for r in out.fillna("-").collect()) == sorted((k, v, str(k) if k < 250 else "-") for k, v in [(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 300)])
    assert common.spread_join(rows.limit(0), table, "k").count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.token_digests(docs, PATH, PATTERN).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert sorted(tuple(r) for r in queries.op12_byte_bpe(spark, DATA).collect()) == sorted(want)


def test_texts_are_not_shuffled(spark, library, monkeypatch):
    """Neither texts nor their words go through an exchange or a join, which cost several times the input of disk."""
    rows = [(i, f"zyzzyva{i % 7} quux{i} the cat", i * 2) for i in range(300)] + [(300, None, 0), (301, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    for limit in (1, 3000, 1 << 25):  # each batch alone, and groups of many
        monkeypatch.setattr(bytebpe, "GROUP_BYTES", limit)
        made = bytebpe.encode_decode(docs, PATH, PATTERN)
        got = {r.doc_id: (r.text, r.n, r.bpe_ids, bytes(r.bpe_bytes)) for r in made.collect()}
        assert got == {i: (t, n, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, n in rows}
    source = queries.read_table(spark, DATA, "documents") if os.path.isdir(DATA) else docs.coalesce(3)
    plan = bytebpe.token_digests(source, PATH, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and ("Exchange" not in plan or not os.path.isdir(DATA))
