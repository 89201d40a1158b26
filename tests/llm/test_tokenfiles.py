import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackfold.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    alphabet = "aeinot  \n\t 中é\U0001f600.,'s'll 12 　\x1c\x85"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    return [*made, "", " ", "  a", "a ", "a <|endoftext|> b", "x" * 5000, "word and\n\n  more " * 3000]


def test_units_do_not_change_the_ids():
    library, all_ = Tokenizer.from_file(PATH), texts()
    ids, at = tokenfiles.TextTokenizer(PATH).encode(all_)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in library.encode_batch(all_, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1607, 3, 0])
def test_files_hold_every_document_in_order(spark, tmp_path, n):
    library = Tokenizer.from_file(PATH)
    rows = [(k * 7 % 5003, t, "x") for k, t in enumerate(texts())] + [(None, "null key", "y"), (12, None, "z"), *[(999, "same", "w")] * 99]
    rows = rows[:n] if n < 100 else rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, frame string").repartition(5)
    files = tokenfiles.write_tokens(docs, PATH, f"file://{tmp_path}/out")
    got = tokenfiles.read_tokens(spark, files, ids=True).orderBy("start").collect()
    assert sorted(zip([r.doc_id for r in got], [list(r.ids) for r in got]), key=str) == sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows), key=str)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4")))
        start += len(r.ids)


def test_one_document_and_a_wrong_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(300)], "doc_id long, text string")
    files = tokenfiles.write_tokens(docs, PATH, f"file://{tmp_path}/out")
    row, ids = next(tokenfiles.read_shard(files.shards[-1][0], files.dictionary, at=0))
    assert ids[-1] == 2 and Tokenizer.from_file(PATH).decode(ids[:-1]) == f"text {row['doc_id']} " * 50
    assert files.dictionary
    with pytest.raises(ValueError, match="dictionary"):
        next(tokenfiles.read_shard(files.shards[0][0], b"other"))


def test_a_common_key_has_shards_of_its_own(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(100)] + [(50, "same text")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = tokenfiles.write_tokens(docs, PATH, f"file://{tmp_path}/out")
    assert max(n for _, n, _, _ in files.shards) < 300
    got = tokenfiles.read_tokens(spark, tokenfiles.open_files(f"file://{tmp_path}/out")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(k for k, _ in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_larger_tables_have_more_shards(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, "some text " * 10) for k in range(2000)], "doc_id long, text string")
    few = tokenfiles.write_tokens(docs, PATH, f"file://{tmp_path}/few")
    monkeypatch.setattr(tokenfiles, "SHARD_CHARS", 10_000)
    many = tokenfiles.write_tokens(docs, PATH, f"file://{tmp_path}/many")
    assert len(few.shards) == 4 and len(many.shards) == 20
    assert max(n for _, n, _, _ in many.shards) <= 130
    rows = [[tuple(r) for r in tokenfiles.read_tokens(spark, f).orderBy("start").collect()] for f in (few, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 2000


def test_long_texts_have_a_dictionary(spark):
    docs = spark.range(40).selectExpr("id doc_id", "concat(repeat(concat('word ', id, ' and more of it. '), 2000)) text")
    assert len(tokenfiles.train_dictionary(docs, PATH, "doc_id", "text")) > 1000
    assert tokenfiles.train_dictionary(docs.limit(1), PATH, "doc_id", "text")
    assert tokenfiles.train_dictionary(docs.limit(0), PATH, "doc_id", "text") == b""


def test_the_cache_is_bounded_by_characters(monkeypatch):
    from trackfold.llm import unitcache

    monkeypatch.setattr(unitcache, "CACHE_CHARS", 10_000)
    t = tokenfiles.TextTokenizer(PATH)
    for k in range(20):
        t.encode([f"<|endoftext|> text {k} " * 100])
        assert t.cache.chars < 20_000
