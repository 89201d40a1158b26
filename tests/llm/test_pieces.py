import random

import public_tokenizers
import pytest
import sentencepiece

from trackfold.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    alphabet = "aeinot ▁ab\n\n  中é\U0001f600.,'\x00<0x41></s>thing  lly"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*made, "", " ", "   ", "a" * 3000, "ab" * 2000, " " * 50, "▁", "▁▁a", "a ▁ b", "word " * 20000]


def test_ids_and_texts_equal_the_library(library):
    model, all_ = pieces.PieceModel(PATH), texts()
    ids, at = model.encode(all_)
    want = library.encode(all_, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert model.decode(ids, at) == [library.decode(w) for w in want]


def test_runs_of_spaces_and_indented_code_equal_the_library(library):
    runs = [c * n for c in (" ", "\t", "\n") for n in range(1, 201)]
    all_ = [t for r in runs for t in (r, "a" + r + "b", "def f():\n" + r + "return 1", r + "\t " + r)]
    rng = random.Random(9)
    all_ += ["".join(rng.choice(["  ", "    ", " ", "\t", "\n", "x", "return", "=", "--", "aaaa", "▁"]) for _ in range(40)) for _ in range(2000)]
    all_ += [" " * 200_000 + "x", "-" * 5000, "=" * 4097, "  x" * 30_000]
    model = pieces.PieceModel(PATH)
    ids, at = model.encode(all_)
    want = library.encode(all_, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_single_merges_agree_with_rounds():
    model = pieces.PieceModel(PATH)
    units = [t.replace(" ", "▁") for t in texts() if 0 < len(t) < 5000]
    a, b = model.merge(units), model.merge(units, single=True)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_stray_bytes_decode_as_in_the_library(library):
    import numpy as np

    model, rng = pieces.PieceModel(PATH), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(3, 300) for _ in range(10)]
        assert model.decode(np.array(ids), np.array([0, 10])) == [library.decode(ids)]


def test_dataframe_keeps_rows_and_columns(spark, library):
    rows = [(1, None, 5), (2, "", 6), (2, "Hello world", 7), (None, "Hello  world", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids long")
    out = pieces.encode_decode(docs, PATH)
    got = sorted(((r.doc_id, r.text, r.piece_ids, r.piece_text) for r in out.collect()), key=str)
    want = sorted(((i, t, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows), key=str)
    assert got == want
    assert pieces.piece_digests(docs.limit(0), PATH).count() == 0
