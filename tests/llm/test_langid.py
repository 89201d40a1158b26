import itertools

import numpy as np
import pyarrow as pa
import pytest

from trackfold.llm import langid

WORDS = {"aa": ["tion", "the", "ingly", "stand", "over"], "bb": ["über", "nicht", "schön", "keit", "ung"], "cc": ["ciónes", "que", "llama", "mente", "año"]}


def corpus(n=60, words=30):
    rng = np.random.default_rng(0)
    return [(lang, " ".join(a + b for a, b in zip(rng.choice(w, words), rng.choice(w, words), strict=True))) for _ in range(n) for lang, w in WORDS.items()]


@pytest.fixture(scope="module")
def model():
    return langid.train(corpus(), steps=60)


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y"], None, rng.normal(size=(2, 2)), rng.normal(size=2), None, None, None)
    scores = rng.normal(size=(9, 2))
    first = np.array([0, 6, 6, 9])
    got, _ = langid.marginals(scores, first, model)
    for a, b in ((0, 6), (6, 9)):
        want = np.zeros((b - a, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            s = model.start[path[0]] + sum(scores[a + k, y] for k, y in enumerate(path)) + sum(model.transition[i, j] for i, j in itertools.pairwise(path))
            for k, y in enumerate(path):
                want[k, y] += np.exp(s)
        np.testing.assert_allclose(got[a:b], want / want.sum(1, keepdims=True), rtol=1e-9)


def test_blocks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    model = langid.Model(list("xyz"), None, rng.normal(size=(3, 3)), rng.normal(size=3), None, None, None)
    scores, first = rng.normal(size=(1000, 3)), np.array([0, 1, 64, 64, 129, 400, 1000])
    whole = None
    for size in (2000, 64, 7):
        monkeypatch.setattr(langid, "BLOCK", size)
        got, _ = langid.marginals(scores, first, model)
        whole = got if whole is None else whole
        np.testing.assert_allclose(got, whole, rtol=1e-8)


def test_switched_text_is_labelled_word_by_word(model):
    rows = dict(corpus(1, 12))
    text = ". ".join(rows[k] for k in ("aa", "cc", "bb"))
    p, *_ = langid.label_texts(model, pa.array([text]))
    assert (p.argmax(1) == np.repeat([0, 2, 1], 12)).mean() > 0.9


def test_accuracy_on_unseen_texts(model):
    rng = np.random.default_rng(9)
    fresh = [(lang, " ".join(a + b for a, b in zip(rng.choice(w, 8), rng.choice(w, 8), strict=True))) for _ in range(30) for lang, w in WORDS.items()]
    labels, scores = langid._decide(model, pa.array([t for _, t in fresh]))
    assert np.mean([a == b for a, (b, _) in zip(labels, fresh, strict=True)]) > 0.95
    assert (scores >= 0).all() and (scores <= 1).all()


def test_dataframe_edge_cases(spark):
    rows = [(k, t, lang, "s", 1.0) for k, (lang, t) in enumerate(corpus(40))]
    rows += [(1000, None, "aa", "s", 0.0), (1001, "", None, "s", 0.0), (1002, "12 34 !!", "bb", None, 0.0), (None, "the stand over", None, "s", 0.0), (5, rows[5][1], rows[5][2], "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.language_report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by[None].held_out is False and by[None].lang_pred == "aa"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert langid.language_report(docs.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.language_report(unlabelled).collect()] == ["und"]


def test_stretches(spark, model):
    rows = dict(corpus(1, 10))
    docs = spark.createDataFrame([(1, rows["aa"] + " " + rows["bb"]), (2, None)], "doc_id long, text string")
    got = langid.word_languages(docs, model).orderBy("first_byte").collect()
    assert {r.doc_id for r in got} == {1} and sum(r.n_words for r in got) == 20
    assert got[0].lang == "aa" and got[-1].lang == "bb"


def features_of(text, model):
    data, at = langid.text_bytes(pa.array([text]))
    hashes, starts, ends, _ = langid.word_table(data, at, langid.PIECE)
    flat, _ = langid.word_features(data, starts, ends, hashes, model)
    return sorted(flat.tolist())


def test_every_byte_of_a_word_counts(model):
    assert features_of("abcdefghijklmnZZZZZZqrst", model) != features_of("abcdefghijklmnYYYYYYqrst", model)
    head, tail = "的一是不了人我在有他这中大来上个国和", "说们为子和你地出道也时年得就那要下以"
    assert features_of(head + "甲乙丙" + tail, model) != features_of(head + "丁戊己" + tail, model)


def test_pieces_of_long_words_are_whole():
    from trackfold.llm.words import word_table

    text = ("x" * 100 + " 说们为子和你地出道也时年得就那要下以" + "é" * 77 + " a") * 3
    data, at = langid.text_bytes(pa.array([text]))
    _, starts, ends, _ = word_table(data, at)
    _, s, e, _ = word_table(data, at, 32)
    assert (e - s).max() <= 32 and set(starts) <= set(s) and set(ends) <= set(e)
    assert b"".join(bytes(data[a:b]) for a, b in zip(s, e, strict=True)) == b"".join(bytes(data[a:b]) for a, b in zip(starts, ends, strict=True))
    assert all(bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True))


def test_hashes_do_not_depend_on_parts(monkeypatch):
    from trackfold.llm import words

    data, at = langid.text_bytes(pa.array(["ab cde f " * 50 + "z" * 500 + " q", "z" * 500]))
    want = words.word_table(data, at)[0]
    monkeypatch.setattr(words, "_PART", 64)
    monkeypatch.setattr(words, "_powers", [])
    got = words.word_table(data, at)[0]
    assert (got == want).all() and got[-1] == got[-3]


def test_texts_without_spaces_are_judged_whole():
    rng = np.random.default_rng(3)
    sets = {"ja": "のにはをたがでてとしれさあいるもすま", "zh": "的一是不了人我在有他这中大来上个国"}
    rows = [(k, "".join(rng.choice(list(v), 60))) for _ in range(40) for k, v in sets.items()]
    m = langid.train(rows, steps=60)
    shared = "漢字仮名交文" * 3
    labels, _ = langid._decide(m, pa.array([shared + "".join(rng.choice(list(sets[k]), 300)) for k in ("zh", "ja")]))
    assert labels == ["zh", "ja"]
    mixed = "".join(rng.choice(list(sets["ja"]), 100)) + "".join(rng.choice(list(sets["zh"]), 100))
    p, *_ = langid.label_texts(m, pa.array([mixed]))
    assert p.argmax(1)[0] == 0 and p.argmax(1)[-1] == 1


def test_any_number_of_languages():
    rows = [(f"l{k:03d}", " ".join([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q"] * 20)) for k in range(70)]
    m = langid.train(rows, steps=30)
    assert len(m.languages) == 70 and set(m.lexicon_language.tolist()) == set(range(70))


def test_sample_is_bounded_and_counts_equal_rows_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 20)
    rows = [(k, f"text {k}", "en" if k % 3 else "fr") for k in range(900)] + [(7, "text 7", "en")] * 3000 + [(1, None, "en"), (2, "x", None), (None, "y", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs).collect()
    count = {lang: sum(r.lang == lang for r in got) for lang in ("en", "fr", "de")}
    assert count == {"en": 20, "fr": 20, "de": 1} and len({(r.lang, r.text) for r in got}) == 41
    every = {(lang, t) for _, t, lang in rows if t and lang == "fr"}
    assert len(every) == 300 and langid.training_rows(docs.limit(0)).count() == 0


def test_very_long_text_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.where("lang = 'de' AND length(text) > 2000").limit(1).selectExpr("-1L", "repeat(text, 300)", "lang", "source", "n_chars"))
    got = {r.doc_id: r for r in langid.language_report(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r.held_out and truth[k] is not None and r.lang_pred != "und"]
    assert len(held) > 100 and sum(got[k].lang_pred == truth[k] for k in held) >= 0.98 * len(held)
    assert got[-1].lang_pred == "de"
