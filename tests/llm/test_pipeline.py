import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_nearcopies import classes
from trackfold.llm import surrogates


def test_pipeline_equals_a_plain_restatement(spark, tmp_path):
    rows = []
    for k in range(60):
        body = " ".join(f"word{chr(97 + (k * 7 + i) % 23)}x{chr(97 + i % 19)}" for i in range(k, k + 40))
        rows.append((k, body, "en" if k % 3 else None, "s", len(body)))
    bench = " ".join(f"bench{i}" for i in range(20))
    mail = "write to ab.12@mail3.example.com or +1 (743) 555-3824 "
    rows += [(100, rows[5][1] + " more", "en", "s", 1), (101, rows[9][1] + " " + bench, "en", "s", 1), (102, mail + rows[3][1].upper() * 2 + " z", "en", "s", 1), (103, None, "en", "s", 0), (104, "123 456", "en", "s", 7), (105, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    cls = classes(docs)
    docs = [d for i, d in enumerate(docs) if cls[i] == d[0]]
    bad = {r[0] for r in contaminated(docs, [(1, bench)]) if r[5]}
    assert 101 in bad
    spark.conf.set("trackfold.pii.key", "key for trials")
    table, library = surrogates.Surrogates(b"key for trials"), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for doc, text in docs:
        if doc not in bad:
            text = table.replace(text)[0]
            ids = library.encode(text)
            want[doc] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.piece_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_unlabelled_documents_and_further_columns_are_kept(spark):
    rows = [(1, "some text", None, "s", 9, "a", 1), (2, "12", None, "s", 2, "b", 2), (3, None, None, "s", 0, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __lang string, __h int")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    labelled = docs.union(docs.selectExpr("doc_id + 10", "concat(text, 'x')", "'en'", "source", "n_chars", "__lang", "__h"))
    kept = corpus_pipeline.language(spark, labelled, "")
    assert kept.columns == docs.columns and {r.doc_id: r["__lang"] for r in kept.collect()} == {1: "a", 11: "a", 12: "b"}
    for stage in (corpus_pipeline.near_copies, corpus_pipeline.personal_data):
        out = stage(spark, docs, "")
        assert out.schema.simpleString() == docs.schema.simpleString() and sorted(r["__h"] for r in out.collect()) == [1, 2, 3]


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 0
