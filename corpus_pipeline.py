"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``.  SQL cannot express the field, the signatures, the
ciphers and the merges of the stages, so ORACLE_SQL is None; ``tests/llm/test_pipeline.py`` holds the result against a
plain restatement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm import contamination, langid, nearcopies, pieces, surrogates
from trackfold.llm.common import bounded_batches, read_table, saved, unused
from trackfold.llm.queries import pii_key, tokenizer_file


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language (null texts and texts without a letter); a null lang becomes the predicted one.

    Scores reject nothing.  If no row has text and lang there is no model: the same documents go, and lang stays null.
    """
    bounded_batches(spark)
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label, score = unused(docs, "__lang"), unused(docs, "__score")
    found = langid.with_language(docs, model, label=label, score=score)
    kept = found.where(F.col(label) != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", label)).select(*_own(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    bounded_batches(spark)
    return nearcopies.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold benchmark passages."""
    bounded_batches(spark)
    return contamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the text."""
    bounded_batches(spark)
    changed = surrogates.pseudonymised(docs, pii_key(spark), kinds=unused(docs, "__kinds"), count=unused(docs, "__count"))
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_own(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, their digest, and the digest of the text that they decode to."""
    bounded_batches(spark)
    return pieces.piece_digests(docs, tokenizer_file("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; further columns of it are carried along."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
