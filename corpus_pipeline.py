"""Corpus pipeline: language, near copies, personal data, source mix, packing.

Each stage takes all its predecessor kept. Stages but the last return the columns of
``documents``; the last returns packed pieces. The language that the first stage settles
on rules packing: a sequence holds documents of one language.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm import language, mixing, neardup, packing, pii
from chartlake.session import materialize, prepare_session

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Score from which the language found replaces a label that differs.
SURE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language (no text or no letter), correct wrong labels, fill in missing ones.

    A label gives way to another language found with a score of ``SURE`` or more; a label
    that the model did not learn stays, as its language can't be found. Without any label
    to learn from, missing labels stay missing.
    """
    prepare_session(spark)
    docs = docs.select(COLUMNS)
    known = docs.where(language.remainder(F.col("doc_id"), 4) != 2)
    model = language.fit(known.select("doc_id", "text", "lang"))
    kept = language.classify(docs, model).where(F.col("text").rlike(r"\p{L}"))
    found = F.nullif("lang_pred", F.lit(language.UNKNOWN))
    sure = F.col("lang").isin(model.languages if model else []) & (F.col("score") >= SURE)
    return kept.withColumn("lang", F.coalesce(F.when(sure, found), F.col("lang"), found)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near copies the text with the smallest id, once.

    Texts decide, not ids: different texts that share an id stay.
    """
    prepare_session(spark)
    return neardup.one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace confirmed personal data by its kind."""
    prepare_session(spark)
    clean = pii.redact(docs.select(COLUMNS))
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to their sources' targets, in training order; a repeated one is several rows."""
    prepare_session(spark)
    sized = docs.select(COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(sized).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences of one language each."""
    prepare_session(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs.select("doc_id", "text", "lang"), tokenizer, by="lang")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Language scores and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``, each one's result stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
