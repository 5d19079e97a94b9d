"""The document pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs; all but
the last return the columns of ``documents``. The stages run in the same Python workers one after another, so that their
memos are smaller here than on their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_dedup, language, near_dedup, packing, pii
from eventloom.llm.common import read
from eventloom.shared import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters are mostly of one learned language."""
    return language.keep_known(docs, memo_scores=1_000_000)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return near_dedup.drop_near(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=120_000)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Viterbi labels, sketches and the packing plan have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}", wide=True)
    return docs
