"""A training-data pipeline of five operators over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the
last return the columns of ``docs``.

* language_id: documents without a letter, or in no learned language, go.
* exact_dedup: of equal texts the one with the largest ``doc_id`` stays.
* jaccard_join: of documents that links of five-word shingles (80 %) reach,
  the one with the least ``doc_id`` stays.
* suffix_dedup: passages of 256 bytes or more that occur twice are cut out,
  so those of over 50 words; documents of which nothing is left go.
* packing: what is left is tokenised and packed into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorus.llm import exact_dedup as _exact
from chorus.llm import jaccard_join as _jaccard
from chorus.llm import language_id as _language
from chorus.llm import packing as _packing
from chorus.llm import suffix_dedup as _suffix
from chorus.llm.common import table
from chorus.plans.stage import stage

SHINGLE, NUM, DEN = 5, 80, 100
PASSAGE_BYTES = 256             # a passage of over 50 words is longer, in any of the learned languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _language.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _exact.keep_one(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _jaccard.keep_one(docs, shingle=SHINGLE, num=NUM, den=DEN)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _suffix.cut_repeats(docs, min_len=PASSAGE_BYTES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

# Trained models, similarity groups and tokenisers are beyond SQL; tests hold
# the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
