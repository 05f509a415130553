"""Quality rules, language ID, near-dedup, source mixing and packing over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor returned.  The first four return the
columns of ``docs``; the last returns the pieces of the packed sequences.  Nulls, empty tables, repeated rows and extra
columns are treated as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from conflux.llm import langid, minhash, mixing, packing, quality
from conflux.llm.tables import dropped, stored, table
from pyspark.sql import DataFrame, SparkSession

#: Between the scores of held-out clean text and those of text in no learned language; measured figures are in README.
LEAST_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: A fitted classifier, a trained sequence model and a tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
