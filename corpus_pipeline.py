"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage works on every row that its predecessor kept. All but the last return
the columns of ``documents``; the last returns the pieces with their sequences.
No stage is expressible in SQL as a whole (learned scores, sketches, balanced
sampling), so ``ORACLE_SQL`` is None and the stages are tested against
brute-force versions. Null and empty texts pass the toxicity stage like any
clean text, become one document in exact dedup and have size 0 in the mix, which
does not take them; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockwise.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from blockwise.llm.common import fixed, table

#: Texts with at least this score are rejected.
TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC_SCORE)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = fixed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
