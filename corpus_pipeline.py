"""The text operators in a row: from raw documents to encoded training text.

Each stage takes the documents that the one before has kept, as a written table, and all
but the last return the columns of documents. No SQL states the whole run, since the
fingerprints and tokens are not SQL; ``tests/llm`` runs it against plain loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import bpe, catalogue, langid, mixture, quality, simhash
from wayfare.llm.scratch import keep_last, mark, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs, catalogue.vocabulary(catalogue.WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalogue.table(spark, sf_dir, "documents")
    catalogue.sized(spark, docs)
    since = mark(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        keep_last(spark, since)  # each stage's input and working tables go when it is done
    return STAGES[-1][1](spark, docs, sf_dir)
