"""Queries of the text operators by name: their contracts, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import (
    bpe,
    chat,
    langid,
    lattice,
    mixture,
    pages,
    quality,
    russians,
    simhash,
    tokens,
    topk,
    urls,
    whitening,
)
from wayfare.session import scan_bytes, size_shuffles

WORD_VOCABULARY = "word_bpe_49k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(spark: SparkSession, *tables: DataFrame) -> None:
    """Make shuffles as wide as what the tables hold needs; the next query sizes its own."""
    size_shuffles(spark, sum(map(scan_bytes, tables)))


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        sized(spark, rows)
        return operator(rows)

    return query


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, from the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """How the rank files' vocabularies split text."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _with_ranks(name: str, operator: Callable[[DataFrame, str, str], DataFrame]) -> Query:
    return _over(name, lambda df: operator(df, vocabulary(RANK_FILE), pattern()))


def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    sized(spark, pages_, labels)
    return urls.judge(pages_, labels)


def queries() -> dict[str, Query]:
    import corpus_pipeline  # which calls the operators by this module

    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": _with_ranks("documents", tokens.line_counts),
        "op2_url_filter": _url_filter,
        "op3_html_text": _over("pages", pages.extract),
        "op4_simhash_groups": _over("documents", simhash.groups),
        "op5_quality_rules": _over("documents", quality.quality),
        "op6_bpe_round_trip": _over(
            "documents", lambda docs: bpe.round_trip(docs, vocabulary(WORD_VOCABULARY))
        ),
        "op7_exact_top_k": _over("embeddings", topk.search),
        "op8_source_mix": _over("documents", mixture.mix),
        "op9_language_id": _over("documents", langid.identify),
        "op10_chat_format": _with_ranks("conversations", chat.digests),
        "op11_hard_negatives": _over("embeddings", russians.negatives),
        "op12_whitening": _over("embeddings", whitening.whiten),
        "op13_lattice_score": _over(
            "documents", lambda docs: lattice.score(docs, vocabulary(PIECE_MODEL))
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": urls.JUDGE_SQL,
        "op5_quality_rules": quality.QUALITY_SQL,
        "op7_exact_top_k": topk.SEARCH_SQL,
        "op8_source_mix": mixture.MIX_SQL,
        "op10_chat_format": chat.DIGEST_SQL,
        "op11_hard_negatives": russians.MINE_SQL,
    }
