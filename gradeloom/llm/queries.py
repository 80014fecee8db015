"""The text operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, context_mixing, exact_dedup, filter_audit, html_text, jaccard_join, language_id, line_dedup, mixing, oracles,
    phrase_mining, suffix_dedup, topk_search, url_filter,
)
from .common import remainder, ship, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents", "doc_id", "text"), whole_runs=True)


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    model = language_id.train(language_id.training_rows(docs))
    rows = docs.select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    return language_id.identify(rows, model).drop("text")


def op3_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_documents(table(spark, sf, "documents", "doc_id", "text"))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf, "documents", "doc_id", "text"))


def op5_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf, "documents", "doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents", "doc_id", "text"))


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf, "embeddings", "vec_id", "embedding"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents", "doc_id", "text"), TOKENIZER)


def op9_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_text(table(spark, sf, "pages", "page_id", "url", "html"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars"))


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_mining.mine(table(spark, sf, "documents", "text", "lang"))


def op12_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages", "page_id", "url"))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf, "labels", "doc_id", "quality", "toxic"))


QUERIES = (
    op1_line_dedup, op2_language_id, op3_jaccard_join, op4_exact_dedup, op5_lm_scoring, op6_suffix_dedup, op7_topk,
    op8_bpe, op9_html_text, op10_mixing, op11_phrases, op12_url_filter, op13_filter_audit,
)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return query(spark, sf)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.statements()
