"""Corpus preparation: the documents through STAGES, each written as Parquet and read again.

Language identification, line deduplication, near-duplicate removal, mixing of
the sources, and encoding. Every stage works on all that the one before kept,
and all but the last return the columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from gradeloom.llm.common import ship
from gradeloom.llm.queries import TOKENIZER
from gradeloom.session import new_folder, remove, written_once

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text stays if this part of its trigrams, false positives taken off, belongs to one learned language.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned from the labelled ones."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.train(language_id.training_rows(docs)), LEAST_SCORE)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; a document of nothing else goes."""
    ship(spark)
    cut = line_dedup.dedup_lines(docs, removed="line_dedup_removed", whole_runs=True)
    emptied = (F.col("line_dedup_removed") > 0) & ~F.col("text").rlike(r"\S")
    return cut.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    ship(spark)
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources come near their target weights, in random order."""
    ship(spark)
    return mixing.mix(docs, copy_column=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, digests and token ids of every document."""
    ship(spark)
    return bpe.round_trip(docs, TOKENIZER, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("jaccard_join", join_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models, transitive links and byte-pair merges have no SQL form; the tests chain the brute-force forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the last one's rows are read from where they were written.

    What a stage writes on its way is removed when its rows are written, and
    these when the next stage's are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        path = new_folder(spark)
        docs = written_once(spark, lambda: stage(spark, docs, sf_dir), path)
        remove(spark, before)
        before = [path]
    return docs
