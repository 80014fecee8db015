"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Only built-in column functions run here. Every text is read once, in the scan,
where it becomes a narrow row of length, hash of its first bytes and SHA-256;
the texts themselves are never shuffled. Hashing a text where it is read costs
less than moving it, so the digest, which the result reports for every row, is
made there too; the refinement decides which rows still take part in a grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import whole_text

PREFIX_CHARS = 256
#: A hot length or prefix is looked up over so many keys.
SALTS = 32


def fingerprints(docs: DataFrame, prefix: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, length in bytes, hash of the first ``prefix`` characters, digest of the whole text."""
    text = whole_text()
    return docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("prefix_hash"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Groups of two or more equal texts among ``fingerprints`` rows.

    Each step groups only the rows whose group had company in the step before.
    The counts combine before the shuffle, so a group of any size is one row
    for each task that meets it. keep_id is the largest doc_id (null ids only
    where the group has no other), group_size counts rows.
    """

    def shared(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")

    def in_company(df: DataFrame, *keys: str) -> DataFrame:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return df.join(shared(df, *keys).withColumn("_salt", salts), [*keys, "_salt"], "left_semi")

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same_length = in_company(salted, "n_bytes")
    same_prefix = in_company(same_length, "n_bytes", "prefix_hash")
    return (
        same_prefix.groupBy("n_bytes", "prefix_hash", "text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )


def mark_copies(docs: DataFrame) -> DataFrame:
    """One row per document with the document that stays for its text.

    Null texts count as empty and equal to each other. Of equal texts the
    largest doc_id stays; rows equal in id and text are one document stored
    twice and are marked alike. A null doc_id loses to any other id. An empty
    table gives no rows; further columns of ``docs`` are not read.
    """
    rows = materialise(fingerprints(docs))
    groups = duplicate_groups(rows).select("text_sha256", "keep_id", "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
