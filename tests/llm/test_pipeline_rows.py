"""The pipeline on tables of odd rows, and what it leaves in the shared folder."""

import os

import pytest

import corpus_pipeline
from gradeloom.llm.common import ship
from gradeloom.session import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, ids string, copy int"


def folders(spark):
    place = shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(place) if f.startswith("gradeloom-")}


def written(spark, tmp_path, rows):
    ship(spark)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


TEXT = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood {}"


def test_odd_rows_and_the_folder(spark, tmp_path):
    rows = [(i, TEXT.format(f"number {i} " * (i % 5 + 1)), "en", f"s{i % 3}", 9, "clash", "clash", 7) for i in range(40)]
    rows += [rows[3], (50, None, "en", "s0", 0, "", "", 0), (51, "", None, None, None, None, None, None), (None, TEXT, "en", None, 1, "", "", 1)]
    folder = written(spark, tmp_path, rows)
    before = folders(spark)
    result = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in result.collect()}
    assert ids and ids <= {*range(40), None} and 50 not in ids and 51 not in ids
    assert len(folders(spark) - before) == 1  # the result's own


def test_empty_table(spark, tmp_path):
    folder = written(spark, tmp_path, [])
    before = folders(spark)
    assert corpus_pipeline.run(spark, folder).collect() == []
    assert len(folders(spark) - before) == 1
