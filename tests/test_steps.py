"""Written steps are removed with the scope that owns them."""

import os

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import cohort
from gradeloom.plans import reports
from gradeloom.session import materialise, shared_folder, steps, written_once


def folders(spark):
    place = shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(place) if f.startswith("gradeloom-")}


def test_a_scope_removes_what_was_written_inside(spark):
    before = folders(spark)
    outside = materialise(spark.range(5))
    mine = folders(spark) - before
    with steps(spark):
        one = materialise(spark.range(3))
        with steps(spark):
            assert materialise(one.union(one)).count() == 6
            assert len(folders(spark) - before) == 3
        assert one.count() == 3 and len(folders(spark) - before) == 2
    assert folders(spark) - before == mine and outside.count() == 5


def test_an_error_removes_the_steps_too(spark):
    before = folders(spark)
    with pytest.raises(Exception, match="broken"):
        with steps(spark):
            materialise(spark.range(3))
            materialise(spark.range(1).select(F.raise_error(F.lit("broken"))))
    assert folders(spark) == before


def test_a_frame_written_once_outlives_its_steps(spark):
    before = folders(spark)
    kept = written_once(spark, lambda: materialise(spark.range(4)).union(materialise(spark.range(2))))
    assert kept.count() == 6 and len(folders(spark) - before) == 1


def test_the_folder_is_as_before_after_a_report(spark, tmp_path):
    rows = [(f"s{i}", "甲乙", "m", "2021", 2.0 * i, 1.0) for i in range(30)]
    enrollment = spark.createDataFrame(
        rows, "student_id string, name string, major string, cohort string, credit_point double, credit double"
    )
    before = folders(spark)
    reports.write_report(spark, lambda: reports.gpa_ranking(enrollment, major="m"), str(tmp_path / "one"))
    assert folders(spark) == before
    assert spark.read.parquet(str(tmp_path / "one")).agg(F.max("position")).first()[0] == 30
    two = lambda: {"all": cohort.cohort_gpa_rank(enrollment), "few": cohort.cohort_gpa_rank(enrollment.limit(4))}
    reports.write_report(spark, two, str(tmp_path / "two"))
    assert folders(spark) == before
    assert [spark.read.parquet(str(tmp_path / "two" / n)).count() for n in ("all", "few")] == [30, 4]
