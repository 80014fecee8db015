"""Student listings, head counts and the cohort GPA ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import mask_name
from .ordering import number_rows


def first_row(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row per key by ``order``: an aggregate, so it combines before the shuffle."""
    picked = F.min(F.struct(*order, *(c for c in keep if c not in order)))
    return df.groupBy(*key).agg(picked.alias("_row")).select(
        *key, *(F.col(f"_row.{c}").alias(c) for c in keep)
    )


def listing(course: DataFrame) -> DataFrame:
    """Every course: code and name."""
    return course.select("course_code", "course_name")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with the key; raises when there is none."""
    rows = df.where(F.col(column) == value)
    if rows.isEmpty():
        raise LookupError(f"no row with {column} = {value!r}")
    return rows


def students_by_major(enrollment: DataFrame, order: Sequence[str], major: str | None = None) -> DataFrame:
    """One row per student of a major, taken from the first enrolment in it."""
    rows = enrollment if major is None else enrollment.where(F.col("major") == major)
    return first_row(rows, ["major", "student_id"], order, ["class_id", "name", "course_name"])


def gender_distribution(student: DataFrame) -> DataFrame:
    """Students per gender; students without one are a group of their own."""
    return student.groupBy("gender").agg(F.count("student_id").alias("n_students"))


def exact_sum(column: str) -> Column:
    """Sum as decimals. A sum of doubles depends on the order of the rows, and
    its last bits would decide half-way roundings and with them positions."""
    return F.sum(F.col(column).cast("decimal(18,6)")).cast("decimal(20,6)")


def weighted_gpa() -> Column:
    """Credit-weighted GPA, NULL when the credits sum to zero."""
    return F.round(F.try_divide(exact_sum("credit_point"), exact_sum("credit")), 2).cast("double")


def student_gpa(enrollment: DataFrame) -> DataFrame:
    keys = ["cohort", "major", "student_id", "name"]
    return enrollment.where(F.col("cohort").isNotNull() & F.col("major").isNotNull()).groupBy(
        *keys
    ).agg(weighted_gpa().alias("gpa"))


def cohort_gpa_rank(enrollment: DataFrame) -> DataFrame:
    """Position of every student in the cohort and major by descending GPA.

    Ties get different positions, by student id; a missing GPA comes last.
    """
    order = [F.col("gpa").desc_nulls_last(), F.col("student_id"), F.col("name")]
    ranked = number_rows(student_gpa(enrollment), ["cohort", "major"], order, "position")
    return ranked.withColumn("name", mask_name(F.col("name")))
