"""Grade distributions of classes (the data behind the violin plots)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.grades import violin_score
from ..functions.predicates import contains, exam_nature


def select_enrollments(
    enrollment: DataFrame,
    cohort: str = "%",
    course: str = "%",
    major: str = "%",
    semester: str = "%",
    academic_year: str = "%",
    nature: str = "%",
) -> DataFrame:
    """Enrolments whose columns contain the given texts, of one exam nature."""
    return enrollment.where(
        contains(F.col("cohort"), cohort)
        & contains(F.col("course_name"), course)
        & contains(F.col("major"), major)
        & contains(F.col("semester"), semester)
        & contains(F.col("academic_year"), academic_year)
        & exam_nature(F.col("exam_nature"), nature)
    )


def violin_rows(enrollment: DataFrame, exam_course: str = "0", **filters: str) -> DataFrame:
    """Course, class and score per enrolment; texts without a score are dropped."""
    rows = select_enrollments(enrollment, **filters)
    score = violin_score(F.col("grade_text"), exam_course)
    return rows.select(
        F.col("course_name").alias("courseName"), F.col("class_id").alias("x"), score.alias("y")
    ).where(F.col("y").isNotNull())


def five_numbers(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, quartiles and range per group.

    Equal values are counted first, so a quantile's state holds the distinct
    values of a group and not its rows.
    """
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    quartiles = {f"q{p}": F.percentile(value, p / 100, F.col("_n")) for p in (25, 50, 75)}
    return counted.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(value).alias("min"),
        *(q.alias(name) for name, q in quartiles.items()),
        F.max(value).alias("max"),
    )
