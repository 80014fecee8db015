"""A student's grades next to the class and major means.

The benchmark means are defined over the rows of two self-joins of the
enrolments, on (course, class) and on (course, major). Those joins multiply
rows quadratically. The same means follow from counts and sums: joining an
enrolment to the ``n`` rows of its major repeats each class row ``n`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.grades import scale_a
from ..functions.predicates import contains, matches
from ..functions.text import short_subject
from ..session import materialise

_CELL = ["course_name", "class_id", "major"]


def _cells(scored: DataFrame) -> DataFrame:
    """Benchmark weights per (course, class, major).

    One aggregate over the enrolments. The class and the major totals are
    windows over its result, which has one row per cell.
    """
    cell = scored.groupBy(*_CELL).agg(
        F.sum("score").alias("s"), F.count("score").alias("c"), F.count(F.lit(1)).alias("n")
    )

    def total(part: str, key: str) -> Column:
        known = F.col("course_name").isNotNull() & F.col(key).isNotNull()
        return F.when(known, F.sum(part).over(Window.partitionBy("course_name", key))).cast("double")

    def weighted(part: str, key: str, other: str) -> Column:
        rows = F.coalesce(total("n", other), F.lit(1.0))
        return F.coalesce(total(part, key), F.lit(0.0)) * rows

    return cell.select(
        *_CELL,
        weighted("s", "class_id", "major").alias("class_sum"),
        weighted("c", "class_id", "major").alias("class_rows"),
        weighted("s", "major", "class_id").alias("major_sum"),
        weighted("c", "major", "class_id").alias("major_rows"),
    )


def home_scores(
    enrollment: DataFrame,
    semester: str = "%",
    academic_year: str = "%",
    student: str = "%",
    by: Sequence[str] = ("student_id",),
) -> DataFrame:
    """Personal grade, class mean and major mean per (course, grade text).

    ``by=()`` pools the students that match, as one request does; the default
    answers for each of them. The filters choose the personal rows only, the
    means are over all terms and students.
    """
    scored = enrollment.withColumn("score", scale_a(F.col("grade_text")))
    keys = [*by, "course_name", "grade_text"]
    chosen = scored.where(
        contains(F.col("semester"), semester)
        & contains(F.col("academic_year"), academic_year)
        & matches(F.col("student_id"), student)
    )
    own = chosen.select(*keys, *(c for c in _CELL if c not in keys))
    if student != "%":
        # Only the means of these students' courses are needed.
        courses = chosen.select(F.col("course_name").alias("_course")).distinct()
        scored = scored.join(courses, F.col("course_name").eqNullSafe(F.col("_course")), "left_semi")
    cells = materialise(_cells(scored))
    same = F.lit(True)
    for c in _CELL:
        same = same & own[c].eqNullSafe(cells[c])
    joined = own.join(cells, same).select(*(own[c] for c in keys), *cells.columns[len(_CELL):])

    def mean(part: str) -> Column:
        return F.try_divide(F.sum(f"{part}_sum"), F.sum(f"{part}_rows")).alias(f"{part}_mean")

    means = joined.groupBy(*keys).agg(mean("class"), mean("major"))
    return means.select(*keys, scale_a(F.col("grade_text")).alias("personal"), "class_mean", "major_mean")


def home_line(home: DataFrame) -> DataFrame:
    """Line rows: one per graded subject; a mean of zero reads as missing."""
    graded = home.where(F.col("personal").isNotNull())
    return graded.withColumns(
        {
            "subject": short_subject(F.col("course_name")),
            "class_mean": F.nullif(F.col("class_mean"), F.lit(0.0)),
            "major_mean": F.nullif(F.col("major_mean"), F.lit(0.0)),
        }
    )


def home_radar(home: DataFrame) -> DataFrame:
    """Radar rows: the personal and the class series, without missing scores."""
    ids = [c for c in home.columns if c not in ("personal", "class_mean", "major_mean")]
    series = F.when(F.col("_series") == "personal", "个人").otherwise("班级平均")
    return (
        home.unpivot(ids, ["personal", "class_mean"], "_series", "score")
        .where(F.col("score").isNotNull())
        .select(*ids, short_subject(F.col("course_name")).alias("subject"), series.alias("type"), "score")
    )


def subject_scores(home: DataFrame) -> DataFrame:
    """One row per student and subject with both series.

    A subject with several grade texts keeps the last by grade text, as later
    rows replace earlier ones.
    """
    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("grade_text")))

    return home.groupBy("student_id", "course_name").agg(
        last("personal").alias("personal"), last("class_mean").alias("class_mean")
    )


def weak_subjects(home: DataFrame) -> DataFrame:
    """Subjects in which the student is below the class mean."""
    return subject_scores(home).where(F.col("personal") < F.col("class_mean"))


def student_report(home: DataFrame) -> DataFrame:
    """Text of a student's grades, class means and weak subjects.

    At most one entry per course, so the lists stay as short as the plan.
    """
    subjects = subject_scores(home)
    weak = F.col("personal") < F.col("class_mean")

    def lines(score: str) -> Column:
        entry = F.format_string("%s %.1f", F.col("course_name"), F.col(score))
        return _joined(F.when(F.col(score).isNotNull(), entry))

    parts = subjects.groupBy("student_id").agg(
        lines("personal").alias("own"),
        lines("class_mean").alias("others"),
        _joined(F.when(weak, F.col("course_name"))).alias("weak"),
        F.count_if(weak).alias("n_weak"),
    )
    text = F.concat(
        F.lit("student "), F.col("student_id"),
        F.lit("\ngrades: "), F.col("own"),
        F.lit("\nclass means: "), F.col("others"),
        F.lit("\nbelow the class mean: "), F.when(F.col("weak") == "", "none").otherwise(F.col("weak")),
    )
    return parts.select("student_id", "n_weak", text.alias("report"))


def _joined(entry: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(entry)), ", ")
