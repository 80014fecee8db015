"""Value added: progress of classes and students against an expectation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.grades import scale_a
from ..session import materialise
from .cohort import exact_sum
from .distribution import select_enrollments
from .ordering import sequence_slope

# Boosting rounds and learning rate of the expectation model.
ROUNDS, LEARNING_RATE = 100, 0.1


def class_value_added(enrollment: DataFrame, order: Sequence[str], **filters: str) -> DataFrame:
    """Slope of the grades of a class over its enrolments in term order."""
    rows = select_enrollments(enrollment, **filters)
    scored = rows.withColumn("score", scale_a(F.col("grade_text")))
    slopes = sequence_slope(scored, ["class_id"], [F.col(c) for c in order], "score", ["course_name"])
    return slopes.select(
        F.col("course_name").alias("courseName"), F.col("class_id").alias("x"), F.col("slope").alias("y")
    )


def student_value_added(enrollment: DataFrame, order: Sequence[str]) -> DataFrame:
    """Slope of the grades of a student over the enrolments in term order."""
    scored = enrollment.withColumn("score", scale_a(F.col("grade_text")))
    slopes = sequence_slope(scored, ["student_id"], [F.col(c) for c in order], "score")
    return slopes.select("student_id", F.col("slope").alias("value_added"))


def semester_gpa_residuals(enrollment: DataFrame, student: DataFrame) -> DataFrame:
    """Semester GPA of a student, the class and the major, less their trends.

    Each series is fitted on the student's own semesters, numbered from 0. All
    windows run over semester totals, so a group has one row per semester.
    """
    term = ["academic_year", "semester"]
    profile = student.select("student_id", "class_id", "major")
    sums = [exact_sum("credit_point").alias("points"), exact_sum("credit").alias("credits")]
    # Read three times below, and far smaller than the enrolments.
    own = materialise(enrollment.groupBy("student_id", *term).agg(*sums).join(profile, "student_id"))

    def group_gpa(key: str, name: str) -> DataFrame:
        totals = own.where(F.col(key).isNotNull()).groupBy(*term, key)
        return totals.agg(F.try_divide(exact_sum("points"), exact_sum("credits")).cast("double").alias(name))

    joined = own.join(group_gpa("class_id", "class_gpa"), [*term, "class_id"], "left").join(
        group_gpa("major", "major_gpa"), [*term, "major"], "left"
    )
    series = joined.select(
        "student_id",
        *term,
        F.try_divide("points", "credits").cast("double").alias("gpa"),
        F.coalesce("class_gpa", F.lit(0.0)).alias("class_gpa"),
        F.coalesce("major_gpa", F.lit(0.0)).alias("major_gpa"),
    )
    ordered = Window.partitionBy("student_id").orderBy(*term)
    numbered = series.withColumn("i", (F.row_number().over(ordered) - 1).cast("double"))
    whole = Window.partitionBy("student_id")
    return numbered.select(
        "student_id",
        *term,
        "gpa",
        *(_residual(c, "i", whole).alias(f"{c}_residual") for c in ("gpa", "class_gpa", "major_gpa")),
    )


def _residual(y: str, x: str, window) -> Column:
    """``y`` less its least-squares line; a single point has no residual."""
    slope = F.coalesce(F.regr_slope(y, x).over(window), F.lit(0.0))
    centre = F.avg(y).over(window)
    return F.col(y) - centre - slope * (F.col(x) - F.avg(x).over(window))


def _wide_means(enrollment: DataFrame, courses: Sequence[str]) -> DataFrame:
    """One row per student with a mean grade per course, in columns 0, 1, ...

    Everything below works within a row, so the students are shuffled once.
    """
    rows = enrollment.where(F.col("course_name").isin(list(courses)))
    scored = rows.select("student_id", "course_name", scale_a(F.col("grade_text")).alias("score"))
    means = [F.avg(F.when(F.col("course_name") == c, F.col("score"))) for c in courses]
    return scored.groupBy("student_id").agg(*(m.alias(str(i)) for i, m in enumerate(means)))


def _per_course(wide: DataFrame, courses: Sequence[str], **fields: Sequence[Column]) -> DataFrame:
    """Rows (student, course, fields) from the columns of the wide frame."""
    entries = [
        F.struct(F.lit(c).alias("course_name"), *(cols[i].alias(name) for name, cols in fields.items()))
        for i, c in enumerate(courses)
    ]
    return wide.select("student_id", F.inline(F.array(*entries)))


def course_means(enrollment: DataFrame, courses: Sequence[str]) -> DataFrame:
    """Mean grade per student and course over the named courses."""
    wide = _wide_means(enrollment, courses)
    actual = [F.col(str(i)) for i in range(len(courses))]
    return _per_course(wide, courses, actual=actual).where(F.col("actual").isNotNull())


def _took_all(courses: Sequence[str]) -> Column:
    test = F.lit(True)
    for i in range(len(courses)):
        test = test & F.col(str(i)).isNotNull()
    return test


def expected_gain(enrollment: DataFrame, courses: Sequence[str]) -> DataFrame:
    """Actual less expected grade, for students who took all the courses.

    The expectation is boosted trees on the course alone. Every tree isolates
    each course, so after ``ROUNDS`` rounds the prediction has moved from the
    global mean towards the course mean by ``1 - (1 - rate) ** rounds``. The
    means are over all students, including those who miss a course.
    """
    wide = _wide_means(enrollment, courses)
    actual = [F.col(str(i)) for i in range(len(courses))]
    sums = wide.agg(
        *(F.sum(c).alias(f"s{i}") for i, c in enumerate(actual)),
        *(F.count(c).alias(f"n{i}") for i, c in enumerate(actual)),
    )
    total = sum(sums[f"s{i}"] for i in range(len(courses))) / sum(sums[f"n{i}"] for i in range(len(courses)))
    reached = 1 - (1 - LEARNING_RATE) ** ROUNDS
    course = [F.try_divide(sums[f"s{i}"], sums[f"n{i}"]) for i in range(len(courses))]
    model = sums.select(F.struct(*((total + reached * (m - total)).alias(f"c{i}") for i, m in enumerate(course))))
    expectation = model.scalar()
    expected = [expectation.getField(f"c{i}") for i in range(len(courses))]
    gain = [a - e for a, e in zip(actual, expected)]
    return _per_course(wide.where(_took_all(courses)), courses, actual=actual, expected=expected, gain=gain)


def line_residuals(enrollment: DataFrame, courses: Sequence[str]) -> DataFrame:
    """Grades of a student less the line over the courses in name order.

    The course codes are 0..n-1 for every student, so their centre and spread
    are constants and the fit is arithmetic on one row.
    """
    ranked = sorted(courses, key=lambda name: name.encode())
    x = [ranked.index(c) - (len(courses) - 1) / 2 for c in courses]
    actual = [F.col(str(i)) for i in range(len(courses))]
    mean = sum(actual) / len(courses)
    slope = sum(a * v for a, v in zip(actual, x)) / sum(v * v for v in x)
    fitted = _wide_means(enrollment, courses).where(_took_all(courses)).withColumns({"mean": mean, "slope": slope})
    predicted = [F.col("mean") + F.col("slope") * v for v in x]
    residual = [a - p for a, p in zip(actual, predicted)]
    return _per_course(fitted, courses, actual=actual, predicted=predicted, residual=residual)


def gain_radar(gains: DataFrame) -> DataFrame:
    """Radar rows: actual, expected and gain per student and course."""
    series = (
        F.when(F.col("_series") == "actual", "实际").when(F.col("_series") == "expected", "预测").otherwise("增值")
    )
    long = gains.unpivot(["student_id", "course_name"], ["actual", "expected", "gain"], "_series", "score")
    return long.select("student_id", F.col("course_name").alias("subject"), series.alias("type"), "score")


def gain_report(gains: DataFrame) -> DataFrame:
    """Text of a student's gains: one line per course."""
    line = F.format_string(
        "%s: actual %.4f, expected %.4f, gain %.4f", *(F.col(c) for c in ("course_name", "actual", "expected", "gain"))
    )
    lines = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    text = F.concat(F.lit("student "), F.col("student_id"), F.lit("\n"), lines)
    return gains.groupBy("student_id").agg(text.alias("report"))
