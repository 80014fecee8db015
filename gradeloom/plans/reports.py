"""Composite reports with the parameters of a request.

Each takes the input tables as frames and returns frames. Those that rank,
share a step or fit constants run jobs while they are built, as they write
that step to the shared folder. Without a student, class or course the report
answers for all of them at once; a given one is an ordinary filter.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..ml import models, training
from ..operators import audit, benchmarks, cohort, distribution, graph, knowledge, value_added
from ..session import steps
from ..sources.sinks import json_record


def gpa_ranking(enrollment: DataFrame, cohort_name: str | None = None, major: str | None = None) -> DataFrame:
    """Masked names, GPA and position within cohort and major."""
    rows = enrollment
    if cohort_name is not None:
        rows = rows.where(F.col("cohort") == cohort_name)
    if major is not None:
        rows = rows.where(F.col("major") == major)
    return cohort.cohort_gpa_rank(rows)


def student_home(
    enrollment: DataFrame, semester: str = "%", academic_year: str = "%", student: str = "%", pooled: bool = False
) -> dict[str, DataFrame]:
    """Radar rows, line rows and weak subjects of the matching students."""
    by = () if pooled else ("student_id",)
    home = benchmarks.home_scores(enrollment, semester, academic_year, student, by)
    tables = {"radar": benchmarks.home_radar(home), "line": benchmarks.home_line(home)}
    if not pooled:
        tables |= {"weak": benchmarks.weak_subjects(home), "report": benchmarks.student_report(home)}
    return tables


def violin(enrollment: DataFrame, exam_course: str = "0", **filters: str) -> dict[str, DataFrame]:
    """Scores per class and their quartiles."""
    rows = distribution.violin_rows(enrollment, exam_course, **filters)
    return {"rows": rows, "summary": distribution.five_numbers(rows, ["x", "courseName"], "y")}


def class_gain(enrollment: DataFrame, order: Sequence[str], **filters: str) -> DataFrame:
    """Progress of each class over its enrolments, in ``order`` (year, semester, row keys)."""
    return value_added.class_value_added(enrollment, order, **filters)


def student_gain(enrollment: DataFrame, courses: Sequence[str], student: str | None = None) -> dict[str, DataFrame]:
    """Expected grades and gains, and the line over the courses.

    The expectation is fitted on all students. A given student who lacks one
    of the courses is an error.
    """
    gains = value_added.expected_gain(enrollment, courses)
    lines = value_added.line_residuals(enrollment, courses)
    if student is not None:
        gains = cohort.lookup(gains, "student_id", student)
        lines = lines.where(F.col("student_id") == student)
    return {"radar": value_added.gain_radar(gains), "line": lines, "report": value_added.gain_report(gains)}


def bubbles(
    points: DataFrame, scores: DataFrame, student: DataFrame,
    class_id: str = "%", course: str = "%", chapter: str = "%", by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Students per point and score, and the report lines made from them."""
    counts = knowledge.bubble_counts(points, scores, student, class_id, course, chapter, by)
    return {"rows": knowledge.bubble_labels(counts), "report": knowledge.class_report(counts, by)}


def degree_audit(
    enrollment: DataFrame, required: DataFrame, order: Sequence[str], student: str | None = None
) -> dict[str, DataFrame]:
    """Scores of the required courses, totals, and the courses still missing."""
    rows = enrollment if student is None else enrollment.where(F.col("student_id") == student)
    taken = audit.taken_courses(rows, order)
    return {
        "scores": audit.audit_scores(taken, required).orderBy("student_id", "score", "course_name"),
        "totals": audit.audit_totals(taken, required),
        "missing": audit.audit_missing(taken, required),
    }


def course_graph(
    points: DataFrame, edges: DataFrame, student: DataFrame, scores: DataFrame, stages: DataFrame,
    course: str, student_id: str, up_to: str | None = None,
) -> dict[str, DataFrame]:
    """Elements of a course's graph and its nodes coloured by a student's scores."""
    own_points = points.where(F.col("course") == course)
    own_edges = edges.where(F.col("course") == course)
    who = student.where(F.col("student_id") == student_id)
    own_scores = scores.where(F.col("student_id") == student_id)
    scored = knowledge.mastery(who, own_scores, own_points, stages, up_to)
    nodes = knowledge.student_display(own_points, scored)
    return {"elements": graph.elements(own_points, own_edges), "nodes": nodes}


def stage_choices(points: DataFrame, stages: DataFrame, course: str, year: str) -> DataFrame:
    """Stages of a course in a year, in order."""
    rows = knowledge.stage_list(points.where(F.col("course") == course), stages.where(F.col("year") == year))
    return rows.select("stage").orderBy("stage")


def grade_model(
    enrollment: DataFrame, roles: Mapping[str, tuple[str, str]], variant: str = "boosted", **options
) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """Train a variant on the courses in ``roles``; metrics and scored rows by part."""
    rows = models.prepared(training.training_set(enrollment, roles))
    model = models.train(rows, variant, **options)
    scored = models.diagnostics(model, rows)
    return model, {"metrics": models.metrics(scored), "rows": scored}


def write_report(
    spark: SparkSession, make: Callable[[], DataFrame | Mapping[str, DataFrame]], path: str, mode: str = "overwrite"
) -> None:
    """Write the frame, or each of the named frames, that ``make()`` builds, and remove the steps behind it.

    A report of several frames has a folder for each below ``path``.
    """
    with steps(spark):
        made = make()
        for name, frame in (made if isinstance(made, Mapping) else {"": made}).items():
            frame.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}".rstrip("/"))


def as_json(report: DataFrame) -> DataFrame:
    """The rows of a report as JSON records."""
    return report.select(json_record(*report.columns).alias("record"))
