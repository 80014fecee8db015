"""Knowledge-point scores: head counts, stages and mastery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import contains
from ..functions.text import mastery_band, mastery_colour, mastery_gradient, short_point, shown_score


def bubble_counts(
    points: DataFrame,
    scores: DataFrame,
    student: DataFrame,
    class_id: str = "%",
    course: str = "%",
    chapter: str = "%",
    by: Sequence[str] = (),
) -> DataFrame:
    """Student rows per knowledge point and score.

    ``by`` may add ``class_id``, ``course`` and ``chapter`` to answer for each
    of them. Points without any score give no row, so the outer join of the
    definition is an inner one. Scores are counted per point before the points
    are joined, so their names are not shuffled with every score row.
    """
    class_keys = [c for c in by if c == "class_id"]
    point_keys = [c for c in by if c != "class_id"]
    members = student.where(contains(F.col("class_id"), class_id)).select("student_id", "class_id")
    assessed = scores.where(F.col("score") != -1).select("student_id", "kp_id", "score")
    counted = assessed.join(members, "student_id").groupBy("kp_id", "score", *class_keys).agg(
        F.count("student_id").alias("n")
    )
    chosen = points.where(contains(F.col("course"), course) & contains(F.col("chapter"), chapter))
    named = counted.join(chosen.select("kp_id", "kp_name", *point_keys), "kp_id")
    return named.groupBy(*by, "kp_name", "score").agg(F.sum("n").alias("n_students"))


def bubble_labels(counts: DataFrame) -> DataFrame:
    """Display rows: point names shortened (several points may then read alike)."""
    return counts.withColumn("kp_name", short_point(F.col("kp_name")))


def class_report(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Report lines of each class, course and chapter: one per point and score."""
    text = F.format_string("%s: 得分 %.1f, 人数 %d", F.col("kp_name"), F.col("score"), F.col("n_students"))
    return counts.select(*by, "kp_name", "score", text.alias("line"))


def stage_list(points: DataFrame, stages: DataFrame) -> DataFrame:
    """Distinct stages per course and year."""
    pairs = stages.join(points.select("kp_id", "course").distinct(), "kp_id")
    return pairs.select("course", "year", "stage").distinct()


def chapter_list(points: DataFrame) -> DataFrame:
    """Distinct chapters per course."""
    return points.select("course", "chapter").distinct()


def point_scores(student: DataFrame, scores: DataFrame, points: DataFrame) -> DataFrame:
    """Every score of the known students with the name of its point."""
    rows = scores.select("student_id", "kp_id", "year", "score").join(student.select("student_id"), "student_id")
    return rows.join(points.select("kp_id", "kp_name"), "kp_id").select(
        "student_id", F.col("kp_id").cast("string").alias("id"), "kp_name", "year", "score"
    )


def mastery(
    student: DataFrame, scores: DataFrame, points: DataFrame, stages: DataFrame, up_to: str | None = None
) -> DataFrame:
    """Scores of the points whose stage is not after ``up_to``, per student.

    Years of score and stage are not matched, so a point with stages in two
    years is listed for each.
    """
    kept = stages.where(F.col("stage").isNotNull() if up_to is None else F.col("stage") <= up_to)
    staged = points.select("kp_id", "kp_name").join(kept.select("kp_id", "stage"), "kp_id")
    rows = scores.select("student_id", "kp_id", "year", "score").join(student.select("student_id"), "student_id")
    return rows.join(staged, "kp_id").select(
        "student_id", F.col("kp_id").cast("string").alias("id"), "kp_name", "year", "score", "stage"
    )


def _shown(scored: DataFrame) -> DataFrame:
    """(id, student_id, score): of several scores the one of the last stage (then year, then score)."""
    last = F.max(F.struct("stage", "year", "score")).alias("last")
    return scored.groupBy("id", "student_id").agg(last).select("id", "student_id", F.col("last.score").alias("score"))


def _displayed(rows: DataFrame) -> DataFrame:
    score = F.col("score")
    return rows.withColumns(
        {
            "band": mastery_band(score), "colour": mastery_colour(score), "gradient": mastery_gradient(score),
            "shown": shown_score(score),
        }
    )


def _nodes(points: DataFrame) -> DataFrame:
    return points.select(F.col("kp_id").cast("string").alias("id"), F.col("kp_name").alias("name"))


def mastery_display(points: DataFrame, scored: DataFrame) -> DataFrame:
    """The base layer, every point once without a student, and a row per student and scored point.

    The graph of a student is the base layer, in which the rows of the student
    replace those of the same point.
    """
    nodes = _nodes(points)
    base = nodes.withColumns({"student_id": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    own = nodes.join(_shown(scored), "id").select("id", "name", "student_id", "score")
    return _displayed(base.unionByName(own))


def student_display(points: DataFrame, scored: DataFrame) -> DataFrame:
    """Every point with the score shown on it, of the only student in ``scored``."""
    return _displayed(_nodes(points).join(_shown(scored).drop("student_id"), "id", "left").select("id", "name", "score"))
