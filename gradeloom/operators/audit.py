"""Degree audit: a student's courses against the required ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.grades import scale_c

# Fixed value: the credit point that is reported course by course.
FULL_POINTS = 18
# Parts of a study plan; each is one array.
SHARES = 4


def taken_courses(enrollment: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per student and course: the last enrolment's points and grade."""
    last = F.max(F.struct(*order, "credit_point")).alias("last")
    rows = enrollment.groupBy("student_id", "course_name").agg(last)
    return rows.select(
        "student_id", "course_name", F.col("last.credit_point").alias("credit_point"),
        F.col("last.grade_text").alias("grade_text"),
    )


def audit_scores(taken: DataFrame, required: DataFrame) -> DataFrame:
    """Required courses a student took, on scale C; other texts are flagged."""
    rows = taken.join(required.select("course_name"), "course_name", "left_semi")
    score = scale_c(F.col("grade_text"))
    return rows.select(
        "student_id", "course_name", "grade_text", "credit_point", score.alias("score"),
        (score.isNull() & F.col("grade_text").isNotNull()).alias("invalid"),
    )


def audit_totals(taken: DataFrame, required: DataFrame) -> DataFrame:
    """Credit points over the required courses and the courses worth 18.

    Students without any required course have a total of 0.
    """
    plan = required.select("course_name").distinct().withColumn("_required", F.lit(True))
    rows = taken.join(plan, "course_name", "left")
    points = F.when(F.col("_required"), F.coalesce("credit_point", F.lit(0.0))).otherwise(0.0)
    full = F.when(F.col("_required") & (F.col("credit_point") == FULL_POINTS), F.col("course_name"))
    return rows.groupBy("student_id").agg(
        F.sum(points).alias("total_points"),
        F.array_join(F.sort_array(F.collect_set(full)), ",").alias("full_courses"),
    )


def audit_missing(taken: DataFrame, required: DataFrame, shares: int = SHARES) -> DataFrame:
    """Required courses a student has not taken.

    The plan is dealt into ``shares`` by a hash of the course, each share an
    array; a student's taken required courses are dealt alike, and each share of
    a student meets the plan's share once. The enrolments are aggregated once
    for any number of shares, which only bounds the length of an array: a plan
    of n courses has about n / shares in each.
    """
    share = F.pmod(F.xxhash64("course_name"), F.lit(shares)).cast("int")
    plan = required.select("course_name").distinct().where(F.col("course_name").isNotNull()).withColumn("share", share)
    wanted = plan.groupBy("share").agg(F.collect_set("course_name").alias("wanted"))
    flagged = taken.join(plan.select("course_name", F.col("share").alias("_share")), "course_name", "left")
    pair = F.when(F.col("_share").isNotNull(), F.struct("_share", "course_name"))
    students = flagged.groupBy("student_id").agg(F.collect_set(pair).alias("have"))
    dealt = students.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    own = F.filter("have", lambda x: x["_share"] == F.col("share"))
    have = F.transform(own, lambda x: x["course_name"])
    rows = dealt.select("student_id", "share", have.alias("have")).join(wanted, "share")
    return rows.select("student_id", F.explode(F.array_except("wanted", "have")).alias("course_name"))
