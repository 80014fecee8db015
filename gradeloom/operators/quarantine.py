"""Grades that a scale cannot take at face value, with the reason, kept apart from the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.grades import LABELS_A, LABELS_B, LABELS_C, NUMBER, scale_a, scale_b, scale_c
from ..sources.committed import Change, commit

SCALES = {"a": (scale_a, LABELS_A), "b": (scale_b, LABELS_B), "c": (scale_c, LABELS_C)}
LEAST, MOST = 0, 100
#: Reasons, the first that applies; a label of the scale has none.
REASONS = ("missing", "no number", "text after the number", "out of range")


def reason(grade: Column, scale: str) -> Column:
    """Why the scale's score of a grade text is none or only lenient; NULL for a good one.

    Scale A takes the number at the beginning and 0 for any other text, scales B
    and C take plain numbers only.
    """
    score, labels = SCALES[scale]
    value = score(grade)
    faults = (
        grade.isNull(),
        ~grade.rlike(f"^ *{NUMBER}"),
        ~grade.rlike(f"^ *{NUMBER} *$"),
        value.isNull() | (value < LEAST) | (value > MOST) | F.isnan(value),
    )
    found = F.lit(None).cast("string")
    for name, fault in zip(reversed(REASONS), reversed(faults)):
        found = F.when(fault, F.lit(name)).otherwise(found)
    return F.when(F.coalesce(grade.isin(*labels), F.lit(False)), F.lit(None)).otherwise(found)


def judged(rows: DataFrame, scale: str, column: str = "grade_text") -> DataFrame:
    """``rows`` with the scale's ``score`` and the ``reason`` against it."""
    grade = F.col(column)
    return rows.withColumns({"score": SCALES[scale][0](grade), "reason": reason(grade, scale)})


def set_apart(rows: DataFrame, path: str, table: str) -> dict[str, int]:
    """Write ``judged`` rows into a committed table, good and bad ones as partitions of one write.

    The rows are read once and not shuffled: the counts by reason come out of the same pass.
    ``status`` is ``good`` or ``bad``.
    """
    seen = Observation(f"reasons of {table}")
    kinds = {"good": F.col("reason").isNull()} | {r: F.col("reason") == r for r in REASONS}
    counts = [F.count_if(test).alias(name) for name, test in kinds.items()]
    status = F.when(F.col("reason").isNull(), "good").otherwise("bad")
    observed = rows.withColumn("status", status).observe(seen, *counts)
    commit(rows.sparkSession, path, {table: Change(observed, "status", few=True)})
    return seen.get
