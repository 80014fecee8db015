"""Grade texts to numbers, scoring items to stages, score bins.

Grades arrive as text that is either a number or a label. Three scales are in
use. They disagree on purpose (``及格`` is 60 on one and 65 on the others), so
each keeps its own table and its own rule for texts that are no number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label tables of the three grade scales.
LABELS_A = {"优秀": 95, "良好": 85, "中等": 75, "及格": 60, "通过": 100, "不及格": 0}
LABELS_B = {"优": 95, "良": 85, "中": 75, "及格": 65, "不及格": 0, "缓考": 0}
LABELS_C = {"优秀": 95, "良好": 85, "中等": 75, "及格": 65}

# Scoring items of each stage.
STAGES = {
    "阶段1线性": ["作业1线性", "实验1", "实验2"],
    "阶段2树图": ["作业2树图", "实验3", "实验4"],
    "阶段3查找排序": ["阶段考试", "作业3查找排序"],
    "阶段4期末": ["期末考试"],
}

# Right-closed score bins and their labels.
BIN_EDGES = [0, 60, 75, 90, 100]
BIN_LABELS = ["差", "中", "良", "优"]

NUMBER = r"([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"


def _labelled(grade: Column, labels: dict[str, int], otherwise: Column) -> Column:
    """Value of the label, else ``otherwise``. A map keeps the expression small
    when the optimizer copies it into pushed-down filters."""
    table = F.create_map(*(F.lit(x) for label, value in labels.items() for x in (label, float(value))))
    return F.coalesce(F.try_element_at(table, grade), otherwise)


def numeric_grade(grade: Column) -> Column:
    """The text as a number, NULL when it is anything but a plain number."""
    return F.regexp_extract(grade, f"^ *{NUMBER} *$", 1).try_cast("double")


def whole_grade(grade: Column) -> Column:
    """Lenient whole-number cast: leading number rounded half up, else 0.

    A number of more than ten digits is no grade and gives NULL.
    """
    leading = F.regexp_extract(grade, f"^ *{NUMBER}", 1)
    number = leading.try_cast("double").try_cast("decimal(10,0)").cast("double")
    return F.coalesce(number, F.when(leading == "", F.lit(0.0)))


def scale_a(grade: Column) -> Column:
    """Scale A: labels, else the lenient whole-number cast. NULL stays NULL."""
    return _labelled(grade, LABELS_A, whole_grade(grade))


def scale_b(grade: Column) -> Column:
    """Scale B: labels, else a plain number, else NULL (callers drop the row)."""
    return _labelled(grade, LABELS_B, numeric_grade(grade))


def scale_c(grade: Column) -> Column:
    """Scale C: labels, else a plain number, else NULL (callers flag the row)."""
    return _labelled(grade, LABELS_C, numeric_grade(grade))


def violin_score(grade: Column, exam_course: Column | str) -> Column:
    """Numeric grades only for exam courses (flag ``'1'``), scale B otherwise."""
    flag = F.lit(exam_course) if isinstance(exam_course, str) else exam_course
    return F.when(flag == "1", numeric_grade(grade)).otherwise(scale_b(grade))


def stage_of(scoring: Column) -> Column:
    """Stage a scoring item belongs to, NULL for unknown items."""
    result = F.lit(None).cast("string")
    for stage, items in STAGES.items():
        result = F.when(scoring.isin(items), F.lit(stage)).otherwise(result)
    return result


def stretch_above(score: Column, ceiling: Column | float) -> Column:
    """Replace the part above ``ceiling`` by its square root."""
    top = F.lit(ceiling) if isinstance(ceiling, (int, float)) else ceiling
    return F.when(score >= top, top + F.sqrt(score - top)).otherwise(score)


def score_bin(score: Column) -> Column:
    """Right-closed bin label; NULL outside (0, 100]."""
    result = F.lit(None).cast("string")
    for low, high, label in zip(BIN_EDGES, BIN_EDGES[1:], BIN_LABELS):
        inside = (score > low) & (score <= high)
        result = F.when(inside, F.lit(label)).otherwise(result)
    return result


def indicator(value: Column, category) -> Column:
    """1.0 where ``value`` is the category, 0.0 elsewhere and for NULL."""
    return F.coalesce((value == F.lit(category)).cast("double"), F.lit(0.0))
