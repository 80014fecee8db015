"""Filter predicates shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column

# Exam-nature flags of the request and the patterns they select.
EXAM_NATURE = {"0": "%", "1": "正常考试"}


def matches(column: Column, pattern: str) -> Column:
    """LIKE with ``pattern`` as given. A NULL column never matches, even ``%``.

    A backslash that escapes neither wildcard nor itself is taken literally.
    Runs of ``%`` mean one, and ``%`` alone is a test for NULL that the scan
    can apply.
    """
    parts = re.findall(r"\\[\\%_]|%+|.", pattern, flags=re.DOTALL)
    clean = "".join("%" if p[0] == "%" else r"\\" if p == "\\" else p for p in parts)
    return column.isNotNull() if clean == "%" else column.like(clean)


def contains(column: Column, text: str) -> Column:
    """LIKE ``%text%``; wildcards inside ``text`` stay active."""
    return matches(column, f"%{text}%")


def exam_nature(column: Column, flag: str) -> Column:
    """Exam nature by flag: 0 any, 1 regular exams, else the flag as a pattern."""
    return matches(column, EXAM_NATURE.get(flag, flag))


def not_blank(cell: Column) -> Column:
    """Neither NULL nor exactly one space."""
    return cell.isNotNull() & (cell != " ")


def filled(cell: Column) -> Column:
    """Neither NULL nor empty."""
    return cell.isNotNull() & (cell != "")
