"""Spreadsheets to tables: score sheets and scoring sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grades import stage_of
from ..functions.predicates import filled

POINT_HEADER = "知识点"


def cell(name: str) -> Column:
    """Sheet column by its header, which may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def cell_rows(cells: Sequence[Column], kind: str) -> Column:
    """The cells of a row as rows of type ``struct<kind>``; none if the sheet has no such column."""
    return F.inline(F.array(*cells) if cells else F.array().cast(f"array<struct<{kind}>>"))


def unpivot_scores(sheet: DataFrame, points: DataFrame, year: str, id_column: str = "student_id") -> DataFrame:
    """Wide score sheet to (student, point, year, score); NULL scores are kept.

    Columns whose header is no point's name drop out in the join.
    """
    names = [c for c in sheet.columns if c != id_column]
    cells = [F.struct(F.lit(c).alias("kp_name"), cell(c).cast("double").alias("score")) for c in names]
    long = sheet.select(cell(id_column).alias("student_id"), cell_rows(cells, "kp_name: string, score: double"))
    return long.join(points.select("kp_name", "kp_id"), "kp_name").select(
        "student_id", "kp_id", F.lit(year).alias("year"), "score"
    )


def scoring_cells(sheet: DataFrame, points: DataFrame, header: str = POINT_HEADER) -> DataFrame:
    """Cells of the point columns as (row, column, scoring item, point id).

    Point columns are those whose header contains ``header``. Empty cells and
    unknown points give no row.
    """
    columns = [c for c in sheet.columns if header in c]
    places = [
        F.struct(F.lit(sheet.columns.index(c)).alias("col_no"), cell(c).alias("kp_name")) for c in columns
    ]
    long = sheet.select("row_no", "scoring", cell_rows(places, "col_no: int, kp_name: string")).where(filled(F.col("kp_name")))
    return long.join(points.select("kp_name", "kp_id"), "kp_name").select("row_no", "col_no", "scoring", "kp_id")


def stage_assignment(cells: DataFrame, year: str) -> DataFrame:
    """First scoring item of each point (row, then column) with its stage."""
    first = F.min(F.struct("row_no", "col_no", "scoring")).alias("first")
    rows = cells.groupBy("kp_id").agg(first)
    scoring = F.col("first.scoring")
    return rows.select(
        "kp_id", F.lit(year).alias("year"), scoring.alias("scoring"), stage_of(scoring).alias("stage")
    )


def with_stage(scoring: DataFrame) -> DataFrame:
    """Add the stage of the scoring item."""
    return scoring.withColumn("stage", stage_of(F.col("scoring")))


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` replaces the rows with its keys and adds the others."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def update_scoring(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points with the last scoring item that names them; others keep theirs."""
    last = F.max(F.struct("row_no", "col_no", "scoring")).alias("last")
    written = cells.groupBy("kp_id").agg(last).select("kp_id", F.col("last.scoring").alias("_scoring"))
    joined = points.join(written, "kp_id", "left")
    scoring = F.coalesce("_scoring", "scoring").alias("scoring")
    return joined.select(*(scoring if c == "scoring" else F.col(c) for c in points.columns))


def insert_missing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key the existing table lacks, ready to append."""
    return rows.join(existing.select(key), key, "left_anti")
