"""Spreadsheets into stored tables: a file is read, checked, keyed and written in one commit.

What cannot be taken over is added to the table ``rejected`` by the same commit,
with the sheet, what it is about, the cell and the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.grades import numeric_grade
from ..functions.predicates import filled, not_blank
from ..operators import graph, reshape
from ..session import materialise
from ..sources import committed
from ..sources.committed import Change
from ..sources.tables import BROKEN, read_checked

STUDENT_HEADER = "学号"


def _rejected(rows: DataFrame, file: str, item: Column, cell: Column, reason: Column) -> DataFrame:
    return rows.select(
        F.lit(file).alias("sheet"), item.cast("string").alias("item"), cell.cast("string").alias("cell"), reason.alias("reason")
    )


def _lines(spark: SparkSession, file: str) -> tuple[DataFrame, DataFrame]:
    """The sheet's rows, read once, and the rejections of lines that do not fit the header."""
    sheet = materialise(read_checked(spark, file))
    broken = sheet.where(F.col(BROKEN).isNotNull())
    fault = _rejected(broken, file, F.lit(None), F.col(BROKEN), F.lit("number of cells"))
    return sheet.where(F.col(BROKEN).isNull()).drop(BROKEN), fault


def scores(
    spark: SparkSession, file: str, points: DataFrame, store: str, year: str, id_column: str = STUDENT_HEADER
) -> int:
    """Add a wide score sheet to the table ``student_knowledge``: one row per student and point; the commit's number.

    Empty cells are kept as NULL scores. Columns whose header is no point are
    passed over. Rejected are cells that are no number and rows without a student.
    """
    sheet, faults = _lines(spark, file)
    headers = [c for c in sheet.columns if c not in (id_column, "row_no")]
    cells = [F.struct(F.lit(c).alias("kp_name"), reshape.cell(c).alias("cell")) for c in headers]
    long = sheet.select(reshape.cell(id_column).alias("student_id"), reshape.cell_rows(cells, "kp_name: string, cell: string"))
    long = long.join(points.select("kp_name", "kp_id"), "kp_name")
    known = filled(F.trim("student_id"))
    empty = ~filled(F.trim(F.coalesce("cell", F.lit(""))))
    score = numeric_grade(F.col("cell"))
    reason = F.when(~F.coalesce(known, F.lit(False)), "no student").when(~empty & score.isNull(), "no number")
    checked = materialise(long.select("*", score.alias("score"), reason.alias("reason")))
    good = checked.where("reason IS NULL").select("student_id", "kp_id", F.lit(year).alias("year"), "score")
    bad = checked.where("reason IS NOT NULL")
    item = F.concat_ws(" ", "student_id", "kp_name")
    faults = faults.unionByName(_rejected(bad, file, item, F.col("cell"), F.col("reason")))
    changes = {"student_knowledge": Change(good, "year", append=True), "rejected": Change(faults, "reason", append=True)}
    return committed.commit(spark, store, changes)


def stages(spark: SparkSession, file: str, points: DataFrame, store: str, year: str, header: str = reshape.POINT_HEADER) -> int:
    """Put the scoring items of a sheet into ``stage_pre_year``, one for a point and year; the commit's number.

    The first column is the scoring item, whatever its header. Of several items
    of a point the first counts, by row and then column. Rejected are cells
    that name no point.
    """
    sheet, faults = _lines(spark, file)
    first = next(c for c in sheet.columns if c != "row_no")
    sheet = sheet.withColumnRenamed(first, "scoring")
    assigned = reshape.stage_assignment(reshape.scoring_cells(sheet, points, header), year)
    headers = [c for c in sheet.columns if header in c and c != "scoring"]
    if headers:
        names = sheet.select("scoring", F.explode(F.array(*(reshape.cell(c) for c in headers))).alias("kp_name"))
        unknown = names.where(filled(F.col("kp_name"))).join(points.select("kp_name"), "kp_name", "left_anti")
        faults = faults.unionByName(_rejected(unknown, file, F.col("scoring"), F.col("kp_name"), F.lit("no such point")))
    also = {"rejected": Change(faults, "reason", append=True)}
    return committed.upsert(spark, store, "stage_pre_year", assigned, ["kp_id", "year"], "year", also)


def prerequisites(spark: SparkSession, file: str, course: str, store: str) -> int:
    """Replace the points and edges of a course by those of a prerequisite sheet; the commit's number.

    Rejected are rows without a level-1 point.
    """
    sheet, faults = _lines(spark, file)
    sheet = graph.named_sheet(sheet)
    if "level1" in sheet.columns:
        blank = sheet.where(~F.coalesce(not_blank(F.col("level1")), F.lit(False)))
        faults = faults.unionByName(_rejected(blank, file, F.col("chapter"), F.col("level1"), F.lit("no point")))
    keyed = graph.assign_keys(graph.prereq_nodes(sheet).withColumn("course", F.lit(course)))
    points = materialise(keyed.select("kp_id", F.col("name").alias("kp_name"), "chapter", "course"))
    key = points.select("kp_id", "kp_name")
    edges = graph.prereq_edges(sheet)
    for end in ("source", "target"):
        edges = edges.join(key.withColumnsRenamed({"kp_id": f"{end}_id", "kp_name": end}), end)
    edges = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit(course).alias("course"))
    changes = {
        "points": Change(points, "course", [course]), "edges": Change(edges, "course", [course]),
        "rejected": Change(faults, "reason", append=True),
    }
    return committed.commit(spark, store, changes)
