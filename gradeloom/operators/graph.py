"""Directed knowledge graph as two tables: nodes (id, name) and edges.

Neighbours stay rows, one per edge end: a hub with a third of all edges is
then spread over the tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import not_blank
from ..sources.sinks import json_record

# Headers of the prerequisite sheet.
SHEET_HEADERS = {
    "章节": "chapter", "一级知识点": "level1",
    "前驱知识点1": "pre1", "前驱知识点2": "pre2", "前驱知识点3": "pre3",
    "二级知识点1": "sub1", "二级知识点2": "sub2", "二级知识点3": "sub3", "二级知识点4": "sub4", "二级知识点5": "sub5",
}

#: Columns of a sheet that hold the predecessors and the secondary points.
CELLS = ("pre1", "pre2", "pre3", "sub1", "sub2", "sub3", "sub4", "sub5")


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree per node; isolated nodes have 0."""
    ends = F.explode(
        F.array(
            F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    counted = (
        edge_set(edges).select(ends.alias("end")).groupBy(F.col("end.id").alias("id"))
        .agg(F.sum("end.o").alias("out_degree"), F.sum("end.i").alias("in_degree"))
    )
    joined = nodes.select("id").join(counted, "id", "left")
    return joined.na.fill(0, ["out_degree", "in_degree"])


def adjacency(edges: DataFrame) -> DataFrame:
    """Successors and predecessors of every node, one row each."""
    both = F.array(
        F.struct(F.col("source").alias("id"), F.lit("successor").alias("relation"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("id"), F.lit("predecessor").alias("relation"), F.col("source").alias("other")),
    )
    return edge_set(edges).select(F.inline(both))


def neighbourhood(edges: DataFrame) -> DataFrame:
    """Nodes one hop away in either direction; a self-loop adds nothing."""
    return adjacency(edges).where(F.col("id") != F.col("other")).select("id", "other").distinct()


def leaf_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Secondary points: one edge out, none in."""
    return degrees(nodes, edges).where((F.col("out_degree") == 1) & (F.col("in_degree") == 0)).select("id")


def id_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Node id for each name; unknown names give no row."""
    return names.select("name").distinct().join(nodes.select("name", "id"), "name")


def valid_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges within a course: both ends are points of the same course."""
    membership = points.select("kp_id", "course").distinct()
    starts = membership.withColumnRenamed("kp_id", "source")
    ends = membership.withColumnRenamed("kp_id", "target")
    rows = edge_set(edges).join(starts, "source")
    return rows.join(ends, ["target", "course"], "left_semi").select("course", "source", "target")


def elements(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Export: one JSON element per node and per edge of every course."""
    node = F.struct(F.col("kp_id").cast("string").alias("id"), F.col("kp_name").alias("name"))
    link = F.struct(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    nodes = points.select("course", json_record(node.alias("data")).alias("element"))
    links = edges.select("course", json_record(link.alias("data")).alias("element"))
    return nodes.unionByName(links)


def assign_keys(nodes: DataFrame) -> DataFrame:
    """Reproducible 60-bit key per (course, name); raises if two names collide.

    The first 15 hexadecimal digits of an md5, as other engines compute it alike.
    """
    digest = F.md5(F.concat_ws("\x1f", "course", "name").cast("binary"))
    keyed = nodes.withColumn("kp_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    pairs = keyed.select("kp_id", "course", "name").distinct()
    if not pairs.groupBy("kp_id").count().where(F.col("count") > 1).isEmpty():
        raise ValueError("two knowledge points have the same key")
    return keyed


def named_sheet(sheet: DataFrame) -> DataFrame:
    """The sheet with its own headers replaced by the names used here; other columns stay."""
    return sheet.withColumnsRenamed(SHEET_HEADERS)


def _first_mentions(sheet: DataFrame, cells: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Sheet rows by level-1 point: a repeated point keeps its first row."""
    missing = {"row_no", "chapter", "level1"} - set(sheet.columns)
    if missing:
        raise ValueError(f"sheet lacks the columns {sorted(missing)}")
    present = [c for c in cells if c in sheet.columns]
    first = F.min(F.struct("row_no", "chapter", *present)).alias("row")
    rows = sheet.where(not_blank(F.col("level1"))).groupBy("level1").agg(first)
    return rows.select("level1", "row.*"), present


def prereq_edges(sheet: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    """Edges by name: predecessors and secondary points lead to the level-1 point.

    ``cells`` names the columns of points, in their order; those that the sheet
    lacks are empty, and no other column is read as one.
    """
    rows, cells = _first_mentions(sheet, cells)
    source = F.explode(F.array(*cells) if cells else F.array().cast("array<string>")).alias("source")
    long = rows.select(source, F.col("level1").alias("target"))
    return long.where(not_blank(F.col("source"))).distinct()


def prereq_nodes(sheet: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    """One node per name, in the chapter that mentions it first (row, then column)."""
    rows, cells = _first_mentions(sheet, cells)
    places = [F.struct(F.lit(0).alias("pos"), F.col("level1").alias("name"))]
    places += [F.struct(F.lit(i + 1).alias("pos"), F.col(c).alias("name")) for i, c in enumerate(cells)]
    mentions = rows.select("row_no", "chapter", F.inline(F.array(*places))).where(not_blank(F.col("name")))
    first = F.min(F.struct("row_no", "pos", "chapter")).alias("first")
    return mentions.groupBy("name").agg(first).select("name", F.col("first.chapter").alias("chapter"))
