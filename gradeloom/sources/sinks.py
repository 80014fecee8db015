"""Sinks: CSV sheets, JSON records, appends, partition replacement and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise
from .committed import Change, commit


def write_sheet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 CSV with a header and no index column."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append, creating the table when it is absent."""
    df.write.mode("append").parquet(path)


def json_record(*columns: Column | str) -> Column:
    """One row as a JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*columns))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def replace_courses(
    df: DataFrame, path: str, column: str = "course", courses: Sequence[str] | None = None
) -> None:
    """Replace all rows of ``courses`` by those in ``df``; other courses stay as they are.

    Without ``courses`` they are the ones in ``df``. A named course that ``df``
    has no row of loses all its rows: its partition is removed after the new
    ones are in place. Rebalanced by course: small courses are written by one
    task each, a course with most of the rows is split by size.
    """
    writer = df.hint("rebalance", F.col(column)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    if courses:
        named = df.where(F.col(column).isin(*courses)).select(column).distinct()
        _drop_partitions(df.sparkSession, path, column, set(courses) - {r[0] for r in named.collect()})


def _drop_partitions(spark: SparkSession, path: str, column: str, values: set[str]) -> None:
    """Remove whole partitions by the file system that the path belongs to."""
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for value in sorted(values):
        folder = jvm.org.apache.hadoop.fs.Path(path, f"{column}={escape(value)}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_graph(points: DataFrame, edges: DataFrame, path: str, courses: Sequence[str] = ()) -> int:
    """Points and edges of a course replace the stored ones together, in one commit; its number.

    ``courses`` are replaced even where no point or edge is given for them.
    """
    changes = {"points": Change(points, "course", courses), "edges": Change(edges, "course", courses)}
    return commit(points.sparkSession, path, changes)


def upsert_courses(df: DataFrame, path: str, keys: Sequence[str], column: str = "course") -> None:
    """Write the rows of ``df`` into the table at ``path``: new keys are added, known ones replaced.

    The keys are looked up in the whole table, of which only they and the
    course are read for that. Rewritten are the courses in ``df`` and those
    that hold a key of ``df`` now; a course that loses all its rows is removed.
    An absent table is created. The merged rows are stored first, as the table
    is read and overwritten. ``committed.upsert`` does the same in one commit.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        replace_courses(df, path, column)
        return
    table = spark.read.schema(df.schema).parquet(path)
    held = table.select(column, *(k for k in keys if k != column)).join(df.select(*keys), list(keys), "left_semi")
    held = materialise(held.select(column).distinct())
    touched = df.select(column).union(held).distinct()
    kept = table.join(touched, column, "left_semi").join(df.select(*keys), list(keys), "left_anti")
    merged = materialise(kept.select(*df.columns).unionByName(df))
    replace_courses(merged, path, column, [r[0] for r in held.collect()])
