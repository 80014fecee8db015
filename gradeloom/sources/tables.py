"""Schemas of the engine's input tables and loaders for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Column of ``read_checked`` with the lines that do not fit the header.
BROKEN = "_broken_line"

SCHEMAS = {
    "enrollment": (
        "class_id string, student_id string, name string, course_name string, "
        "grade_text string, academic_year string, semester string, major string, "
        "cohort string, course_code string, credit double, exam_nature string, "
        "gpa double, gender string, credit_point double"
    ),
    "student": "student_id string, name string, major string, class_id string, gender string",
    "course": "code long, name string",
    "knowledge_point": "kp_id long, kp_name string, chapter string, course string",
    "knowledge_edge": "source long, target long, course string",
    "stage_pre_year": "kp_id long, year string, scoring string, stage string",
    "student_knowledge": "student_id string, kp_id long, year string, score double",
}


def read_table(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Parquet scan; ``table`` fixes the schema to one of ``SCHEMAS``."""
    reader = spark.read
    if table is not None:
        reader = reader.schema(SCHEMAS[table])
    return reader.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int, **options
) -> DataFrame:
    """Relational scan split on ``column`` so that the tasks read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", column).option("numPartitions", partitions)
    reader = reader.option("lowerBound", lower).option("upperBound", upper)
    return reader.options(**options).load()


def read_sheet(spark: SparkSession, path: str, schema: str | None = None, numbered: bool = False) -> DataFrame:
    """Spreadsheet export with a header row. Without a schema all cells are text.

    ``numbered`` adds ``row_no``, which sorts the rows as they stand in the
    file, however the file is split: file, then block, then row of the block.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    sheet = (reader.schema(schema) if schema else reader).csv(path)
    return _numbered(sheet) if numbered else sheet


def _numbered(sheet: DataFrame) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return sheet.select("*", place.alias("row_no"))


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet export as text cells with ``row_no``, as in ``read_sheet``.

    A line with more or fewer cells than the header is kept as it stands in
    ``BROKEN``, which is NULL for the others.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    names = reader.csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, BROKEN]])
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", False)
    return _numbered(reader.schema(schema).csv(path))


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame], **binds) -> DataFrame:
    """SQL over the given frames with named binds (``:name``)."""
    return spark.sql(sql, args=binds, **views)
