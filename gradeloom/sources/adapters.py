"""The engine's input tables, derived from the star-schema test tables.

Each function returns one table of ``tables.SCHEMAS`` (plus row keys where a
total order is needed). The SQL in ``oracles.py`` states the same derivations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Total order of the enrolments of one class or student.
ROW_ORDER = [
    "academic_year", "semester", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grade_text",
]

_LINE_GRADES_CLOSED = ["优秀", "良好", "中等", "及格", "通过", "不及格"]
_LINE_GRADES_OPEN = ["优", "良", "中", "及格", "不及格", "缓考"]
SCORING_ITEMS = ["作业1线性", "实验1", "实验2", "作业2树图", "实验3", "实验4", "阶段考试", "期末考试"]


# Stated, so that reading a table starts no job to infer its schema.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str], first: int, default: Column) -> Column:
    result = default
    for i, value in enumerate(values):
        result = F.when(index == first + i, F.lit(value)).otherwise(result)
    return result


def _lines_with(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Line items with their order: both sides are large, so sorted and merged.

    The hint keeps a small sample of the tables from being planned unlike the
    full ones (a broadcast of the line items); skewed keys are split by AQE.
    """
    lines = table(spark, sf_dir, "lineitem").hint("merge")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; dimensions are joined to orders before line items."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = _lines_with(spark, sf_dir, orders)
    rows = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))

    number = F.col("l_linenumber")
    credit = 1 + number % 4
    grade = (
        F.when(F.col("l_returnflag") != "N", (50 + F.col("l_quantity")).cast("int").cast("string"))
        .when(F.col("l_linestatus") == "F", _pick(number, _LINE_GRADES_CLOSED, 1, F.lit("缓考")))
        .otherwise(_pick(number, _LINE_GRADES_OPEN, 1, F.lit("87.5")))
    )
    gender = F.when(
        F.col("c_custkey") % 17 != 0, F.when(F.col("c_custkey") % 2 == 0, "女").otherwise("男")
    )
    return rows.select(
        F.col("c_custkey").cast("string").alias("student_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("class_id"),
        F.col("c_mktsegment").alias("major"),
        F.col("r_name").alias("cohort"),
        F.col("p_brand").alias("course_code"),
        F.col("p_type").alias("course_name"),
        gender.alias("gender"),
        grade.alias("grade_text"),
        F.year("o_orderdate").cast("string").alias("academic_year"),
        F.when(F.month("o_orderdate") <= 6, "2").otherwise("1").alias("semester"),
        F.when(F.col("o_orderstatus") == "P", "补考").otherwise("正常考试").alias("exam_nature"),
        credit.cast("double").alias("credit"),
        (credit * F.col("l_quantity") / 10).alias("credit_point"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def student(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student table: one row per customer."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    gender = F.when(
        F.col("c_custkey") % 17 != 0, F.when(F.col("c_custkey") % 2 == 0, "女").otherwise("男")
    )
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("student_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("major"),
        F.col("n_name").alias("class_id"),
        gender.alias("gender"),
    )


def knowledge_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("kp_id"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("kp_name"),
        F.col("p_type").alias("chapter"),
        F.col("p_brand").alias("course"),
    )


def knowledge_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on consecutive lines of an order. Repeats go before the join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    left = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("line"), F.col("l_partkey").alias("source"))
    right = lines.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("target"))
    pairs = left.join(right, ["l_orderkey", "line"]).where(F.col("source") != F.col("target"))
    return pairs.select("source", "target").distinct()


def irregular_enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrolments with long course names, students without class or major, and groups in which every grade is 0."""
    student = F.col("student_id").cast("long")
    none = (F.col("course_name") == "PROMO") & F.col("class_id").endswith("1")
    none |= (F.col("course_name") == "SMALL") & (F.col("major") == "BUILDING")
    long_name = F.concat("course_name", F.lit(" "), "course_code")
    return enrollment(spark, sf_dir).withColumns(
        {
            "course_name": F.when(F.col("l_linenumber") % 2 == 1, long_name).otherwise(F.col("course_name")),
            "class_id": F.when(student % 13 != 0, F.col("class_id")),
            "major": F.when(student % 11 != 0, F.col("major")),
            "grade_text": F.when(none, "0").otherwise(F.col("grade_text")),
        }
    )


def lowered_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of points, two less each, so that the lowest one is 0; what was not assessed stays so."""
    lower = F.when(F.col("score") >= 0, F.col("score") - 2).otherwise(F.col("score"))
    return student_knowledge(spark, sf_dir).withColumn("score", lower)


def student_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_returnflag") == "N", -1.0).otherwise(F.col("l_quantity") * 2)
    return _lines_with(spark, sf_dir, table(spark, sf_dir, "orders")).select(
        F.col("o_custkey").cast("string").alias("student_id"),
        F.col("l_partkey").alias("kp_id"),
        F.year("o_orderdate").cast("string").alias("year"),
        score.alias("score"),
    )


def _scoring_item(size: Column) -> Column:
    return _pick(size % 9, SCORING_ITEMS, 0, F.lit("其他"))


def scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring item of every point for two years (no stage yet)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("kp_id"),
        F.explode(F.array(F.lit("1998"), F.lit("1999"))).alias("year"),
        _scoring_item(F.col("p_size")).alias("scoring"),
    )


def scored_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge points with their scoring item."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("kp_id"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("kp_name"),
        _scoring_item(F.col("p_size")).alias("scoring"),
    )


def score_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point ids for the wide score sheet; one sheet column has no point."""
    part = table(spark, sf_dir, "part").where(F.col("p_type") != "SMALL")
    return part.groupBy(F.col("p_type").alias("kp_name")).agg(F.min("p_partkey").alias("kp_id"))


SHEET_POINTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def score_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide score sheet: one column per point name."""
    cells = [
        F.max(F.when(F.col("course_name") == p, F.col("credit_point"))).alias(p) for p in SHEET_POINTS
    ]
    return enrollment(spark, sf_dir).groupBy("student_id").agg(*cells)


def prereq_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide prerequisite sheet: level-1 point, predecessors, secondary points."""
    part_on = {
        i: F.min(F.when(F.col("l_linenumber") == i, F.col("l_partkey"))).alias(f"_p{i}")
        for i in range(1, 8)
    }
    wide = (
        _lines_with(spark, sf_dir, table(spark, sf_dir, "orders"))
        .groupBy("o_orderkey", "o_orderpriority")
        .agg(*part_on.values())
        .where(F.col("_p1").isNotNull())
    )
    point = {i: F.concat(F.lit("KP"), F.col(f"_p{i}").cast("string")) for i in range(1, 8)}
    return wide.select(
        F.col("o_orderkey").alias("row_no"),
        F.col("o_orderpriority").alias("chapter"),
        point[1].alias("level1"),
        point[2].alias("pre1"),
        point[3].alias("pre2"),
        F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise(point[4]).alias("pre3"),
        point[5].alias("sub1"),
        point[6].alias("sub2"),
        point[7].alias("sub3"),
    )


def scoring_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring sheet whose point cells hold ids; some ids are unknown."""
    part = table(spark, sf_dir, "part").groupBy("p_size").agg(
        F.min("p_partkey").alias("_lo"), F.max("p_partkey").alias("_hi")
    )
    size = F.col("p_size")
    return part.select(
        size.alias("row_no"),
        _scoring_item(size).alias("scoring"),
        F.col("_lo").cast("string").alias("kp_1"),
        (F.col("_lo") + size % 3).cast("string").alias("kp_2"),
        F.when(size % 4 != 0, (F.col("_hi") + 3).cast("string")).alias("kp_3"),
    )


def required_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study plan: course types but one, and a course nobody takes."""
    part = table(spark, sf_dir, "part").where(F.col("p_type") != "SMALL")
    known = part.select(F.col("p_type").alias("course_name")).distinct()
    thesis = table(spark, sf_dir, "region").agg(F.lit("THESIS").alias("course_name"))
    return known.unionByName(thesis)


def existing_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course table before the insert: the codes that sort before ``Brand#2``."""
    part = table(spark, sf_dir, "part").where(F.col("p_brand") < "Brand#2")
    return part.groupBy(F.col("p_brand").alias("course_code")).agg(F.min("p_type").alias("course_name"))


def existing_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student table before the insert: customers with a debt."""
    rows = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    return rows.select(F.col("c_custkey").cast("string").alias("student_id"))
