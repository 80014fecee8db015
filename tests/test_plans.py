"""What reaches the scan: filters and columns of a stored enrolment table."""

import random
import re

import pytest

from gradeloom.ml import training
from gradeloom.operators import benchmarks, distribution, value_added
from gradeloom.plans import reports
from gradeloom.sources import sinks, tables


@pytest.fixture(scope="module")
def enrollment(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "enrollment")
    rng = random.Random(4)
    rows = [
        (
            f"c{i % 3}", f"s{i % 20}", f"n{i % 20}", rng.choice(["OS", "DS"]), str(rng.randrange(40, 100)),
            rng.choice(["2020-2021", "2021-2022"]), rng.choice(["1", "2"]), f"m{i % 2}", "2020", "k", 2.0,
            "正常考试", 3.0, "女", 6.0,
        )
        for i in range(200)
    ]
    sinks.append_rows(spark.createDataFrame(rows, tables.SCHEMAS["enrollment"]), path)
    return tables.read_table(spark, path, "enrollment")


def scans(df):
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    filters = re.findall(r"PushedFilters: \[(.*)\]", plan)
    columns = [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*)>", plan)]
    return filters, columns


def test_report_filters_are_pushed(enrollment):
    filters, columns = scans(reports.violin(enrollment, course="OS", nature="1", cohort="2020")["rows"])
    assert "StringContains(course_name,OS)" in filters[0] and "EqualTo(exam_nature,正常考试)" in filters[0]
    assert set(columns[0]) <= {
        "class_id", "course_name", "grade_text", "cohort", "major", "semester", "academic_year", "exam_nature",
    }


def test_training_scans_once_with_its_courses(enrollment):
    roles = {"base": ("OS", "2020-2021"), "advanced": ("DS", "2021-2022"), "structures": ("DS", "2020-2021")}
    filters, columns = scans(training.training_set(enrollment, roles))
    assert len(filters) == 1 and "EqualTo(course_name,OS)" in filters[0]
    assert set(columns[0]) == {"student_id", "course_name", "grade_text", "academic_year"}


def test_gains_read_four_columns_at_most(enrollment):
    filters, columns = scans(value_added.line_residuals(enrollment, ["OS", "DS"]))
    assert "In(course_name, [DS,OS])" in filters[0] and set(columns[0]) == {"student_id", "course_name", "grade_text"}


def test_one_student_is_read_by_filter(enrollment):
    filters, _ = scans(benchmarks.home_scores(enrollment, student="s3"))
    assert any("EqualTo(student_id,s3)" in f for f in filters)


def test_results_do_not_depend_on_the_partitions(enrollment):
    def both(make):
        one = make(enrollment.coalesce(1)).collect()
        many = make(enrollment.repartition(11)).collect()
        return sorted(map(str, one)), sorted(map(str, many))

    order = ["academic_year", "semester", "student_id", "course_name", "grade_text"]
    for make in (
        lambda e: reports.gpa_ranking(e),
        lambda e: value_added.class_value_added(e, order),
        lambda e: distribution.five_numbers(distribution.violin_rows(e), ["x"], "y"),
        lambda e: benchmarks.home_scores(e),
    ):
        one, many = both(make)
        assert one == many
