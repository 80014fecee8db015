"""Composite reports, and the whole catalog against its SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gradeloom.operators import knowledge
from gradeloom.plans import reports
from gradeloom.sources import adapters as src

SF = "/root/testdata/sf0.001"
FITS = {"gbt_fit_metrics", "feature_importance"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(0.0 if r[i] == 0 and isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(values, key=lambda r: [(v is None, "" if v is None else v) for v in r])


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    df = contract.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("CartesianProduct", "NestedLoopJoin", "Python"))
    cursor = database.execute(contract.oracle_sql()[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - FITS))
def test_query_without_sql_gives_rows(spark, name):
    df = contract.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["cohort", "major", "student_id", "name", "gpa", "position"]


def test_filters_choose_rows_of_the_full_report(spark):
    enrollment = src.enrollment(spark, SF)
    one = reports.gpa_ranking(enrollment, "ASIA", "MACHINERY").collect()
    everyone = [r for r in reports.gpa_ranking(enrollment).collect() if (r.cohort, r.major) == ("ASIA", "MACHINERY")]
    assert one and sorted(one) == sorted(everyone)
    home = reports.student_home(enrollment, student="17")
    whole = reports.student_home(enrollment)
    for name in home:
        assert sorted(home[name].collect(), key=str) == sorted(
            whole[name].where("student_id = '17'").collect(), key=str
        )


def test_gain_of_one_student(spark):
    enrollment = src.enrollment(spark, SF)
    courses = ["ECONOMY", "LARGE"]
    report = reports.student_gain(enrollment, courses, "17")
    assert report["radar"].count() == 6 and report["line"].count() == 2
    assert report["report"].first().report.startswith("student 17\nECONOMY: actual ")
    with pytest.raises(LookupError):
        reports.student_gain(enrollment, courses, "nobody")


def test_grade_model(spark):
    roles = {
        "base": ("ECONOMY", "1998"), "advanced": ("LARGE", "1998"), "structures": ("MEDIUM", "1999"),
        "target": ("PROMO", "2000"),
    }
    enrollment = src.enrollment(spark, SF)
    model, tables = reports.grade_model(enrollment, roles, rounds=2, depth=2)
    assert {r.part for r in tables["metrics"].collect()} == {"train", "test"}
    assert tables["rows"].where("predicted IS NULL").count() == 0
    classes = reports.class_gain(enrollment, src.ROW_ORDER, cohort="ASIA")
    whole = {r.x: r.y for r in reports.class_gain(enrollment, src.ROW_ORDER).collect()}
    chosen = {r.x: r.y for r in classes.collect()}
    assert 0 < len(chosen) < len(whole) and all(whole[x] == y for x, y in chosen.items())


def test_course_graph(spark):
    points = src.knowledge_point(spark, SF)
    edges = src.knowledge_edge(spark, SF).withColumn("course", F.lit("Brand#3"))
    stages = src.scoring(spark, SF).withColumn("stage", F.lit("阶段1线性"))
    scores = src.student_knowledge(spark, SF)
    who = scores.join(points.where("course = 'Brand#3'"), "kp_id").first().student_id
    graph = reports.course_graph(points, edges, src.student(spark, SF), scores, stages, "Brand#3", who)
    n = points.where("course = 'Brand#3'").count()
    assert graph["nodes"].count() == n
    assert graph["elements"].count() == n + edges.distinct().count()
    assert graph["nodes"].where("score IS NOT NULL").count() >= 1
    scored = knowledge.mastery(src.student(spark, SF), scores, points.where("course = 'Brand#3'"), stages)
    layers = knowledge.mastery_display(points.where("course = 'Brand#3'"), scored)
    assert layers.where("student_id IS NULL").count() == n
    by_point = {r.id: r for r in layers.where("student_id IS NULL").collect()}
    by_point |= {r.id: r for r in layers.where(F.col("student_id") == who).collect()}
    columns = ["id", "name", "score", "band", "colour", "gradient", "shown"]
    assert sorted((tuple(r[c] for c in columns) for r in by_point.values()), key=str) == sorted(
        map(tuple, graph["nodes"].select(columns).collect()), key=str
    )
    choices = reports.stage_choices(points, stages, "Brand#3", "1998")
    assert [r.stage for r in choices.collect()] == ["阶段1线性"]
    assert reports.as_json(choices).first().record == '{"stage":"阶段1线性"}'


def test_violin_bubbles_and_audit(spark):
    enrollment = src.enrollment(spark, SF)
    violin = reports.violin(enrollment, course="ECO", nature="1")
    assert {r.courseName for r in violin["summary"].collect()} == {"ECONOMY"}
    assert violin["summary"].agg(F.sum("n")).first()[0] == violin["rows"].count()
    tables = reports.bubbles(src.knowledge_point(spark, SF), src.student_knowledge(spark, SF), src.student(spark, SF))
    assert tables["rows"].count() == tables["report"].count() > 0
    audit = reports.degree_audit(enrollment, src.required_courses(spark, SF), src.ROW_ORDER, "17")
    assert audit["totals"].count() == 1
    assert ("17", "THESIS") in [tuple(r) for r in audit["missing"].collect()]
