"""Operators on small hand-written frames, against brute force in Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import audit, benchmarks, cohort, distribution, graph, knowledge, ordering, reshape, value_added
from gradeloom.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_number_rows_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}", rng.randrange(50), i) for i in range(3000)]
    data.append((None, 1, 3000))
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(7)
    got = ordering.number_rows(df, ["g"], [F.col("v").desc(), F.col("id")], "pos")
    expected = []
    for key, group in itertools.groupby(sorted(data, key=lambda r: (r[0] or "", -r[1], r[2])), key=lambda r: r[0]):
        expected += [(r[2], i) for i, r in enumerate(group, start=1)]
    assert rows(got, "id", "pos") == sorted(expected)


def test_sequence_slope_is_the_least_squares_slope(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 5}", i % 17, i, float(rng.randrange(100)), f"c{i}") for i in range(2000)]
    data += [("one", 1, 9001, 5.0, "x"), ("two", 2, 9003, 9.0, "late"), ("two", 1, 9002, 1.5, "early")]
    data += [("two", 0, 9004, None, "none"), ("tied", 3, 9005, 4.0, "a"), ("tied", 3, 9006, 4.0, "b")]
    df = spark.createDataFrame(data, "g string, a int, b int, y double, c string").repartition(6)
    got = {r.g: r for r in ordering.sequence_slope(df, ["g"], [F.col("a"), F.col("b")], "y", ["c"]).collect()}
    assert "one" not in got and got["two"].slope == 7.5 and got["two"].c == "early" and got["tied"].slope == 0
    for key in {r[0] for r in data} - {"one"}:
        group = sorted((r for r in data if r[0] == key and r[3] is not None), key=lambda r: (r[1], r[2]))
        slope = np.polyfit(range(len(group)), [r[3] for r in group], 1)[0]
        assert got[key].slope == pytest.approx(slope, abs=1e-9) and got[key].c == group[0][4]


GPA = "cohort string, major string, student_id string, name string, credit_point double, credit double"


def test_gpa_rank(spark):
    data = [
        ("2020", "cs", "s1", "李雷", 8.0, 2.0), ("2020", "cs", "s1", "李雷", None, 2.0),
        ("2020", "cs", "s2", "韩梅梅", 4.0, 1.0), ("2020", "cs", "s3", "王", 4.0, 1.0),
        ("2020", "cs", "s4", "零", 0.0, 0.0), ("2020", "ee", "s5", "Bob", 69.0, 40.0), (None, "cs", "s6", "x", 1.0, 1.0),
    ]
    got = rows(cohort.cohort_gpa_rank(spark.createDataFrame(data, GPA)), "major", "position", "student_id", "name", "gpa")
    assert got == [
        ("cs", 1, "s2", "韩**", 4.0), ("cs", 2, "s3", "王", 4.0), ("cs", 3, "s1", "李*", 2.0), ("cs", 4, "s4", "零", None),
        ("ee", 1, "s5", "B**", 1.73),
    ]


def test_lookup_raises(spark):
    df = spark.createDataFrame([("a", 1)], "code string, n int")
    assert cohort.lookup(df, "code", "a").count() == 1
    with pytest.raises(LookupError):
        cohort.lookup(df, "code", "b")


HOME = (
    "student_id string, class_id string, major string, course_name string, grade_text string, "
    "semester string, academic_year string"
)


def home_frame(spark, seed=3, n=120):
    rng = random.Random(seed)
    grades = ["优秀", "缓考", "80", "61", "70.5", None]
    data = [
        (
            f"s{rng.randrange(12)}", rng.choice(["c1", "c2", None]), rng.choice(["m1", "m2", None]),
            rng.choice(["数据结构与算法基础", "OS", "DB"]), rng.choice(grades), rng.choice(["1", "2"]), "2021-2022",
        )
        for _ in range(n)
    ]
    return data, spark.createDataFrame(data, HOME)


def score(text):
    return {"优秀": 95.0, "缓考": 0.0, "80": 80.0, "61": 61.0, "70.5": 71.0, None: None}[text]


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


@pytest.mark.parametrize("by_student", [True, False])
def test_home_means_equal_the_triple_join(spark, by_student):
    data, df = home_frame(spark)
    expected = {}
    for e in data:
        if e[5] != "1":
            continue
        second = [o for o in data if o[3] == e[3] and None not in (o[1], e[1]) and o[1] == e[1]] or [None]
        third = [o for o in data if o[3] == e[3] and None not in (o[2], e[2]) and o[2] == e[2]] or [None]
        key = (e[0], e[3], e[4]) if by_student else (e[3], e[4])
        lists = expected.setdefault(key, ([], []))
        for a in second:
            for b in third:
                lists[0].append(score(a[4]) if a else None)
                lists[1].append(score(b[4]) if b else None)
    by = ["student_id"] if by_student else []
    got = benchmarks.home_scores(df, semester="1", by=by).collect()
    assert len(got) == len(expected)
    for r in got:
        lists = expected[tuple(r[c] for c in [*by, "course_name", "grade_text"])]
        assert r.personal == score(r.grade_text)
        assert r.class_mean == (None if mean(lists[0]) is None else pytest.approx(mean(lists[0])))
        assert r.major_mean == (None if mean(lists[1]) is None else pytest.approx(mean(lists[1])))


def test_home_rows(spark):
    schema = "student_id string, course_name string, grade_text string, personal double, class_mean double, major_mean double"
    data = [("s", "数据结构与算法基础", "80", 80.0, 0.0, 70.0), ("s", "OS", None, None, 60.0, None), ("s", "DB", "50", 50.0, 60.0, 55.0)]
    home = spark.createDataFrame(data, schema)
    assert rows(benchmarks.home_line(home), "subject", "class_mean", "major_mean") == [
        ("DB", 60.0, 55.0), ("数据结构..基础", None, 70.0),
    ]
    assert rows(benchmarks.home_radar(home), "subject", "type", "score") == [
        ("DB", "个人", 50.0), ("DB", "班级平均", 60.0), ("OS", "班级平均", 60.0),
        ("数据结构..基础", "个人", 80.0), ("数据结构..基础", "班级平均", 0.0),
    ]
    assert rows(benchmarks.weak_subjects(home), "course_name") == [("DB",)]
    report = benchmarks.student_report(home).first()
    assert report.n_weak == 1 and "grades: DB 50.0, " in report.report and report.report.endswith("class mean: DB")


def test_five_numbers(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 4.0)], "k string, v double")
    got = {r.k: r for r in distribution.five_numbers(df, ["k"], "v").collect()}
    assert (got["a"].n, got["a"].mean, got["a"].q75, got["a"].q50) == (4, 4.0, 4.75, 2.5)
    assert (got["b"].min, got["b"].max) == (4.0, 4.0)


def gain_frame(spark):
    courses = ["B", "A", "D", "C"]
    rng = random.Random(5)
    data = [(f"s{i}", c, str(rng.randrange(40, 100))) for i in range(30) for c in courses if (i, c) != (7, "D")]
    data += [("s1", "A", "20"), ("s2", "Z", "50"), ("s3", "A", None)]
    return courses, data, spark.createDataFrame(data, "student_id string, course_name string, grade_text string")


def test_expected_gain_equals_boosting(spark):
    courses, data, df = gain_frame(spark)
    actual = {}
    for s, c, g in data:
        if c in courses and g is not None:
            actual.setdefault((s, c), []).append(float(g))
    actual = {k: sum(v) / len(v) for k, v in actual.items()}
    fitted = dict.fromkeys(courses, sum(actual.values()) / len(actual))
    for _ in range(100):
        for c in courses:
            left = [v - fitted[c] for (_, k), v in actual.items() if k == c]
            fitted[c] += 0.1 * sum(left) / len(left)
    got = value_added.expected_gain(df, courses).collect()
    assert len(got) == 29 * 4 and "s7" not in {r.student_id for r in got}
    for r in got:
        assert r.expected == pytest.approx(fitted[r.course_name], abs=1e-9)
        assert r.gain == pytest.approx(actual[r.student_id, r.course_name] - fitted[r.course_name], abs=1e-9)
    radar = value_added.gain_radar(value_added.expected_gain(df, courses))
    assert radar.count() == 3 * len(got) and {r.type for r in radar.collect()} == {"实际", "预测", "增值"}


def test_line_residuals(spark):
    courses, _, df = gain_frame(spark)
    by_student = {}
    for r in value_added.line_residuals(df, courses).collect():
        by_student.setdefault(r.student_id, {})[r.course_name] = r
    assert len(by_student) == 29
    for group in by_student.values():
        y = [group[c].actual for c in sorted(courses)]
        line = np.polyval(np.polyfit(range(4), y, 1), range(4))
        assert [group[c].residual for c in sorted(courses)] == pytest.approx(list(np.array(y) - line), abs=1e-9)
        assert sum(r.residual for r in group.values()) == pytest.approx(0, abs=1e-9)


def test_semester_residuals(spark):
    schema = "student_id string, academic_year string, semester string, credit_point double, credit double"
    data = [("s1", "2020", "1", 6.0, 2.0), ("s1", "2020", "2", 8.0, 2.0), ("s1", "2021", "1", 4.0, 2.0), ("s2", "2020", "1", 9.0, 3.0)]
    student = spark.createDataFrame([("s1", "c", None), ("s2", "c", "m")], "student_id string, class_id string, major string")
    got = value_added.semester_gpa_residuals(spark.createDataFrame(data, schema), student).collect()
    by_student = {}
    for r in sorted(got):
        by_student.setdefault(r.student_id, []).append(r)
    y = [3.0, 4.0, 2.0]
    line = np.polyval(np.polyfit(range(3), y, 1), range(3))
    assert [r.gpa_residual for r in by_student["s1"]] == pytest.approx(list(np.array(y) - line))
    assert [r.major_gpa_residual for r in by_student["s1"]] == pytest.approx([0, 0, 0])
    assert by_student["s2"][0].gpa_residual == 0


def test_bubbles(spark):
    points = spark.createDataFrame(
        [(1, "二叉树遍历算法与实现", "ch1", "DS"), (2, "栈", "ch1", "DS"), (3, "图", "ch2", "OS")],
        "kp_id long, kp_name string, chapter string, course string",
    )
    scores = spark.createDataFrame(
        [("a", 1, 60.0), ("a", 1, 60.0), ("b", 1, 60.0), ("b", 1, -1.0), ("a", 2, None), ("c", 3, 70.0), ("x", 3, 70.0)],
        "student_id string, kp_id long, score double",
    )
    student = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("c", None)], "student_id string, class_id string")
    counts = knowledge.bubble_counts(points, scores, student)
    assert rows(knowledge.bubble_labels(counts)) == [("二叉树遍...法与实现", 60.0, 3)]
    assert rows(knowledge.bubble_counts(points, scores, student, class_id="1")) == [("二叉树遍历算法与实现", 60.0, 2)]
    by = ["class_id"]
    assert rows(knowledge.bubble_counts(points, scores, student, course="DS", by=by)) == [
        ("c1", "二叉树遍历算法与实现", 60.0, 2), ("c2", "二叉树遍历算法与实现", 60.0, 1),
    ]


def test_mastery(spark):
    points = spark.createDataFrame([(1, "栈"), (2, "树"), (3, "图")], "kp_id long, kp_name string")
    scores = spark.createDataFrame(
        [("a", 1, "2020", 55.0), ("a", 1, "2021", 85.0), ("a", 2, "2020", 0.0), ("z", 1, "2020", 1.0)],
        "student_id string, kp_id long, year string, score double",
    )
    student = spark.createDataFrame([("a",)], "student_id string")
    stages = spark.createDataFrame(
        [(1, "2020", "阶段1线性"), (1, "2021", "阶段1线性"), (2, "2020", "阶段4期末"), (3, "2020", None)],
        "kp_id long, year string, stage string",
    )
    early = knowledge.mastery(student, scores, points, stages, "阶段2树图")
    assert rows(early, "id", "score") == [("1", 55.0), ("1", 55.0), ("1", 85.0), ("1", 85.0)]
    shown = knowledge.mastery_display(points, knowledge.mastery(student, scores, points, stages))
    assert sorted((r.id, r.student_id, r.band, r.shown) for r in shown.collect() if r.student_id) == [
        ("1", "a", "green", "85"), ("2", "a", "red", "未考查"),
    ]
    base = sorted((r.id, r.band) for r in shown.collect() if r.student_id is None)
    assert base == [("1", "grey"), ("2", "grey"), ("3", "grey")]
    assert rows(knowledge.stage_list(points.withColumn("course", F.lit("DS")), stages), "year").count(("2020",)) == 3


def test_graph(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 7)], "id long, name string")
    pairs = [(1, 2), (1, 2), (3, 2), (2, 4), (5, 5), (3, 9)]
    edges = spark.createDataFrame(pairs, "source long, target long")
    got = {r.id: (r.out_degree, r.in_degree) for r in graph.degrees(nodes, edges).collect()}
    assert got == {1: (1, 0), 2: (1, 2), 3: (2, 0), 4: (0, 1), 5: (1, 1), 6: (0, 0)}
    assert rows(graph.leaf_points(nodes, edges)) == [(1,)]
    assert sum(1 for r in graph.adjacency(edges).collect() if r.relation == "successor") == len(set(pairs))
    assert rows(graph.neighbourhood(edges).where("id = 2"), "other") == [(1,), (3,), (4,)]
    assert graph.neighbourhood(edges).where("id = 5").count() == 0
    names = spark.createDataFrame([("n3",), ("none",), ("n3",)], "name string")
    assert rows(graph.id_by_name(nodes, names)) == [("n3", 3)]
    points = nodes.select(F.col("id").alias("kp_id"), F.col("name").alias("kp_name"), F.when(F.col("id") < 4, "A").otherwise("B").alias("course"))
    valid = graph.valid_edges(points, edges)
    assert rows(valid) == [("A", 1, 2), ("A", 3, 2), ("B", 5, 5)]
    elements = rows(graph.elements(points, valid), "element")
    assert len(elements) == 9 and ('{"data":{"id":"1","name":"n1"}}',) in elements
    assert ('{"data":{"source":"3","target":"2"}}',) in elements


def test_prerequisite_sheet(spark):
    sheet = spark.createDataFrame(
        [
            (1, "ch1", "树", "栈", " ", "二叉树"), (2, "ch2", "图", "树", "栈", None), (3, "ch3", "树", "排序", None, None),
            (4, "ch4", "栈", None, None, None), (5, "ch5", " ", "x", None, None),
        ],
        "row_no int, chapter string, level1 string, pre1 string, pre2 string, sub1 string",
    )
    assert rows(graph.prereq_edges(sheet)) == [("二叉树", "树"), ("栈", "图"), ("栈", "树"), ("树", "图")]
    assert rows(graph.prereq_nodes(sheet)) == [("二叉树", "ch1"), ("图", "ch2"), ("栈", "ch1"), ("树", "ch1")]
    keyed = graph.assign_keys(graph.prereq_nodes(sheet).withColumn("course", F.lit("DS")))
    assert keyed.select("kp_id").distinct().count() == 4
    with pytest.raises(ValueError):
        graph.prereq_edges(sheet.drop("chapter"))
    assert rows(graph.prereq_edges(sheet.drop("sub1", "pre2"))) == [("栈", "树"), ("树", "图")]
    noted = sheet.withColumns({"subject": F.lit("math"), "prepared_by": F.lit("note")})
    assert rows(graph.prereq_edges(noted)) == rows(graph.prereq_edges(sheet))
    assert rows(graph.prereq_edges(sheet, cells=["pre2"])) == [("栈", "图")]


def test_prerequisite_sheet_from_a_file(spark, tmp_path):
    names = ["章节", "一级知识点", "前驱知识点1", "二级知识点1", "备注"]
    lines = [["ch1", "树", "栈", "二叉树", "n"], ["ch2", "图", "树", "栈", "n"], ["ch3", "树", "排序", "", "n"]]
    path = tmp_path / "sheet.csv"
    path.write_text("\n".join(",".join(line) for line in [names, *lines]), encoding="utf-8")
    sheet = graph.named_sheet(tables.read_sheet(spark, str(path), numbered=True))
    assert [r.chapter for r in sheet.orderBy("row_no").collect()] == ["ch1", "ch2", "ch3"]
    assert rows(graph.prereq_edges(sheet)) == [("二叉树", "树"), ("栈", "图"), ("栈", "树"), ("树", "图")]
    assert rows(graph.prereq_nodes(sheet)) == [("二叉树", "ch1"), ("图", "ch2"), ("栈", "ch1"), ("树", "ch1")]


def test_wide_sheet(spark):
    sheet = spark.createDataFrame([("s1", "80", None, "x"), ("s2", None, "90", "y")], "`学号` string, `1.1 栈` string, `树` string, `备注` string")
    points = spark.createDataFrame([(1, "1.1 栈"), (2, "树"), (3, "图")], "kp_id long, kp_name string")
    got = reshape.unpivot_scores(sheet.drop("备注").withColumn("其他", F.lit("1")), points, "2021", id_column="学号")
    assert got.count() == 2 * 2
    assert sorted(((r.student_id, r.kp_id, r.score) for r in got.collect()), key=str) == [
        ("s1", 1, 80.0), ("s1", 2, None), ("s2", 1, None), ("s2", 2, 90.0),
    ]


def test_scoring_sheet(spark):
    sheet = spark.createDataFrame(
        [(1, "实验1", "栈", "树"), (2, "期末考试", "栈", ""), (3, "其他", None, "图"), (4, "实验2", "none", "树")],
        "row_no int, scoring string, `知识点1` string, `知识点2` string",
    )
    points = spark.createDataFrame(
        [(1, "栈", None), (2, "树", "old"), (3, "图", None), (4, "串", "kept")], "kp_id long, kp_name string, scoring string"
    )
    cells = reshape.scoring_cells(sheet, points)
    first = reshape.stage_assignment(cells, "2021")
    assert sorted(first.collect(), key=str) == [
        (1, "2021", "实验1", "阶段1线性"), (2, "2021", "实验1", "阶段1线性"), (3, "2021", "其他", None),
    ]
    last = {r.kp_id: r.scoring for r in reshape.update_scoring(points, cells).collect()}
    assert last == {1: "期末考试", 2: "实验2", 3: "其他", 4: "kept"}
    existing = spark.createDataFrame(
        [(1, "2021", "a", "b"), (1, "2020", "a", "b")], "kp_id long, year string, scoring string, stage string"
    )
    merged = reshape.upsert(existing, first, ["kp_id", "year"])
    assert sorted((r.kp_id, r.year, r.scoring) for r in merged.collect()) == [
        (1, "2020", "a"), (1, "2021", "实验1"), (2, "2021", "实验1"), (3, "2021", "其他"),
    ]


def test_degree_audit(spark):
    data = [
        ("a", "OS", 1, "60", 5.0), ("a", "OS", 2, "优秀", 18.0), ("a", "DB", 1, "通过", None), ("a", "PE", 1, "90", 18.0),
        ("b", "PE", 1, "70", 3.0),
    ]
    df = spark.createDataFrame(data, "student_id string, course_name string, at int, grade_text string, credit_point double")
    required = spark.createDataFrame([("OS",), ("DB",), ("ML",), ("OS",)], "course_name string")
    taken = audit.taken_courses(df, ["at", "grade_text"])
    assert rows(audit.audit_scores(taken, required), "student_id", "course_name", "invalid") == [
        ("a", "DB", True), ("a", "OS", False),
    ]
    assert rows(audit.audit_totals(taken, required)) == [("a", 18.0, "OS"), ("b", 0.0, "")]
    missing = [("a", "ML"), ("b", "DB"), ("b", "ML"), ("b", "OS")]
    assert rows(audit.audit_missing(taken, required)) == missing
    for shares in (1, 2, 9):
        assert rows(audit.audit_missing(taken, required, shares)) == missing
