"""Sheets from a file to a table, grades kept apart, and moments of columns far from zero."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.ml import training
from gradeloom.operators import quarantine
from gradeloom.plans import ingest
from gradeloom.sources.committed import read_committed


def stored(spark, store, table):
    return sorted(map(tuple, read_committed(spark, store, table).collect()), key=str)


@pytest.fixture
def points(spark):
    names = [(1, "链表"), (2, "树.二叉"), (3, "图"), (4, "排序`快")]
    return spark.createDataFrame(names, "kp_id long, kp_name string")


@pytest.fixture
def write(tmp_path):
    def write(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_scores(spark, tmp_path, points, write):
    file = write("scores.csv", "姓名,学号,链表,树.二叉,别的,排序`快", "甲,s1,90,,7,8.5", "乙,s2,缺考,60,x, 70 ", "丙,,1,2,3,4", "丁,s4,5", '"戊, 己",s5,1e2,-1,"a,b",85分', "庚,s6,1,2,3,4,5")
    store = str(tmp_path / "store")
    assert ingest.scores(spark, file, points, store, "2023") == 1
    assert stored(spark, store, "student_knowledge") == sorted([
        ("s1", 1, "2023", 90.0), ("s1", 2, "2023", None), ("s1", 4, "2023", 8.5), ("s2", 2, "2023", 60.0), ("s2", 4, "2023", 70.0),
        ("s5", 1, "2023", 100.0), ("s5", 2, "2023", -1.0),
    ], key=str)
    assert {r[1:] for r in stored(spark, store, "rejected")} == {
        (None, "丁,s4,5", "number of cells"), (None, "庚,s6,1,2,3,4,5", "number of cells"), ("s2 链表", "缺考", "no number"),
        ("s5 排序`快", "85分", "no number"), ("链表", "1", "no student"), ("树.二叉", "2", "no student"), ("排序`快", "4", "no student"),
    }
    # Another sheet is added, of the same year or another one.
    again = write("more.csv", "学号,图", "s9,3")
    ingest.scores(spark, again, points, store, "2023")
    ingest.scores(spark, again, points, store, "2024")
    rows = stored(spark, store, "student_knowledge")
    assert len(rows) == 9 and ("s9", 3, "2023", 3.0) in rows and ("s9", 3, "2024", 3.0) in rows


def test_a_sheet_of_no_rows_or_points(spark, tmp_path, points, write):
    store = str(tmp_path / "store")
    ingest.scores(spark, write("none.csv", "学号,链表"), points, store, "2023")
    ingest.scores(spark, write("other.csv", "学号,什么", "s1,3"), points, store, "2023")
    assert stored(spark, store, "student_knowledge") == stored(spark, store, "rejected") == []
    ingest.stages(spark, write("stages.csv", "环节,列", "作业,链表"), points, store, "2023")
    assert stored(spark, store, "stage_pre_year") == []


def test_stages(spark, tmp_path, points, write):
    file = write("stages.csv", "考核,知识点A,备注,第2知识点", "作业1线性,链表,,树.二叉", "实验2,图,r,链表", "其他,不存在,,", "期末考试,图,,树.二叉", "坏行,链表")
    store = str(tmp_path / "store")
    ingest.stages(spark, file, points, store, "2023")
    first = {r[0]: r[2] for r in stored(spark, store, "stage_pre_year")}
    assert first == {1: "作业1线性", 2: "作业1线性", 3: "实验2"}
    assert {r[1:] for r in stored(spark, store, "rejected")} == {("其他", "不存在", "no such point"), (None, "坏行,链表", "number of cells")}
    # A later sheet replaces the points it names; another year is another row.
    ingest.stages(spark, write("later.csv", "环节,知识点", "阶段考试,链表"), points, store, "2023")
    ingest.stages(spark, write("later.csv", "环节,知识点", "实验1,链表"), points, store, "2024")
    rows = {(r[0], r[1]): r[2] for r in stored(spark, store, "stage_pre_year")}
    assert rows == {(1, "2023"): "阶段考试", (2, "2023"): "作业1线性", (3, "2023"): "实验2", (1, "2024"): "实验1"}


def test_prerequisites(spark, tmp_path, write):
    file = write("graph.csv", "章节,一级知识点,前驱知识点1,前驱知识点2,二级知识点1", "一,树,表, ,叉", "二,图,树,表,", "三,,x,,")
    store = str(tmp_path / "store")
    ingest.prerequisites(spark, file, "数据结构", store)
    names = {r[0]: r[1] for r in stored(spark, store, "points")}
    chapters = {r[1]: r[2] for r in stored(spark, store, "points")}
    assert chapters == {"树": "一", "表": "一", "叉": "一", "图": "二"}
    edges = {(names[r[0]], names[r[1]]) for r in stored(spark, store, "edges")}
    assert edges == {("表", "树"), ("叉", "树"), ("树", "图"), ("表", "图")}
    assert [r[1:] for r in stored(spark, store, "rejected")] == [("三", None, "no point")]
    ingest.prerequisites(spark, write("other.csv", "章节,一级知识点", "一,栈"), "算法", store)
    ingest.prerequisites(spark, write("new.csv", "章节,一级知识点", "九,树"), "数据结构", store)
    assert {(r[1], r[2], r[3]) for r in stored(spark, store, "points")} == {("栈", "一", "算法"), ("树", "九", "数据结构")}
    assert stored(spark, store, "edges") == []
    with pytest.raises(ValueError, match="lacks"):
        ingest.prerequisites(spark, write("bad.csv", "章节,别的", "一,树"), "数据结构", store)
    assert len(stored(spark, store, "points")) == 2


@pytest.mark.parametrize("scale,reasons", [
    ("a", [None, "no number", None, None, "no number", "text after the number", "text after the number", "missing", "out of range", None, "no number", "out of range", "no number"]),
    ("b", [None, None, "no number", None, None, "text after the number", "text after the number", "missing", "out of range", None, "no number", "out of range", "no number"]),
])
def test_quarantine(spark, tmp_path, scale, reasons):
    grades = ["及格", "优", "优秀", "87.5", "缓考", "85分", "85d", None, "101", " 1e2 ", "nan", "-1", ""]
    rows = spark.createDataFrame([(i, g, "clash") for i, g in enumerate(grades)], "id long, grade_text string, x string")
    got = quarantine.judged(rows, scale).orderBy("id").collect()
    assert [r.reason for r in got] == reasons
    counts = quarantine.set_apart(quarantine.judged(rows, scale), str(tmp_path / "store"), "grades")
    for status in ("good", "bad"):
        part = read_committed(spark, str(tmp_path / "store"), "grades", [status])
        assert sorted(r.id for r in part.collect()) == [i for i, r in enumerate(reasons) if (r is None) == (status == "good")]
    assert counts == {"good": reasons.count(None)} | {r: reasons.count(r) for r in quarantine.REASONS}


def test_quarantine_does_not_shuffle_the_rows(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 3 != 0, "60").otherwise("x").alias("grade_text"))
    counts = quarantine.set_apart(quarantine.judged(rows, "b"), str(tmp_path / "store"), "grades")
    assert counts["good"] == 666 and counts["no number"] == 334
    files = read_committed(spark, str(tmp_path / "store"), "grades", ["bad"]).inputFiles()
    assert len(files) == 3  # one of every task; a shuffle made one of them all


def test_quarantine_joins_the_enrolments_once(spark, monkeypatch):
    from gradeloom.plans import catalog

    read, table = [], catalog.src.table
    monkeypatch.setattr(catalog.src, "table", lambda *a: read.append(a[-1]) or table(*a))
    written = []
    monkeypatch.setattr(catalog.quarantine, "set_apart", lambda rows, path, name: written.append(rows.inputFiles()) or commit_none(rows, path, name))

    def commit_none(rows, path, name):
        catalog.committed.commit(spark, path, {name: catalog.committed.Change(rows.withColumn("status", F.lit("good")), "status")})

    catalog.grade_quarantine(spark, "/root/testdata/sf0.001").collect()
    assert len(written) == 3 and all("lineitem" not in f for files in written for f in files)


def test_moments_far_from_zero(spark):
    values = [(1e8 + d, 5.0, 3 * d + e, n) for d, e, n in ((-0.01, 0.0, 3), (0.01, 0.002, 2), (0.0, -0.001, 1))]
    frame = spark.createDataFrame([(*v, 0.1 + 0.2) for v in values], "x double, k double, y double, weight long, c double")
    whole = np.repeat(np.array([v[:3] for v in values]), [v[3] for v in values], axis=0)
    row = training.scaling(frame, ["x", "k", "y", "c"]).first()
    assert [row.x_std, row.y_std] == pytest.approx([whole[:, 0].std(), whole[:, 2].std()], rel=1e-6)
    assert row.k_std == row.c_std == 1.0 and row.x_mean == pytest.approx(whole[:, 0].mean(), abs=1e-7)
    renamed = frame.select(F.col("x").alias("base"), F.col("y").alias("advanced"), F.col("k").alias("structures"), "weight")
    got = {(r.a, r.b): r.r for r in training.correlations(renamed, ["base", "advanced", "structures"]).collect()}
    assert got["base", "advanced"] == pytest.approx(np.corrcoef(whole[:, 0], whole[:, 2])[0, 1], rel=1e-6)
    assert got["base", "base"] == pytest.approx(1) and got["base", "structures"] is None
