import pytest
from pyspark.sql import functions as F

from gradeloom.functions import grades, predicates, text

TEXTS = [
    "优秀", "优", "良好", "中等", "中", "及格", "通过", "不及格", "缓考",
    "87.5", "86.5", "85分", "85d", "1e2", "nan", "", " 85 ", None,
]


def evaluate(spark, values, expression, type_="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {type_}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_scale_a(spark):
    expected = [95, 0, 85, 75, 0, 60, 100, 0, 0, 88, 87, 85, 85, 100, 0, 0, 85, None]
    assert evaluate(spark, TEXTS, grades.scale_a) == expected
    assert evaluate(spark, ["1e12", "99999999999", "-1e300"], grades.scale_a) == [None] * 3


def test_scale_b(spark):
    expected = [
        None, 95, None, None, 75, 65, None, 0, 0, 87.5, 86.5, None, None, 100, None, None, 85, None,
    ]
    assert evaluate(spark, TEXTS, grades.scale_b) == expected


def test_scale_c(spark):
    expected = [
        95, None, 85, 75, None, 65, None, None, None, 87.5, 86.5, None, None, 100, None, None, 85, None,
    ]
    assert evaluate(spark, TEXTS, grades.scale_c) == expected


def test_exam_flag(spark):
    values = ["优", "80", "缓考"]
    assert evaluate(spark, values, lambda g: grades.violin_score(g, "1")) == [None, 80, None]
    assert evaluate(spark, values, lambda g: grades.violin_score(g, "0")) == [95, 80, 0]


def test_stage(spark):
    values = ["实验2", "作业2树图", "作业3查找排序", "期末考试", "其他", None]
    expected = ["阶段1线性", "阶段2树图", "阶段3查找排序", "阶段4期末", None, None]
    assert evaluate(spark, values, grades.stage_of) == expected


def test_bins(spark):
    values = [0.0, 60.0, 60.5, 75.0, 90.0, 100.0, 101.0, None]
    assert evaluate(spark, values, grades.score_bin, "double") == [None, "差", "中", "中", "良", "优", None, None]
    flag = lambda s: grades.indicator(grades.score_bin(s), "中")
    assert evaluate(spark, values, flag, "double") == [0, 0, 1, 1, 0, 0, 0, 0]


def test_stretch(spark):
    assert evaluate(spark, [94.0, 95.0, 99.0], lambda s: grades.stretch_above(s, 95.0), "double") == [94, 95, 97]


def test_names_and_labels(spark):
    assert evaluate(spark, ["李", "张三", "欧阳娜", "Bo", ""], text.mask_name)[:4] == ["李", "张*", "欧**", "B*"]
    labels = ["12345678", "123456789", "1234xx89", "数据结构与算法基础"]
    assert evaluate(spark, labels, text.short_subject) == ["12345678", "1234..89", "1234xx89", "数据结构..基础"]
    assert evaluate(spark, labels, text.short_point)[1] == "1234...6789"
    assert evaluate(spark, ["12345", "123456"], text.short_node) == ["12345", "12345..."]


def test_bands(spark):
    scores = [0.0, 59.0, 60.0, 79.0, 80.0, 99.0, 100.0, -1.0, None]
    bands = ["red", "red", "blue", "blue", "green", "green", "gold", "grey", "grey"]
    assert evaluate(spark, scores, text.mastery_band, "double") == bands
    colours = evaluate(spark, scores, text.mastery_colour, "double")
    assert colours[1] == "rgb(196, 59, 59)"
    assert colours[2] == "rgb(60, 60, 255)"
    assert colours[5] == "rgb(99, 255, 99)"
    gradients = evaluate(spark, scores, text.mastery_gradient, "double")
    assert gradients[6] == "linear-gradient(to bottom right, gold, white)"
    assert gradients[8] == "linear-gradient(to bottom right, #9999, black)"
    shown = evaluate(spark, scores, text.shown_score, "double")
    assert shown[0] == shown[8] == "未考查" and shown[6] == "100"


@pytest.mark.parametrize(
    "pattern, expected",
    [("%", [1, 1, 1, 1, 0]), ("b", [1, 0, 0, 0, 0]), ("a\\x", [0, 0, 1, 0, 0]), ("\\%", [0, 0, 0, 1, 0]), ("_b_", [1, 0, 0, 0, 0])],
)
def test_contains(spark, pattern, expected):
    values = ["abc", "x", "a\\x", "5%", None]
    hits = evaluate(spark, values, lambda c: F.coalesce(predicates.contains(c, pattern), F.lit(False)).cast("int"))
    assert hits == expected


def test_exam_nature(spark):
    values = ["正常考试", "补考", None]
    hit = lambda flag: evaluate(spark, values, lambda c: predicates.exam_nature(c, flag))
    assert [bool(x) for x in hit("0")] == [True, True, False]
    assert [bool(x) for x in hit("1")] == [True, False, False]
    assert [bool(x) for x in hit("补%")] == [False, True, False]


def test_blank_cells(spark):
    values = ["a", " ", "", None]
    assert evaluate(spark, values, predicates.not_blank) == [True, False, True, False]
    assert evaluate(spark, values, predicates.filled) == [True, True, False, False]
