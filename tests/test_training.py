import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.ml import models, training
from gradeloom.session import shared_folder
from gradeloom.sources import sinks, tables

ROLES = {"base": ("P1", "2021"), "advanced": ("P2", "2021"), "structures": ("DS", "2022"), "target": ("OS", "2023")}


def enrollments(spark):
    data = []
    for i in range(80):
        r = random.Random(i)
        skill = r.randrange(50, 95)
        for role, course in (("base", "P1"), ("advanced", "P2"), ("structures", "DS"), ("target", "OS2")):
            year = ROLES[role][1]
            for _ in range(2 if i % 9 == 0 else 1):
                if not (role == "target" and i % 7 == 0) and not (role == "base" and i % 11 == 0):
                    data.append((f"s{i}", course, year, str(min(100, skill + r.randrange(10)))))
    data.append(("s1", "P1", "2020", "1"))
    data.append(("s2", "DS", "2022", None))
    return data, spark.createDataFrame(data, "student_id string, course_name string, academic_year string, grade_text string")


def joined(data):
    def part(course, year):
        return [(s, None if g is None else float(g)) for s, c, y, g in data if c.startswith(course) and y == year]

    result = []
    target = part("OS", "2023")
    for s, b in part("P1", "2021"):
        for a in (v for k, v in part("P2", "2021") if k == s):
            for d in (v for k, v in part("DS", "2022") if k == s):
                for t in [v for k, v in target if k == s] or [0.0]:
                    if d is not None:
                        result.append((s, b, a, d, t))
    return sorted(result)


def test_training_set_equals_the_joins(spark):
    data, df = enrollments(spark)
    built = training.training_set(df, ROLES)
    assert sorted(map(tuple, training.expand(built).collect())) == joined(data)
    kept = training.training_set(df, ROLES, impute_zero=False)
    with_target = {s for s, c, _, _ in data if c == "OS2"}
    assert {r.student_id for r in kept.collect()} == {r[0] for r in joined(data)} & with_target


def test_expand_in_runs(spark, monkeypatch):
    monkeypatch.setattr(training, "COPY_RUN", 4)
    frame = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9)], "student_id string, weight long")
    got = training.expand(frame).groupBy("student_id").count().collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 4), ("c", 9)]


def test_statistics(spark):
    data, df = enrollments(spark)
    built = training.training_set(df, ROLES)
    matrix = np.array([r[1:] for r in joined(data)])
    for i, r in enumerate(sorted(training.describe(built).collect(), key=lambda r: training.GRADES.index(r.column))):
        x = matrix[:, i]
        expected = [len(x), x.mean(), x.std(ddof=1), x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max()]
        assert list(r)[1:] == pytest.approx(expected)
    expected = np.corrcoef(matrix.T)
    for r in training.correlations(built).collect():
        assert r.r == pytest.approx(expected[training.GRADES.index(r.a), training.GRADES.index(r.b)])


def test_features(spark):
    data, df = enrollments(spark)
    matrix = np.array([r[1:] for r in joined(data)])
    cut = np.quantile(matrix[:, 0], 0.75)
    for r in training.interactions(training.stretch_q75(training.training_set(df, ROLES))).collect():
        adjusted = cut + math.sqrt(r.base - cut) if r.base >= cut else r.base
        assert r.base_adj == pytest.approx(adjusted)
        assert r.base_x_advanced == pytest.approx(r.base_adj * r.advanced_adj)
    frame = spark.createDataFrame([("a", 60.0, 99.0, 1)], "student_id string, base double, advanced double, weight long")
    row = training.engineered(frame).first()
    assert (row.advanced_adj, row.base_x_advanced, row.base_bin_0, row.base_bin_1) == (97.0, 5820.0, 1.0, 0.0)


def test_scaling_uses_population_moments(spark):
    frame = spark.createDataFrame([(1.0, 7.0, 2), (4.0, 7.0, 1)], "x double, k double, weight long")
    got = training.standardise(frame, frame, ["x", "k"]).collect()
    x = np.array([1.0, 1.0, 4.0])
    assert [r.x_z for r in got] == pytest.approx([(v - x.mean()) / x.std() for v in (1.0, 4.0)])
    assert [r.k_z for r in got] == [0, 0]


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("student_id"), F.lit(1).alias("weight"))
    first = training.split(ids.repartition(1)).orderBy("student_id").collect()
    second = training.split(ids.repartition(9)).orderBy("student_id").collect()
    assert first == second
    share = sum(r.part == "test" for r in first) / len(first)
    assert 0.15 < share < 0.25


def test_folds_of_the_train_part_are_even(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("student_id"), F.lit(1).alias("weight"))
    train = models.shuffled_folds(training.split(ids)).where("part = 'train'")
    counts = {r.fold: r["count"] for r in train.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2, 3, 4} and max(counts.values()) < 1.3 * min(counts.values())


def coordinate_descent(x, y, alpha, ratio, rounds=20_000):
    x, y = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (x[:, j] @ x[:, j] / len(y) + alpha * (1 - ratio))
        if np.abs(w - old).max() < 1e-13:
            break
    return w


def test_elastic_net_minimises_the_stated_objective(spark):
    data, df = enrollments(spark)
    rows = training.grade_tuples(training.training_set(df, ROLES))
    model = models.fit(rows, models.raw_steps, "elastic_net", alpha=0.1)
    matrix = np.array([r[1:] for r in joined(data)])
    x = (matrix[:, :2] - matrix[:, :2].mean(0)) / matrix[:, :2].std(0)
    expected = coordinate_descent(x, matrix[:, 2], 0.1, 0.5)
    assert list(model.stages[-1].coefficients) == pytest.approx(list(expected), abs=1e-6)
    assert model.stages[-1].intercept == pytest.approx(matrix[:, 2].mean(), abs=1e-6)


def test_metrics_and_histogram(spark):
    frame = spark.createDataFrame(
        [(3.0, 2.0, 2, 1.0), (5.0, 5.5, 1, -0.5)], "actual double, predicted double, weight long, residual double"
    )
    row = models.metrics(frame, by=()).first()
    y, p = np.array([3, 3, 5.0]), np.array([2, 2, 5.5])
    assert row.mse == pytest.approx(((y - p) ** 2).mean())
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    values = [0.0, 0.5, 1.0, 9.9, 10.0, 10.0]
    scored = spark.createDataFrame([(v, 1) for v in values], "residual double, weight long")
    got = {r.bin: r.n for r in models.histogram(scored).collect()}
    counts = np.histogram(values, bins=20)[0]
    assert got == {i + 1: n for i, n in enumerate(counts) if n}
    same = spark.createDataFrame([(2.0, 3)], "residual double, weight long")
    assert [tuple(r) for r in models.histogram(same).collect()] == [(1, 3)]


def test_contiguous_folds(spark):
    rows = spark.createDataFrame([(f"s{i:02d}", 1) for i in range(13)], "student_id string, weight long")
    got = [r.fold for r in models.contiguous_folds(rows.repartition(5)).orderBy("student_id").collect()]
    assert got == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2


def test_pipelines_save_load_and_score(spark, tmp_path):
    _, df = enrollments(spark)
    rows = models.prepared(training.training_set(df, ROLES))
    train = rows.where("part = 'train'")
    for steps in (models.clustered_steps, models.engineered_steps):
        model = models.fit(train, steps, "elastic_net", alpha=0.001)
        assert {r.part for r in models.metrics(models.predict(model, rows)).collect()} == {"train", "test"}
    model = models.fit(train, models.q75_steps(rows), "boosted_trees", rounds=3, depth=2)
    importances = models.importances(model, rows).collect()
    assert len(importances) == 5 and sum(r.importance for r in importances) == pytest.approx(1)
    assert importances == sorted(importances, key=lambda r: -r.importance)
    path = str(tmp_path / "model")
    models.save(model, path)
    fresh = rows.drop("target")
    first = models.predict(model, fresh).select(*fresh.columns, "predicted")
    second = models.predict(models.load(path), fresh).select(*fresh.columns, "predicted")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    assert all(r.predicted is not None for r in first.collect())


def test_cross_validation(spark):
    _, df = enrollments(spark)
    folded = models.shuffled_folds(training.training_set(df, ROLES))
    got = models.cross_validate(folded, 5, models.raw_steps, "elastic_net", alpha=0.1).collect()
    assert [r.fold for r in got] == [0, 1, 2, 3, 4] and all(r.r2 is not None and r.r2 <= 1 for r in got)
    rows = models.materialise(folded)
    got = models.cross_validate(rows, 2, models.q75_steps(rows), "boosted_trees", rounds=2, depth=2).collect()
    assert len(got) == 2 and all(r.r2 is not None for r in got)


def test_clusters_are_ordered_and_stable(spark):
    values = [(float(v), 1) for v in (50, 51, 52, 70, 71, 72, 73, 95, 96)]
    frame = spark.createDataFrame(values, "advanced_adj double, weight long")
    first = models.cluster_centres(frame.repartition(1), "advanced_adj")
    second = models.cluster_centres(frame.repartition(6), "advanced_adj")
    assert first == second == pytest.approx([51, 71.5, 95.5])


def test_sinks_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("张三", 1.5, "A"), ("b,\"c", None, "B")], "name string, v double, course string")
    sheet = str(tmp_path / "sheet")
    sinks.write_sheet(frame, sheet)
    assert sorted(tables.read_sheet(spark, sheet, "name string, v double, course string").collect(), key=str) == sorted(frame.collect(), key=str)
    assert [t for _, t in tables.read_sheet(spark, sheet).dtypes] == ["string"] * 3
    table = str(tmp_path / "table")
    sinks.append_rows(frame, table)
    sinks.append_rows(frame, table)
    assert tables.read_table(spark, table).count() == 4
    records = str(tmp_path / "json")
    sinks.write_json(frame, records)
    assert spark.read.json(records).count() == 2
    assert frame.select(sinks.json_record("name", "v").alias("j")).collect()[1].j == '{"name":"b,\\"c"}'


def test_a_cluster_must_name_its_shared_folder(tmp_path):
    class Context:
        master = "spark://host:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "s3a://bucket/steps"}
    assert shared_folder(Session) == Session.sparkContext.folder == "s3a://bucket/steps"


def test_replacing_one_course_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "points")
    sinks.replace_courses(spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "kp_id long, course string"), path)
    sinks.replace_courses(spark.createDataFrame([(9, "A")], "kp_id long, course string"), path)
    assert sorted((r.kp_id, r.course) for r in spark.read.parquet(path).collect()) == [(2, "B"), (9, "A")]


def test_an_emptied_course_loses_its_rows(spark, tmp_path):
    for name in ("nodes", "edges"):
        path = str(tmp_path / name)
        table = spark.createDataFrame([(1, "A"), (2, "B/1"), (3, "A")], "kp_id long, course string")
        sinks.replace_courses(table, path)
        sinks.replace_courses(table.limit(0), path, courses=["A", "none"])
        assert [(r.kp_id, r.course) for r in spark.read.parquet(path).collect()] == [(2, "B/1")]
        sinks.replace_courses(spark.createDataFrame([(5, "A")], table.schema), path, courses=["A", "B/1"])
        assert [(r.kp_id, r.course) for r in spark.read.parquet(path).collect()] == [(5, "A")]


def test_upsert_into_the_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "points")
    schema = "kp_id long, score double, course string"
    sinks.replace_courses(spark.createDataFrame([(1, 1.0, "A"), (2, 2.0, "A"), (3, 3.0, "B")], schema), path)
    stored = spark.read.schema(schema).parquet(path)
    changed = stored.where("kp_id = 2").selectExpr("kp_id", "score + 10 AS score", "course")
    sinks.upsert_courses(changed.unionByName(spark.createDataFrame([(4, 4.0, "A")], schema)), path, ["kp_id", "course"])
    assert sorted((r.kp_id, r.score, r.course) for r in spark.read.parquet(path).collect()) == [
        (1, 1.0, "A"), (2, 12.0, "A"), (3, 3.0, "B"), (4, 4.0, "A"),
    ]


def test_role_names_have_no_wildcards(spark):
    data = [("s", "C_1", "70", "2021"), ("s", "CX1", "10", "2021"), ("s", "T_a", "80", "2022"), ("s", "TXa", "20", "2022")]
    frame = spark.createDataFrame(data, "student_id string, course_name string, grade_text string, academic_year string")
    found = training.training_set(frame, {"base": ("C_1", "2021"), "target": ("T_", "2022")}).collect()
    assert [(r.base, r.target) for r in found] == [(70.0, 80.0)]


def test_named_binds(spark):
    frame = spark.createDataFrame([("a", 1), ("b'--", 2)], "code string, n int")
    got = tables.query(spark, "SELECT n FROM {t} WHERE code = :code", {"t": frame}, code="b'--")
    assert [r.n for r in got.collect()] == [2]
