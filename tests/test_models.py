"""Row sampling, models of all rows, saved models and folds trained at the same time."""

import os

import pytest
from pyspark.sql import functions as F

from gradeloom.ml import models, store, training
from test_training import ROLES, enrollments


@pytest.fixture(scope="module")
def rows(spark):
    return models.prepared(training.training_set(enrollments(spark)[1], ROLES))


def test_shares_divide_the_weight_evenly(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 5), ("c", 8), ("d", 700), ("e", 10**9)], "k string, weight long")
    got = models.row_shares(frame, 8).groupBy("k").agg(
        F.sum("weight").alias("s"), F.count("*").alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi")
    )
    assert {tuple(r) for r in got.collect()} == {
        ("a", 1, 1, 1, 1), ("b", 5, 5, 1, 1), ("c", 8, 8, 1, 1), ("d", 700, 8, 87, 88), ("e", 10**9, 8, 125000000, 125000000),
    }
    assert models.row_shares(frame.limit(0)).collect() == []


def test_each_round_samples_four_fifths_of_a_tuples_rows(spark):
    tuples = [(float(50 + i), float(40 + i), float(45 + i), float(60 + i), 700, "train") for i in range(10)]
    frame = spark.createDataFrame(tuples, "base double, advanced double, structures double, target double, weight long, part string")
    model = models.train(models.materialise(frame), "boosted", rounds=12, depth=2).stages[-1]
    taken = [tree._call_java("rootNode").impurityStats().count() for tree in model.trees]
    assert len(set(taken)) > 6  # anew in every round
    # 2,560 shares of 2 or 3 rows: the deviation of the rows taken is 55.
    assert all(abs(n - 5600) < 5 * 56 for n in taken) and abs(sum(taken) / len(taken) - 5600) < 80


def _graded(spark, n, weight):
    grades = [(float(50 + i % 5), float(40 + i % 7), float(i % 11), weight) for i in range(n)]
    return spark.createDataFrame(grades, "x double, z double, y double, weight long").coalesce(1)


def test_many_shares_are_boosted_by_many_tasks(spark):
    frame = _graded(spark, 40, 100)
    few = models.boosting_rows(frame, ["x", "z"], "y")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 4000  # what one task can take stays as it was
    many = models.boosting_rows(frame, ["x", "z"], "y", most=10_000, task=500)
    assert many.rdd.getNumPartitions() == 8 and many.count() == 4000
    fewer = models.boosting_rows(frame, ["x", "z"], "y", most=400, task=50)
    assert fewer.rdd.getNumPartitions() == 8 and fewer.count() == 400
    for got in (few, many, fewer):
        kept = got.groupBy("x", "z", "y").agg(F.sum("weight").alias("weight"))
        want = frame.groupBy("x", "z", "y").agg(F.sum("weight").alias("weight"))
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))


def test_tuples_of_equal_features_give_the_same_trees_as_one(spark):
    frame = _graded(spark, 385, 3)
    merged = models.boosting_rows(frame, ["x", "z"], "y", most=100, task=50)
    assert merged.agg(F.sum("weight"), F.count("*")).first() == (385 * 3, 70)
    assert [r.y for r in merged.collect()] == pytest.approx([5.0] * 70)


def test_fit_on_all_rows(rows):
    part, whole = (models.train(rows, "raw", on) for on in ("train", "all"))
    mean = lambda r: r.agg(F.sum(F.col("structures") * F.col("weight")) / F.sum("weight")).first()[0]
    assert part.stages[-1].intercept == pytest.approx(mean(models.train_part(rows)))
    assert whole.stages[-1].intercept == pytest.approx(mean(rows))
    with pytest.raises(ValueError):
        models.train(rows, "raw", "some")
    boosted = models.train(rows, "boosted", "all", rounds=2, depth=2)
    assert sum(r.importance for r in models.importances(boosted, rows).collect()) == pytest.approx(1)


def test_a_saved_model_is_found_by_its_rows(spark, rows, tmp_path, monkeypatch):
    folder = str(tmp_path)
    first = store.stored(rows, "raw", folder=folder)
    score = lambda model: sorted(tuple(r) for r in models.predict(model, rows).collect())
    assert score(first) == score(models.train(rows, "raw"))
    trained = []
    train = models.train
    monkeypatch.setattr(models, "train", lambda *a, **b: trained.append(a[1:]) or train(*a, **b))
    again = store.stored(rows.repartition(7).select(*reversed(rows.columns)), "raw", folder=folder)
    assert trained == [] and score(again) == score(first)
    store.stored(rows, "raw", "all", folder=folder)
    store.stored(rows, "raw", folder=folder, alpha=0.5)
    store.stored(rows.limit(20), "raw", folder=folder)
    assert len(trained) == 3 and len(os.listdir(f"{folder}/models")) == 4


def test_a_failed_training_leaves_no_model(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "train", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.stored(rows, "raw", folder=str(tmp_path))
    assert not os.path.exists(store.path_of(rows, "raw", folder=str(tmp_path)))


def test_folds_at_once_give_the_folds_in_turn(spark):
    folded = models.shuffled_folds(training.training_set(enrollments(spark)[1], ROLES))
    kept = models.materialise(training.grade_tuples(folded, ["fold"]))
    steps = models.q75_steps(kept)
    options = {"rounds": 3, "depth": 2}
    turn = models.cross_validate(kept, 5, steps, "boosted_trees", **options).collect()
    once = models.cross_validate(kept, 5, steps, "boosted_trees", at_once=5, **options).collect()
    assert turn == once and [r.fold for r in once] == list(range(5)) and all(r.r2 <= 1 for r in once)
    clustered = models.cross_validate(kept, 5, models.clustered_steps, "elastic_net", alpha=0.001).collect()
    assert len(clustered) == 5 and all(r.r2 is not None for r in clustered)
    # A model that saw the fold fits it better than one that did not.
    seen = models.fit(kept, steps, "boosted_trees", rounds=30)
    best = {r.fold: r.r2 for r in models.metrics(models.predict(seen, kept), by=["fold"]).collect()}
    unseen = models.cross_validate(kept, 5, steps, "boosted_trees", at_once=5, rounds=30).collect()
    assert sum(best[r.fold] - r.r2 for r in unseen) > 0
