"""Grade prediction with MLlib: fits, metrics, cross-validation, scoring.

Feature engineering and scaling are SQL steps of the pipeline, so one saved
artefact scores raw grades. Constants in those steps are fitted on the train
part by one aggregate each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Row, functions as F

from ..functions.grades import BIN_EDGES
from ..operators.ordering import number_rows
from ..session import materialise, shared_folder
from .training import FEATURES, GRADES, WEIGHT, fold, grade_tuples, scaling, split

CLUSTERS = 3
#: Rows that a grade tuple is split into at most where rows are sampled.
SHARES = 256
#: Rows that all tuples are split into at most, if there are fewer tuples than that, and rows of a boosting task.
SHARED_ROWS = 500_000
TASK_ROWS = 50_000

# From the train part to pipeline steps, feature names and label.
Steps = Callable[[DataFrame], tuple[list, list[str], str]]


def prepared(training: DataFrame, seed: int = 42) -> DataFrame:
    """Grade tuples by train/test part, cut from their lineage for the fits."""
    return materialise(grade_tuples(split(training, seed), ["part"]))


def _step(*expressions: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")


def _number(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def _stretch(column: str, top: float) -> str:
    t = _number(top)
    return f"CASE WHEN {column} >= {t} THEN {t} + sqrt({column} - {t}) ELSE {column} END AS {column}_adj"


def raw_steps(train: DataFrame) -> tuple[list, list[str], str]:
    """The two raw features; the label is the structures grade."""
    return [], ["base", "advanced"], "structures"


def q75_steps(rows: DataFrame) -> Steps:
    """Grades stretched at their quantile, product and difference.

    The quantiles are of ``rows``: all rows by default practice, or only the
    train part to keep the test part out of the features.
    """
    cuts = rows.agg(*(F.percentile(c, 0.75, F.col(WEIGHT)).alias(c) for c in GRADES)).first()
    stages = [
        _step(*(_stretch(c, cuts[c]) for c in FEATURES)),
        _step("base_adj * advanced_adj AS base_x_advanced", "structures_adj - base_adj AS structures_minus_base"),
        _step(_stretch("target", cuts["target"])),
    ]
    names = [*(f"{c}_adj" for c in FEATURES), "base_x_advanced", "structures_minus_base"]
    return lambda train: (stages, names, "target_adj")


def engineered_steps(train: DataFrame) -> tuple[list, list[str], str]:
    """Fixed-ceiling features with one indicator per bin of the base grade."""
    bins = list(zip(BIN_EDGES, BIN_EDGES[1:]))
    flags = [
        f"CASE WHEN base > {low} AND base <= {high} THEN 1.0D ELSE 0.0D END AS base_bin_{i}"
        for i, (low, high) in enumerate(bins)
    ]
    steps = [_step(_stretch("advanced", 95.0)), _step("base * advanced_adj AS base_x_advanced", *flags)]
    names = ["base", "advanced_adj", "base_x_advanced", *(f"base_bin_{i}" for i in range(len(bins)))]
    return steps, names, "structures"


def cluster_centres(train: DataFrame, column: str, k: int = CLUSTERS, seed: int = 42) -> list[float]:
    """Centres of a k-means over one column, ascending."""
    # Distinct values in order: the seeded start depends on the order of the rows.
    values = train.groupBy(column).agg(F.sum(WEIGHT).cast("double").alias(WEIGHT)).orderBy(column)
    rows = VectorAssembler(inputCols=[column], outputCol="point").transform(values)
    model = KMeans(k=k, seed=seed, featuresCol="point", weightCol=WEIGHT).fit(rows)
    return sorted(float(c[0]) for c in model.clusterCenters())


def _cluster(column: str, centres: Sequence[float]) -> str:
    """Nearest centre: the number of midpoints below the value."""
    middles = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    tests = " + ".join(f"CAST({column} > {_number(m)} AS INT)" for m in middles)
    return tests or "0"


def clustered_steps(train: DataFrame) -> tuple[list, list[str], str]:
    """Fixed-ceiling features with one indicator per k-means cluster."""
    adjust = _step(_stretch("advanced", 95.0))
    centres = cluster_centres(adjust.transform(train), "advanced_adj")
    cluster = _step(f"{_cluster('advanced_adj', centres)} AS cluster")
    flags = [f"CAST(cluster = {i} AS DOUBLE) AS cluster_{i}" for i in range(len(centres))]
    names = ["base", "advanced_adj", "base_x_advanced", *(f"cluster_{i}" for i in range(len(centres)))]
    return [adjust, cluster, _step("base * advanced_adj AS base_x_advanced", *flags)], names, "structures"


def _through(rows: DataFrame, steps: Sequence[SQLTransformer]) -> DataFrame:
    for step in steps:
        rows = step.transform(rows)
    return rows


def _scale(moments: Row, names: Sequence[str]) -> list:
    """Standardisation on the train moments and the feature vector."""
    scale = _step(
        *(f"({c} - {_number(moments[c + '_mean'])}) / {_number(moments[c + '_std'])} AS {c}_z" for c in names)
    )
    return [scale, VectorAssembler(inputCols=[f"{c}_z" for c in names], outputCol="features")]


def elastic_net(label: str, deviation: float, alpha: float = 0.1, ratio: float = 0.5) -> LinearRegression:
    """Elastic net minimising 1/(2n)|y-Xw|^2 + alpha*ratio*|w|_1 + alpha*(1-ratio)/2*|w|^2.

    The ``normal`` solver reads the rows once for their cross products and
    iterates on those. It scales the quadratic penalty by the label's
    population deviation, so that part is multiplied by it beforehand.
    """
    l1, l2 = alpha * ratio, alpha * (1 - ratio) * deviation
    total = l1 + l2
    return LinearRegression(
        featuresCol="features", labelCol=label, weightCol=WEIGHT, solver="normal", standardization=False,
        regParam=total, elasticNetParam=l1 / total if total else 0.0, maxIter=10_000, tol=1e-14,
    )


def row_shares(rows: DataFrame, most: int = SHARES) -> DataFrame:
    """Every tuple as up to ``most`` rows that divide its weight as evenly as whole numbers can.

    Boosting samples rows anew in each round. A tuple that stands for many rows
    would be in or out as a whole; of its shares four fifths are in. Tuples of
    up to ``most`` rows are sampled row by row.
    """
    n = F.least(F.col(WEIGHT), F.lit(most)).cast("long")
    shares = rows.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    size = F.floor(F.col(WEIGHT) / n).cast("long") + (F.col("_share") < F.col(WEIGHT) % n).cast("long")
    return shares.withColumn(WEIGHT, size).drop("_share")


def boosting_rows(rows: DataFrame, names: Sequence[str], label: str, most: int = SHARED_ROWS, task: int = TASK_ROWS) -> DataFrame:
    """Shares of the tuples to boost on, the whole weight of every tuple, dealt over tasks by their number.

    What one task can take stays as it is. Beyond it a tuple has fewer shares,
    so that there are ``most`` of them in all; with more tuples than that, those
    of equal features are one with their mean label first, as squared error
    gives the same trees for it.
    """
    fewest = F.least(F.col(WEIGHT), F.lit(SHARES))
    tuples, shares = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(fewest), F.lit(0))).first()
    if shares <= task:
        return row_shares(rows)
    if tuples > most:
        w = F.col(WEIGHT)
        mean = (F.sum(w * F.col(label)) / F.sum(w)).alias(label)
        rows = materialise(rows.groupBy(*names).agg(mean, F.sum(w).alias(WEIGHT)))
        tuples, shares = rows.agg(F.count(F.lit(1)), F.sum(fewest)).first()
    each = SHARES if shares <= most else max(1, most // tuples)
    keys = [*names, label]
    # Sorted, as the rows that a round samples depend on their order.
    parts = -(-min(shares, max(tuples, most)) // task)
    return row_shares(rows, each).repartition(parts, *keys).sortWithinPartitions(*keys, WEIGHT)


def boosted_trees(label: str, rounds: int = 200, depth: int = 5, seed: int = 42) -> GBTRegressor:
    """Gradient boosting with row and column sampling of 0.8; rows are sampled anew in each round."""
    return GBTRegressor(
        featuresCol="features", labelCol=label, weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, stepSize=0.1,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, checkpointInterval=10,
    )


def fit(train: DataFrame, steps: Steps, learner: str, **options) -> PipelineModel:
    """Fit features, scaling and regressor on ``train`` as one pipeline."""
    engineer, names, label = steps(train)
    engineered = _through(train, engineer)
    moments = scaling(engineered, [*names, label]).first()
    scale = _scale(moments, names)
    if learner == "elastic_net":
        regressor = elastic_net(label, moments[f"{label}_std"], **options)
    else:
        shared_folder(train.sparkSession)  # the rounds are checkpointed there
        regressor = boosted_trees(label, **options)
        engineered = boosting_rows(engineered, names, label)
    rows = _through(engineered, scale).select("features", label, F.col(WEIGHT).cast("double").alias(WEIGHT))
    return PipelineModel(stages=[*engineer, *scale, regressor.fit(rows)])


# Variant: features (given all rows), learner and its settings.
VARIANTS = {
    "raw": (lambda rows: raw_steps, "elastic_net", {"alpha": 0.1}),
    "engineered": (lambda rows: engineered_steps, "elastic_net", {"alpha": 0.1}),
    "clustered": (lambda rows: clustered_steps, "elastic_net", {"alpha": 0.001}),
    "boosted": (q75_steps, "boosted_trees", {}),
}


def train_part(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("part") == "train")


def train(rows: DataFrame, variant: str, on: str = "train", **options) -> PipelineModel:
    """Train a variant on the train part of ``prepared`` rows, or ``on="all"`` of them."""
    if on not in ("train", "all"):
        raise ValueError(f"train on 'train' or 'all', not {on!r}")
    steps, learner, settings = VARIANTS[variant]
    return fit(rows if on == "all" else train_part(rows), steps(rows), learner, **{**settings, **options})


def label_of(model: PipelineModel) -> str:
    return model.stages[-1].getLabelCol()


def feature_names(model: PipelineModel) -> list[str]:
    return [c.removesuffix("_z") for c in model.stages[-2].getInputCols()]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Score rows in bulk from raw grades; the label's grade may be absent."""
    label = label_of(model)
    missing = {"target", label.removesuffix("_adj")} - set(rows.columns)
    scored = model.transform(rows.withColumns({c: F.lit(None).cast("double") for c in missing}))
    return scored.select(*rows.columns, F.col(label).alias("actual"), F.col("prediction").alias("predicted"))


def diagnostics(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Actual, predicted and residual per row and part."""
    return predict(model, rows).withColumn("residual", F.col("actual") - F.col("predicted"))


def metrics(scored: DataFrame, by: Sequence[str] = ("part",)) -> DataFrame:
    """Mean squared error and R² of weighted predictions per group."""
    w = F.col(WEIGHT).cast("double")
    y, miss = F.col("actual"), F.col("actual") - F.col("predicted")
    n, error = F.sum(w), F.sum(w * miss * miss)
    spread = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    return scored.groupBy(*by).agg(
        F.sum(WEIGHT).alias("n"), (error / n).alias("mse"),
        (1 - F.try_divide(error, F.when(spread > 0, spread))).alias("r2"),
    )


def histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Residual counts in equal bins from least to greatest; the last is closed."""
    counted = scored.groupBy("residual").agg(F.sum(WEIGHT).alias("n"))
    edges = counted.agg(F.struct(F.min("residual").alias("lo"), F.max("residual").alias("hi"))).scalar()
    lo, hi = edges.getField("lo"), edges.getField("hi")
    bucket = F.when(lo == hi, F.lit(1)).otherwise(
        F.least(F.expr(f"{bins}"), F.width_bucket(F.col("residual"), lo, hi, F.lit(bins)).cast("int"))
    )
    return counted.select(bucket.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))


def importances(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Feature importances, greatest first."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    pairs = list(zip(feature_names(model), values))
    return rows.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"))


def coefficients(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Coefficients on the scaled features and the intercept."""
    final = model.stages[-1]
    pairs = [*zip(feature_names(model), map(float, final.coefficients)), ("(intercept)", float(final.intercept))]
    return rows.sparkSession.createDataFrame(pairs, "feature string, coefficient double")


def shuffled_folds(training: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold by hash of the student id."""
    return training.withColumn("fold", fold(F.col("student_id"), folds, seed, "cv"))


def contiguous_folds(training: DataFrame, folds: int = 5) -> DataFrame:
    """Equal runs of the rows in student order; the first runs are one longer."""
    order = [F.col(c) for c in training.columns]
    numbered = number_rows(training, [], order, "_at", start=0)
    total = numbered.agg(F.count(F.lit(1))).scalar()
    size, longer = F.floor(total / folds), total % folds
    edge = longer * (size + 1)
    late = longer + F.floor((F.col("_at") - edge) / F.greatest(size, F.lit(1)))
    run = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (size + 1))).otherwise(late)
    return numbered.withColumn("fold", run.cast("int")).drop("_at")


def cross_validate(
    rows: DataFrame, folds: int, steps: Steps, learner: str, at_once: int = 1, **options
) -> DataFrame:
    """R² on each fold of a model fitted on the others; scaling included.

    Each fit and each score is a job over the whole cluster. ``at_once`` folds
    submit their jobs at the same time, which pays where a fit is many small
    ones, as boosting is. A fold without rows, or with one label only, has no R².
    """

    def score(k: int) -> tuple[int, float | None]:
        model = fit(rows.where(F.col("fold") != k), steps, learner, **options)
        held_out = predict(model, rows.where(F.col("fold") == k))
        r2 = metrics(held_out, by=()).first()["r2"]
        return k, None if r2 is None else float(r2)

    with ThreadPoolExecutor(at_once) as pool:
        scores = list(pool.map(score, range(folds)))
    return rows.sparkSession.createDataFrame(scores, "fold int, r2 double")
