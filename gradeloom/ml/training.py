"""Training set of the grade prediction, its statistics and features.

A student who repeats a course has one training row for every combination of
the attempts. Here such rows are kept once with their number (``weight``):
attempts with equal grades are counted before they are combined, and the
statistics and the models take the weights.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grades import BIN_LABELS, indicator, scale_a, score_bin, stretch_above

FEATURES = ["base", "advanced", "structures"]
GRADES = [*FEATURES, "target"]
WEIGHT = "weight"
TEST_SHARE = 5
COPY_RUN = 4096


def attempts(enrollment: DataFrame, roles: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per student and role, the whole grades with their number of attempts.

    ``roles`` maps a role to (course name, academic year). The name is the whole
    name for a feature and the beginning of it for the ``target``; no character
    is a wildcard. One scan serves all roles, and the lists hold distinct grades.
    """
    course = F.col("course_name")
    tests = {
        role: (course.startswith(name) if role == "target" else course == name) & (F.col("academic_year") == year)
        for role, (name, year) in roles.items()
    }
    wanted = enrollment.where(reduce(Column.__or__, tests.values()))
    role = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(r)) for r, test in tests.items()))))
    rows = wanted.select("student_id", "grade_text", role.alias("role"))
    counted = rows.groupBy("student_id", "role", scale_a(F.col("grade_text")).alias("grade")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pair = F.struct("grade", "n")
    return counted.groupBy("student_id").agg(
        *(F.collect_list(F.when(F.col("role") == r, pair)).alias(r) for r in roles)
    )


def training_set(
    enrollment: DataFrame, roles: Mapping[str, tuple[str, str]], impute_zero: bool = True
) -> DataFrame:
    """Students with all feature courses; grades per combination of attempts.

    A student without the target course, or without a grade in it, gets the
    target 0, or is dropped when ``impute_zero`` is off. Without a ``target``
    role the set has the features only.
    """
    rows = attempts(enrollment, roles)
    weight = F.lit(1).cast("long")
    for role in roles:
        unpack = F.explode_outer(role) if role == "target" else F.explode(role)
        rows = rows.withColumn(role, unpack)
        weight = weight * F.coalesce(F.col(f"{role}.n"), F.lit(1))
    grades = {r: F.col(f"{r}.grade") for r in roles}
    if "target" in roles and impute_zero:
        grades["target"] = F.coalesce(grades["target"], F.lit(0.0))
    merged = rows.select("student_id", *(g.alias(r) for r, g in grades.items()), weight.alias(WEIGHT))
    kept = merged.dropna(subset=list(roles))
    return kept.groupBy("student_id", *roles).agg(F.sum(WEIGHT).alias(WEIGHT))


def expand(training: DataFrame) -> DataFrame:
    """One row per combination of attempts, as an ordinary join would give.

    Copies are made in runs, so that no array is longer than a run, and the runs
    are dealt over the tasks before they are copied out.
    """
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(WEIGHT) - 1) / COPY_RUN).cast("long")))
    length = F.least(F.lit(COPY_RUN), F.col(WEIGHT) - F.col("_run") * COPY_RUN).cast("int")
    dealt = training.withColumn("_run", runs).repartition("student_id", "_run")
    return dealt.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), length))).drop("_run", "_copy", WEIGHT)


def grade_tuples(training: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct grades with their number of rows, without the students."""
    keys = [c for c in GRADES if c in training.columns]
    return training.groupBy(*keys, *extra).agg(F.sum(WEIGHT).alias(WEIGHT))


def describe(training: DataFrame, columns: Sequence[str] = GRADES) -> DataFrame:
    """Count, mean, standard deviation, range and quartiles of each column."""
    w = F.col(WEIGHT)

    def summary(c: str) -> Column:
        x, n = F.col(c), F.sum(w)
        squares = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / n
        return F.struct(
            F.lit(c).alias("column"),
            n.alias("count"),
            (F.sum(w * x) / n).alias("mean"),
            F.sqrt(F.try_divide(squares, n - 1)).alias("std"),
            F.min(x).alias("min"),
            F.percentile(x, 0.25, w).alias("q25"),
            F.percentile(x, 0.5, w).alias("q50"),
            F.percentile(x, 0.75, w).alias("q75"),
            F.max(x).alias("max"),
        )

    tuples = grade_tuples(training)
    return tuples.agg(F.array(*(summary(c) for c in columns)).alias("rows")).select(F.inline("rows"))


def means(rows: DataFrame, columns: Sequence[str]) -> Column:
    """Weighted means as one scalar struct, for moments around them."""
    w = F.col(WEIGHT)
    return rows.agg(F.struct(*((F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns))).scalar()


def correlations(training: DataFrame, columns: Sequence[str] = GRADES) -> DataFrame:
    """Pearson correlation of every pair of columns, one row per pair.

    Products are added up around the means, so that columns far from zero keep
    their small deviations.
    """
    tuples = grade_tuples(training)
    w, middle = F.col(WEIGHT).cast("double"), means(tuples, columns)
    centred = tuples.select(w.alias("w"), *((F.col(c) - middle.getField(c)).alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    firsts = [F.sum(F.col("w") * F.col(c)).alias(f"s_{c}") for c in columns]
    seconds = [F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs]
    sums = centred.agg(F.sum("w").alias("n"), *firsts, *seconds)

    def cross(a: str, b: str) -> Column:
        # The centred first sums are what rounding left of zero.
        return F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")

    moments = sums.select(*(cross(a, b).alias(f"{a}_{b}") for a, b in pairs))
    rows = []
    for a in columns:
        for b in columns:
            one, other = sorted((a, b), key=list(columns).index)
            spread = F.sqrt(F.col(f"{a}_{a}")) * F.sqrt(F.col(f"{b}_{b}"))
            r = F.try_divide(F.col(f"{one}_{other}"), spread)
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return moments.select(F.inline(F.array(*rows)))


def stretch_q75(training: DataFrame, columns: Sequence[str] = GRADES, fit_on: DataFrame | None = None) -> DataFrame:
    """Stretch each column above its own 75 % quantile, as ``<column>_adj``.

    The quantiles are of ``fit_on`` (all rows by default), read once.
    """
    source = grade_tuples(training if fit_on is None else fit_on)
    cuts = source.agg(F.struct(*(F.percentile(c, 0.75, F.col(WEIGHT)).alias(c) for c in columns))).scalar()
    return training.withColumns(
        {f"{c}_adj": stretch_above(F.col(c), cuts.getField(c)) for c in columns}
    )


def interactions(training: DataFrame) -> DataFrame:
    """Product of base and advanced, difference of structures and base."""
    return training.withColumns(
        {
            "base_x_advanced": F.col("base_adj") * F.col("advanced_adj"),
            "structures_minus_base": F.col("structures_adj") - F.col("base_adj"),
        }
    )


def engineered(training: DataFrame, ceiling: float = 95.0) -> DataFrame:
    """Fixed-ceiling features: stretched advanced grade, product, bins of base."""
    adjusted = training.withColumn("advanced_adj", stretch_above(F.col("advanced"), ceiling))
    binned = adjusted.withColumns(
        {
            "base_x_advanced": F.col("base") * F.col("advanced_adj"),
            "base_bin": score_bin(F.col("base")),
        }
    )
    return binned.withColumns(
        {f"base_bin_{i}": indicator(F.col("base_bin"), label) for i, label in enumerate(BIN_LABELS)}
    )


def fold(identifier: Column, folds: int, seed: int, use: str) -> Column:
    """Fold 0..folds-1 of an id: depends on id, seed and use only.

    Rows of one student share a fold, and the assignment does not change with
    the partitioning. ``use`` keeps the folds of different purposes apart.
    md5 is used as other engines compute it alike.
    """
    digest = F.md5(F.concat_ws("|", F.lit(use), F.lit(str(seed)), identifier).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def split(training: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``part``: one in five students is ``test``, the others ``train``."""
    test = fold(F.col("student_id"), TEST_SHARE, seed, "split") == 0
    return training.withColumn("part", F.when(test, "test").otherwise("train"))


def scaling(train: DataFrame, columns: Sequence[str], tolerance: float = 1e-13) -> DataFrame:
    """One row with mean and population deviation per column; 1 where it is 0.

    The rows are read twice: for the means, and for the moments around them,
    which do not cancel out in columns far from zero. A deviation counts as 0
    up to ``tolerance`` times the mean, which is what rounding leaves of a
    constant column.
    """
    w, middle = F.col(WEIGHT), means(train, columns)
    n = F.sum(w)

    def moments(c: str) -> tuple[Column, Column]:
        off = F.col(c) - middle.getField(c)
        shift = F.sum(w * off) / n
        spread = F.sqrt(F.greatest(F.sum(w * off * off) / n - shift * shift, F.lit(0.0)))
        mean = middle.getField(c) + shift
        return mean, F.when(spread > tolerance * F.abs(mean), spread).otherwise(1.0)

    found = {c: moments(c) for c in columns}
    return train.agg(*(m.alias(f"{c}_mean") for c, (m, _) in found.items()), *(s.alias(f"{c}_std") for c, (_, s) in found.items()))


def standardise(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_z``, scaled with the moments of the training part."""
    moments = scaling(train, columns)
    one = moments.select(F.struct(*moments.columns)).scalar()
    return rows.withColumns(
        {f"{c}_z": (F.col(c) - one.getField(f"{c}_mean")) / one.getField(f"{c}_std") for c in columns}
    )
