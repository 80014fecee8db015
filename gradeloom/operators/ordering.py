"""Sequence numbers and trends over groups of any size.

A window that numbers the rows of a group sorts the whole group in one task.
Here the rows are range-partitioned on (group, order) instead, so a group that
holds a third of the table is spread over a third of the tasks. Inside a task,
the row index gives the position; each slice of a group then needs only the
number of rows in the slices before it, which is a window over one row per
slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

_INDEX_BITS = (1 << 33) - 1


def _sliced(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sort globally; add the slice number and the row index in the slice."""
    keys = [F.col(c) for c in group] + list(order)
    row_id = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", row_id)
        .withColumn("_slice", F.shiftright("_row", 33))
        .withColumn("_index", F.col("_row").bitwiseAND(_INDEX_BITS))
        .drop("_row")
    )


def _before(group: Sequence[str]):
    """Window over the earlier slices of the same group."""
    return (
        Window.partitionBy(*group)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, start: int = 1
) -> DataFrame:
    """Add the position of every row in its group as column ``name``.

    ``order`` must be a total order within the group. The sliced rows are
    materialised, since both the slice sizes and the rows are read from them.
    """
    sliced = materialise(_sliced(df, group, order))
    sizes = sliced.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_index").alias("_first")
    )
    offsets = sizes.select(
        *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)),
        F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_size").over(_before(group)), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    position = F.col("_index") + F.col("_shift") + F.lit(start)
    return sliced.join(offsets, same).select(*df.columns, position.cast("long").alias(name))


def sequence_slope(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: str,
    first: Sequence[str] = (),
) -> DataFrame:
    """OLS slope of ``value`` on its 0-based position, for groups of two or more.

    ``first`` names columns whose value on the first row of the group is kept.
    Rows with a NULL value are left out before numbering. A slice of a group is
    reduced to its count, sum and index-weighted sum in the task that sorted
    it; those sums move to group positions by adding the slice's offset.
    """
    rows = df.where(F.col(value).isNotNull())
    per_slice = (
        _sliced(rows, group, order)
        .groupBy(*group, "_slice")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_index").alias("_lo"),
            F.sum(value).alias("_y"),
            F.sum(F.col("_index") * F.col(value)).alias("_iy"),
            *(F.min_by(c, "_index").alias(c) for c in first),
        )
    )
    placed = per_slice.withColumn(
        "_shift", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)) - F.col("_lo")
    )
    totals = placed.groupBy(*group).agg(
        F.sum("_n").alias("n"),
        F.sum("_y").alias("_y"),
        F.sum(F.col("_iy") + F.col("_shift") * F.col("_y")).alias("_iy"),
        *(F.min_by(c, "_slice").alias(c) for c in first),
    )
    n = F.col("n").cast("double")
    covariance = F.col("_iy") - F.col("_y") * (n - 1) / 2
    spread = n * (n * n - 1) / 12
    return totals.where(F.col("n") > 1).select(
        *group, *first, "n", (covariance / spread).alias("slope")
    )
