"""Mixing sources to target weights by Poisson replication.

A document of source s should appear, on average, rate(s) times, where rate(s)
is the wanted share of s times the wanted number of rows over the rows s has.
Its number of copies is the inverse of the Poisson distribution with that mean
at a number drawn from a hash of (seed, doc_id), so it does not depend on the
partitioning or on which executor computes it, and rare sources repeat whole
documents with the right spread instead of a fixed factor.

A Poisson number of mean r is the sum of m independent ones of mean r/m. Means
are cut so that no part exceeds ``PART_MEAN``: the distribution function of a
part is then a short array that is computed once per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

PART_MEAN = 8.0
#: Above this many events a part of mean PART_MEAN has a probability under 2^-48, the step of the drawn number.
PART_TERMS = 50
STEPS = float(1 << 48)
#: Copies of a source's row in the table of rates: a hot source is joined over so many keys.
SALTS = 32


def source_rates(
    docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: int | None = None
) -> DataFrame:
    """Rows, wanted share and mean number of copies of every source.

    ``weights`` gives the shares (they are scaled to one; sources that are not
    named get none). Without it the share of a source goes with its number of
    rows to the ``power``. ``total`` is the wanted number of rows, by default as
    many as there are. A null source is a source of its own.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        raw = sizes.withColumn("raw", F.pow(F.col("n_rows").cast("double"), F.lit(float(power))))
    else:
        wanted = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, raw double")
        raw = sizes.join(wanted, F.col("source").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["raw"])
    raw = materialise(raw)
    sums = raw.agg(F.sum("raw").alias("all_raw"), F.sum("n_rows").alias("all_rows")).first()
    all_raw, rows = sums["all_raw"] or 1.0, total if total is not None else (sums["all_rows"] or 0)
    share = F.col("raw") / F.lit(float(all_raw))
    rate = F.round(share * F.lit(float(rows)) / F.col("n_rows"), 9)
    return raw.select("source", "n_rows", F.round(share, 9).alias("share"), rate.alias("rate"))


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Number of parts and the distribution function of one part, as an array."""
    mean = F.col("rate") / F.greatest(F.col("parts"), F.lit(1))
    term = lambda k: F.exp(-F.col("mean")) * F.pow(F.col("mean"), k) / F.factorial(k.cast("int"))
    below = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: term(k))
    rest = F.aggregate(
        F.sequence(F.lit(21), F.lit(PART_TERMS)),
        F.struct(F.element_at(below, 21).alias("p"), F.array().cast("array<double>").alias("all")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("mean") / k).alias("p"),
            F.concat(acc["all"], F.array(acc["p"] * F.col("mean") / k)).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    pmf = F.concat(below, rest)
    cdf = F.aggregate(
        pmf,
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all")),
        lambda acc, p: F.struct((acc["s"] + p).alias("s"), F.concat(acc["all"], F.array(acc["s"] + p)).alias("all")),
        lambda acc: acc["all"],
    )
    return (
        rates.withColumn("parts", F.ceil(F.col("rate") / PART_MEAN).cast("int"))
        .withColumn("mean", mean)
        .withColumn("cdf", cdf)
        .select("source", "parts", "cdf")
    )


def copy_counts(keys: DataFrame, seed: int):
    """Column: copies of a row, from its columns doc_id, parts and cdf."""
    name = F.coalesce(keys["doc_id"].cast("string"), F.lit(""))

    def drawn(j):
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), name, j.cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / STEPS

    def inverse(j):
        u = drawn(j)
        return F.size(F.filter(F.col("cdf"), lambda c: u >= c))

    return F.when(F.col("parts") > 0, F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, j: n + inverse(j))).otherwise(0)


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    total: int | None = None,
    seed: int = 17,
    copy_column: str | None = "copy",
) -> DataFrame:
    """``docs`` with every row repeated as its source's rate asks, in a global random order.

    ``copy_column`` numbers the copies of a row from 1; None leaves it out. A
    name that ``docs`` already has is replaced. Rows equal in doc_id get equal
    counts, a null doc_id counts as the empty text, an empty table stays empty.
    The texts cross the network once, in the global shuffle: the table of rates
    is written first, so that the planner broadcasts it only if its files are
    small, and is joined on salted keys otherwise.
    """
    names = docs.columns
    rates = materialise(_with_distribution(source_rates(docs, weights, power, total)))
    salted = rates.select(
        F.coalesce("source", F.lit("")).alias("_mix_source"),
        F.col("source").isNull().alias("_mix_null"),
        F.struct("parts", "cdf").alias("_mix_rate"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_mix_salt"),
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_mix_row"))
    source, doc_id = F.col("_mix_row").getField("source"), F.col("_mix_row").getField("doc_id")
    keyed = packed.withColumns({
        "_mix_source": F.coalesce(source, F.lit("")),
        "_mix_null": source.isNull(),
        "_mix_salt": F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"),
    })
    joined = keyed.join(salted, ["_mix_source", "_mix_null", "_mix_salt"]).select(
        "_mix_row", doc_id.alias("doc_id"), F.col("_mix_rate.parts").alias("parts"), F.col("_mix_rate.cdf").alias("cdf")
    )
    counted = joined.withColumn("_mix_n", copy_counts(joined, seed)).where(F.col("_mix_n") > 0)
    copies = counted.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("_mix_copy"))
    order = F.xxhash64(doc_id, F.col("_mix_row.text"), F.col("_mix_copy"), F.lit(seed))
    mixed = copies.withColumn("_mix_order", order).repartition("_mix_order").sortWithinPartitions("_mix_order")
    columns = [F.col("_mix_row").getField(c).alias(c) for c in names if c != copy_column]
    return mixed.select(*columns, *([F.col("_mix_copy").alias(copy_column)] if copy_column else []))
