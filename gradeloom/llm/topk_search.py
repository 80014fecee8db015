"""Exact top-k inner product search over vectors in buckets of like length.

Vectors are grouped by length (their norm) into buckets, longest first. The
bucket of the longest vectors gives every query a first k-th best score t. For
any other bucket, whose longest vector has norm L, a score of t needs a cosine
of t / (|q| L) at least, the bucket's local threshold for that query. A bucket
whose threshold is over one is never sent to the query. Inside a bucket, a low
threshold prunes by length only (|v| >= t / |q|); a high one prunes by
coordinates: with the largest coordinates of the query's direction, the interval
in which that coordinate of a matching direction must lie. What is left is
verified by its inner product, in whole numbers.

Equal vectors are searched once: a vector carries its smallest k + 1 ids, a
query vector all its query ids, which are joined again at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise

BUCKETS = 32
BLOCK_VECTORS = 2048
BLOCK_QUERIES = 1024
#: Local cosine threshold from which coordinates prune more than they cost.
COORDINATE_FROM = 0.35
FOCUS = 4
FLOAT_EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): vectors as whole numbers; without null vectors and those with a null or non-finite component."""
    big = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall(big, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.where(F.col("vec_id").isNotNull()).select("vec_id", big.alias("x"), finite.alias("finite"))
    return found.where(F.col("finite")).select(
        "vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v")
    )


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: in doubles while these are exact, else in Python's integers."""
    largest = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * a.shape[1]
    if largest < FLOAT_EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def block_search(queries: np.ndarray, least: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (places, scores) of the vectors that may reach its score ``least``.

    The margins keep a vector whose bound is equal up to rounding, so pruning
    never loses a score that is equal to ``least``.
    """
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    sizes = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    longest = norms.max(initial=0.0)
    directions = vectors / np.maximum(norms, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(sizes * longest > 0, least / (sizes * longest), np.where(least > 0, np.inf, -np.inf))
    found: list = [None] * len(queries)
    loose = np.flatnonzero(local < COORDINATE_FROM)
    if len(loose):
        scores = inner(queries[loose], vectors)
        for row, q in zip(scores, loose):
            enough = norms * sizes[q] >= least[q] * (1 - 1e-9) - 1e-6
            places = np.flatnonzero(enough)
            found[q] = places, row[places]
    for q in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + 1e-9)):
        direction, t = queries[q] / sizes[q], min(float(local[q]), 1.0)
        places = np.flatnonzero(norms * sizes[q] >= least[q] * (1 - 1e-9) - 1e-6)
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2)))
            at = directions[places, f]
            low = -1.0 if direction[f] <= -t else direction[f] * t - spread
            high = 1.0 if direction[f] >= t else direction[f] * t + spread
            places = places[(at >= low - 1e-9) & (at <= high + 1e-9)]
        found[q] = places, inner(queries[q : q + 1], vectors[places])[0]
    nothing = np.empty(0, dtype=np.int64)
    return [(nothing, nothing) if x is None else x for x in found]


def _pair_search(k: int):
    """Cogroup function: the best k + 1 (score, id) of one block of vectors for each query of one block."""

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(vectors) and len(queries):
            matrix = np.stack(vectors["v"].to_numpy())
            least = queries["least"].to_numpy(dtype=np.float64)
            found = block_search(np.stack(queries["v"].to_numpy()), least, matrix)
            ids = vectors["ids"].to_list()
            for q, bound, (places, scores) in zip(queries["q"], least, found):
                good = scores >= bound
                places, scores = places[good], scores[good]
                if len(places) > k + 1:
                    last = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    places, scores = places[scores >= last], scores[scores >= last]
                best = sorted((-int(s), int(i)) for p, s in zip(places, scores) for i in ids[p])[: k + 1]
                out += [(int(q), i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    return search


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best scores of every query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows of another vec_id, of the same number of components. Scores are inner
    products of the vectors' components times ``scale``, rounded down. Null
    vectors and ids, and vectors with null or non-finite components, take no
    part; a query without candidates has no rows. Rows equal in id and vector
    count once.
    """
    spark = rows.sparkSession
    whole = materialise(whole_vectors(rows, scale).distinct())
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors = whole.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    vectors = materialise(vectors.withColumn("norm", F.sqrt(norm2)).withColumn("dim", F.size("v")))
    asked = whole.where(F.col("vec_id") % every == 0)
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("q")).withColumn("norm", F.sqrt(norm2)).withColumn("dim", F.size("v"))
    queries = materialise(queries)
    cuts = vectors.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0] or []
    edges = sorted({float(c) for c in cuts}, reverse=True)
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("norm") < e)) if edges else F.lit(0)
    placed = vectors.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r for r in placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}
    n_queries = queries.count()
    if not sizes or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = sorted(sizes)
    counts = [x for b in order for x in (F.lit(b), F.lit(-(-sizes[b]["n"] // BLOCK_VECTORS)))]
    blocks = F.element_at(F.create_map(*counts), F.col("bucket"))
    query_blocks = -(-n_queries // BLOCK_QUERIES)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("v"), blocks).cast("int"))
    queries = queries.withColumn("query_block", F.pmod(F.xxhash64("v"), F.lit(query_blocks)).cast("int"))

    def searched(vectors: DataFrame, asked: DataFrame) -> DataFrame:
        """``asked`` has a row for each query and bucket to be searched."""
        sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        met = vectors.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        keys = ["dim", "bucket", "block", "query_block"]
        left = met.select(*keys, "v", "ids").groupBy(*keys)
        right = sent.select(*keys, "v", "q", "least").groupBy(*keys)
        return left.cogroup(right).applyInPandas(_pair_search(k), "q long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("place", place).where(F.col("place") <= k + 1)

    longest = order[0]
    seeds = materialise(best(searched(
        placed.where(F.col("bucket") == longest),
        queries.withColumn("bucket", F.lit(longest)).withColumn("least", F.lit(float("-inf"))),
    )))
    bounds = seeds.where(F.col("place") == k + 1).select("q", F.col("score").cast("double").alias("least"))
    bounded = queries.join(bounds, "q", "left").fillna({"least": float("-inf")})
    lengths = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(float(sizes[b]["longest"])).alias("longest")) for b in order[1:]])
    found = seeds.select("q", "vec_id", "score")
    if len(order) > 1:
        there = bounded.withColumn("_b", F.explode(lengths)).where(
            F.col("norm") * F.col("_b.longest") * (1 + 1e-9) + 1e-6 >= F.col("least")
        )
        rest = searched(placed.where(F.col("bucket") != longest), there.withColumn("bucket", F.col("_b.bucket")))
        found = found.unionByName(rest)
    top = materialise(best(found).select("q", "vec_id", "score"))
    ids = asked.join(queries.select("v", "q"), "v").select(F.col("vec_id").alias("query_id"), "q")
    answers = ids.join(top, "q").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
