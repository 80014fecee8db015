"""Interaction of document filters: who fails what, and what each order of the filters removes.

The filter on copies is an existential self-join: a row fails if a row of equal
hash, equal text and smaller doc_id exists. Its failures are united with those
of the filters on the text alone, the bits of a document are put together, and
documents are counted by part and combination of bits. There are at most 32
combinations a part, and every order and step follows from their counts.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import whole_text

COPIES = "E"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text: its length, repetition, capitals and symbols."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and hash of the text of every document."""
    text = whole_text()
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("doc_id", part.alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))


def failures(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, part, hash, bits of the filters on the text) of every document, and the filters' names."""
    words = F.array_remove(F.split("text", SPACE), "")
    rows = _rows(docs).withColumn("words", words)
    tests = text_filters(F.col("text"), F.col("words"))
    bits = sum((test.cast("int") * (1 << i) for i, test in enumerate(tests.values())), F.lit(0))
    return rows.select("doc_id", "part", "hash", bits.alias("bits")), list(tests)


def later_copies(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of the rows whose text a row with a smaller doc_id has as well.

    ``hashes`` holds the hash of every document. Only texts whose hash occurs
    twice are moved. One row of each different text, the one of smallest doc_id,
    stands for all rows that may precede, so the join never meets pairs of a
    group, and as both of its sides are read from tables a hot text is split.
    """
    shared = materialise(hashes.groupBy("hash").count().where(F.col("count") > 1).select("hash"))
    suspects = materialise(_rows(docs).join(shared, "hash", "left_semi"))
    first = materialise(
        suspects.groupBy("hash", "text").agg(F.min("doc_id").alias("first")).where(F.col("first").isNotNull())
    )
    earlier = (
        (F.col("s.hash") == F.col("f.hash")) & (F.col("s.text") == F.col("f.text")) & (F.col("f.first") < F.col("s.doc_id"))
    )
    found = suspects.alias("s").join(first.alias("f"), earlier, "left_semi")
    return found.select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """Documents, good and toxic ones by part and combination of failed filters; and the filters' names."""
    own, names = failures(docs)
    own = materialise(own)
    copies = later_copies(docs, own).select("*", F.lit(1 << len(names)).alias("bits"), F.lit(0).alias("n"))
    united = own.withColumn("n", F.lit(1)).unionByName(copies)
    marked = united.groupBy("doc_id", "part", "hash").agg(
        F.bit_or("bits").alias("bits"), F.sum("n").cast("long").alias("n")
    )
    judged = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counted = marked.join(judged, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    return counted, [*names, COPIES]


def _steps(names: list[str]) -> Column:
    """Every order and step: the filter's bit and the bits of those before it."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "own": bit[name], "before": sum(bit[x] for x in order[:k])}
        for order in permutations(names)
        for k, name in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every order of the filters keeps, removes and loses at every step, by source.

    One row per part (source), order and step, zeros included; an empty table
    gives none. A null text counts as empty, a null source as the empty one. A
    null doc_id has no label, precedes no row and has no smaller one. Rows
    stored several times count each; of several labels of a document one that
    says 1 is enough, and null labels say nothing. Rows of one doc_id and equal
    text are no copies of each other. Further columns are not read, so their
    names may clash; texts are read whole.
    """
    counted, names = combinations(docs, labels)
    orders = 1
    for k in range(2, len(names) + 1):
        orders *= k
    group = F.struct("bits", "n", "good", "toxic")
    parts = counted.groupBy("part").agg(F.collect_list(group).alias("groups"))  # at most 2^filters rows a part
    steps = parts.select("part", "groups", F.inline(_steps(names)))

    def total(value, test) -> Column:
        chosen = F.filter("groups", test)
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda sum_, g: sum_ + value(g))

    own, before = F.col("own"), F.col("before")
    fails = lambda g: g.bits.bitwiseAND(own) != 0
    passed = lambda g: g.bits.bitwiseAND(before) == 0
    here = lambda g: fails(g) & passed(g)
    count = lambda g: g.n
    return steps.select(
        "part", "filter_order", "step",
        total(count, lambda g: ~fails(g) & passed(g)).alias("kept"),
        total(count, here).alias("removed"),
        total(count, lambda g: fails(g) & ~passed(g)).alias("redundant"),
        total(count, lambda g: g.bits == own).alias("unique_fails"),
        total(lambda g: g.good, here).alias("good_lost"),
        total(lambda g: g.toxic, here).alias("toxic_lost"),
        # A filter removes a document in the orders in which it comes first of those that the document fails.
        total(lambda g: (g.n * orders / F.bit_count(g.bits)).cast("long"), fails).alias("shapley"),
    )
