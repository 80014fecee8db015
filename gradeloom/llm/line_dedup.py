"""Line deduplication with a suffix array over line numbers, built by distributed prefix doubling.

A document is the sequence of its lines that hold a word. Every distinct line
that occurs twice gets a number; then the suffixes of all documents are sorted
by their first 2, 4, 8 ... lines: a suffix's rank by 2h lines is the rank of the
pair (its rank by h lines, the rank by h lines of the suffix h lines further).
Suffixes with equal ranks by h lines are an interval of the suffix array whose
longest common prefix is at least h. A suffix whose interval has length one is
in no repeated run of that length and leaves the doubling, so what is sorted
shrinks with each step.

A run is a stretch of lines with ``min_words`` words or more. The common prefix
of any length L between h and 2h is the pair of ranks by h lines at its start
and at its end minus h, so an interval of exactly the needed length is found
without a further doubling. Of the equal runs in an interval the first, in the
order of (doc_id, row, line), stays; the lines of the others are deleted.

Windows of ``min_words`` lines or fewer make up every run. A line of a run from
which on the run still holds ``min_words`` words starts a shortest window inside
of it. The lines after the last such start hold fewer words than that, so there
are fewer than ``min_words`` of them, and a window from that start to the end of
the run has them. So each line starts its shortest window and the longer ones
whose lines after the first hold fewer than ``min_words`` words, and the deleted
windows join to the maximal repeated runs. Without ``whole_runs`` only shortest
windows are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ordering import number_rows
from ..session import materialise
from .common import in_batches, row_key, whole_text

MIN_WORDS = 5


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, doc_id, line, id, reach, most): every line with a word, by its number among those of its document.

    ``id`` is a 128-bit hash of the line, ``reach`` the number of lines from
    this one on that hold ``min_words`` words, null if the document ends before.
    ``most`` is the number of lines up to which a window from this one is
    needed: as many as hold fewer than ``min_words`` words after the first, and
    ``reach`` at least.
    """

    def lines(batch: pa.RecordBatch) -> Iterator[dict]:
        rows, ids = batch.column(0).to_pylist(), batch.column(1)
        out: dict[str, list] = {"at": [], "line": [], "id": [], "reach": [], "most": []}
        for at, text in enumerate(batch.column(2).to_pylist()):
            found = [(x, len(w)) for x in text.split("\n") if (w := x.split())]
            counts = [n for _, n in found]
            end = words = far = more = 0
            for i, (line, n) in enumerate(found):
                if far <= i:
                    far, more = i + 1, 0
                else:
                    more -= n
                while far < len(found) and more + counts[far] < min_words:
                    more += counts[far]
                    far += 1
                while words < min_words and end < len(found):
                    words += counts[end]
                    end += 1
                out["at"].append(at)
                out["line"].append(i)
                out["id"].append(xxhash.xxh3_128_digest(line))
                out["reach"].append(end - i if words >= min_words else None)
                out["most"].append(max(end, far) - i)
                words -= n
        yield {
            "row": [rows[i] for i in out["at"]], "doc_id": ids.take(pa.array(out["at"], pa.int64())),
            "line": out["line"], "id": out["id"], "reach": out["reach"], "most": out["most"],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", whole_text().alias("text"))
    return in_batches(keyed, f"row binary, doc_id {kind}, line int, id binary, reach int, most int", lines)


def ranked(suffixes: DataFrame, *keys: str) -> DataFrame:
    """``suffixes`` that share their ``keys`` with another one, with their rank in the order of the keys.

    Suffixes with equal keys are first reduced to one row, before the shuffle,
    so a line that stands in a third of all documents is sorted once.
    """
    intervals = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    numbered = number_rows(intervals, [], [F.col(k) for k in keys], "rank")
    return suffixes.join(numbered, list(keys))


def suffix_ranks(lines: DataFrame, longest: int) -> dict[int, DataFrame]:
    """For h = 1, 2, 4 ... up to ``longest``: rank by h lines of each suffix that shares its first h lines."""
    first = materialise(ranked(lines, "id").select("row", "line", "rank"))
    ranks, h = {1: first}, 1
    while 2 * h <= longest:
        here = ranks[h].select("row", "line", F.col("rank").alias("head"))
        there = ranks[h].select("row", (F.col("line") - h).alias("line"), F.col("rank").alias("tail"))
        ranks[2 * h] = materialise(ranked(here.join(there, ["row", "line"]), "head", "tail").select("row", "line", "rank"))
        h *= 2
    return ranks


def repeated_windows(docs: DataFrame, min_words: int, whole_runs: bool) -> DataFrame:
    """(row, line, reach) of every window that stands somewhere before as well; ``reach`` is its number of lines.

    The order is (doc_id, row, line), null ids first. Rows that are equal in
    doc_id and text are one row to it.
    """
    lines = materialise(line_table(docs, min_words).distinct())
    ranks = suffix_ranks(lines, min_words)
    lengths = F.explode(F.sequence("reach", "most")).alias("reach") if whole_runs else F.col("reach")
    starts = lines.where(F.col("reach").isNotNull()).select("row", "doc_id", "line", lengths)
    windows = None
    for h, rank in ranks.items():
        own = starts.where((F.col("reach") >= h) & (F.col("reach") < 2 * h))
        head = rank.withColumnRenamed("rank", "head")
        end = rank.select("row", F.col("line").alias("_end"), F.col("rank").alias("tail"))
        found = own.join(head, ["row", "line"]).withColumn("_end", F.col("line") + F.col("reach") - h)
        found = found.join(end, ["row", "_end"]) if h > 1 else found.withColumn("tail", F.col("head"))
        found = found.select("row", "doc_id", "line", "reach", "head", "tail")
        windows = found if windows is None else windows.unionByName(found)
    windows = materialise(windows)
    place = F.struct("doc_id", "row", "line")
    firsts = windows.groupBy("reach", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n"))
    later = windows.join(materialise(firsts.where(F.col("_n") > 1)), ["reach", "head", "tail"])
    return later.where(~place.eqNullSafe(F.col("first"))).select("row", "line", "reach")


def deleted_runs(docs: DataFrame, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """(row, runs): per document the maximal runs of deleted lines as an array of (first, last) line numbers."""
    spans = repeated_windows(docs, min_words, whole_runs).select("row", "line", (F.col("line") + F.col("reach") - 1).alias("last"))
    before = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("line") > F.max("last").over(before) + 1, F.lit(True))
    placed = spans.withColumn("_run", F.sum(fresh.cast("int")).over(Window.partitionBy("row").orderBy("line")))
    runs = placed.groupBy("row", "_run").agg(F.min("line").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines (counted among those with a word) in ``runs``, and how many those are."""
    kept, number, dropped = [], -1, 0
    spans = iter(runs)
    span = next(spans, None)
    for line in text.split("\n"):
        if line.split():
            number += 1
            while span and number > span[1]:
                span = next(spans, None)
            if span and number >= span[0]:
                dropped += 1
                continue
        kept.append(line)
    return "\n".join(kept), dropped


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = "n_removed", whole_runs: bool = False
) -> DataFrame:
    """``docs`` without the later copies of repeated runs of lines; the other columns stay as they are.

    With ``whole_runs`` all lines of a repeated run go, else those of its
    shortest windows, so that short lines at its end may stay.
    ``removed`` names a column for the number of deleted lines (None: none);
    a column of that name is replaced, and a column n_chars gets the new length.
    Lines without a word are never deleted and do not interrupt a run. A null
    text stays null, an empty one empty, an empty table gives no rows; a text of
    deleted lines only becomes empty. Rows equal in doc_id and text are treated
    as one and stay equal. Lines are equal only if all their characters are.
    """
    runs = deleted_runs(docs, min_words, whole_runs)
    names = [c for c in docs.columns if c != removed]
    fields = [docs.schema[c] for c in names] + ([StructField(removed, LongType())] if removed else [])
    packed = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")
    )
    joined = packed.join(runs, "row", "left").select("_doc", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column(0).flatten()))
            runs = batch.column(1).to_pylist()
            texts, counts = columns["text"].to_pylist(), [0] * batch.num_rows
            for i, found in enumerate(runs):
                if found and texts[i]:
                    texts[i], counts[i] = without_runs(texts[i], [(r["first"], r["last"]) for r in found])
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                lengths = [n if not c else len(t) for n, c, t in zip(columns["n_chars"].to_pylist(), counts, texts)]
                columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            if removed:
                columns[removed] = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(cut, StructType(fields))
