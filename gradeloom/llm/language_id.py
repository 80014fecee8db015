"""Language identification with language-bitmask n-gram filters.

Training counts the letter trigrams of every labelled training text, and keeps
for each language those that make up enough of its text. The kept n-grams of
all languages go into one bit-sliced Bloom filter: a slot is a word whose bit l
belongs to language l, an n-gram sets bit l of its slots for every language l
that has it, and the AND of an n-gram's slots returns all languages that
contain it in one look-up. A text is decided by the number of its n-grams per
language, after the expected number of false positives of that language's slice
is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import materialise
from .common import empty_worker, remainder, slices

#: An n-gram belongs to a language if it is at least this share of its n-grams: 100,000 per language at most.
MIN_SHARE = 1e-5
#: ... and at least this part of the largest share that any language has, as texts quote other languages.
MIN_OF_LARGEST = 0.1
SLOT_BITS = 21
HASHES = 3
CHUNK_CHARS = 500_000
#: Rows that are Python objects at once.
SLICE = 1_024
UNDETERMINED = "und"

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams around every letter of the lower-cased texts, their text's number, letters per text.

    All that is not a letter counts as one and the same word boundary.
    """
    points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in points], dtype=np.int64)
    joined = np.zeros(int(sizes.sum()), dtype=np.uint32)
    ends = np.cumsum(sizes)
    for p, end in zip(points, ends):
        joined[end - len(p) - 1 : end - 1] = p
    joined[~_letters()[joined]] = 0
    middle = np.flatnonzero(joined)
    owner = np.searchsorted(ends, middle, side="right")
    wide = joined.astype(np.uint64)
    grams = wide[middle - 1] << np.uint64(42) | wide[middle] << np.uint64(21) | wide[middle + 1]
    return grams, owner, np.bincount(owner, minlength=len(texts))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters; a longer text is a range of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > CHUNK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs`` (columns lang, text), summed before the shuffle."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_worker()
        found: dict[str, list] = {}
        for batch in slices(batches, SLICE):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, name in zip(texts, langs) if name == lang and t]
                for a, b in _chunks(own):
                    parts = found.setdefault(lang, [])
                    parts.append(np.unique(trigrams(own[a:b])[0], return_counts=True))
                    if len(parts) >= 16:
                        found[lang] = [merged(parts)]
        for lang, parts in found.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
            )

    part = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """Bit-sliced Bloom filter: slots x words of 32 language bits."""

    def __init__(self, names: list[str], grams: np.ndarray, language: np.ndarray):
        self.names = names
        self.slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(names) // 32))), dtype=np.uint32)
        word, bit = language // 32, np.uint32(1) << (language % 32).astype(np.uint32)
        for at in self.places(grams):
            np.bitwise_or.at(self.slots, (at, word), bit)
        self.false = np.array([self._filled(i) ** HASHES for i in range(len(names))])

    def _filled(self, i: int) -> float:
        return float(np.mean(self.slots[:, i // 32] >> np.uint32(i % 32) & np.uint32(1)))

    @staticmethod
    def places(grams: np.ndarray) -> Iterator[np.ndarray]:
        h = grams.astype(np.uint64) * _MIX[0]
        h ^= h >> np.uint64(32)
        for i in range(HASHES):
            yield ((h * _MIX[i + 1]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of all languages that contain each n-gram (with the filter's false positives)."""
        first, *rest = self.places(grams)
        found = self.slots[first]
        for at in rest:
            found &= self.slots[at]
        return found

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of every text: the part of its n-grams that the language truly contains.

        Equal counts go to the smaller name. A text without letters is undetermined, with score 0.
        """
        names, scores = [], []
        for a, b in _chunks(texts):
            grams, owner, size = trigrams(texts[a:b])
            found = self.languages(grams)
            hits = np.empty((b - a, len(self.names)))
            for i in range(len(self.names)):
                bit = found[:, i // 32] >> np.uint32(i % 32) & np.uint32(1)
                hits[:, i] = np.bincount(owner, weights=bit, minlength=b - a)
            share = np.clip((hits / np.maximum(size, 1)[:, None] - self.false) / (1 - self.false), 0.0, 1.0)
            best = share.argmax(axis=1) if self.names else np.zeros(b - a, dtype=int)
            for j, n in enumerate(size):
                known = n > 0 and self.names
                names.append(self.names[best[j]] if known else UNDETERMINED)
                scores.append(float(share[j, best[j]]) if known else 0.0)
        return names, scores


def train(docs: DataFrame) -> LanguageFilter:
    """Filter over the labelled rows of ``docs`` (lang, text); all of them are counted.

    What comes to the driver is bounded by the number of languages over MIN_SHARE.
    """
    counts = materialise(count_trigrams(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("_all"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("_all")).where(F.col("share") >= MIN_SHARE)
    largest = shares.groupBy("gram").agg(F.max("share").alias("_largest"))
    kept = shares.join(largest, "gram").where(F.col("share") >= MIN_OF_LARGEST * F.col("_largest"))
    rows = kept.select("lang", "gram").toPandas()
    names = sorted(rows["lang"].unique())
    numbers = rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=np.int64)
    return LanguageFilter(names, rows["gram"].to_numpy(dtype=np.uint64), numbers)


def identify(docs: DataFrame, model: LanguageFilter, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``language`` and ``score`` (replaced if there).

    Every whole text is read where it is scanned, without a shuffle; only the
    text decides. A null text and one without letters are undetermined with
    score 0. The model has a fixed size and is sent to the tasks once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (language, score)]
    at = docs.columns.index("text")
    places = [docs.columns.index(c) for c in rest]
    schema = StructType(
        [docs.schema[i] for i in places] + [StructField(language, StringType()), StructField(score, DoubleType())]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_worker()
        for batch in slices(batches, SLICE):
            names, scores = shared.value.decide([t or "" for t in batch.column(at).to_pylist()])
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, language, score]
            )

    return docs.mapInArrow(predict, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a label, and an id whose remainder by 4 is not 2."""
    return docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("lang", "text")


def keep_identified(docs: DataFrame, model: LanguageFilter, least: float) -> DataFrame:
    """Rows of ``docs``, unchanged, whose text has a language with at least the score ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_worker()
        for batch in slices(batches, SLICE):
            names, scores = shared.value.decide([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
