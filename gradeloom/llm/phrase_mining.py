"""Frequent phrases of each language that stick together, counted exactly.

Word n-grams are hashed and dealt to hash partitions. Each partition keeps a
Misra-Gries summary of more counters than its mass divided by the threshold, so
no n-gram that reaches the threshold is lost; summaries of parts of the corpus
are merged in any order. A second pass counts the surviving n-grams exactly.

A phrase that reaches the threshold consists of phrases that do. Single words
therefore come first, then pairs of surviving words, then longer phrases of
surviving pairs, and only such n-grams are summarised at all. What survives is
known to the tasks as a bit table of fixed size: a false positive there is
summarised or counted like any other and then falls below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import whole_text

LONGEST = 5
THRESHOLD = 100
#: A longer phrase with this per cent of a phrase's occurrences covers it.
COVER_PERCENT = 100
TOP = 2000
#: Lengths that are summarised together; each needs the survivors of those before it.
LEVELS = ((1, 1), (2, 2), (3, LONGEST))
#: Bits of the table of surviving n-grams, 8 MB. With more survivors than bits it lets more through.
TABLE_BITS = 1 << 26
#: Text bytes for each hash partition, and the least number of partitions.
BYTES_A_PART = 1 << 28
LEAST_PARTS = 2048
#: Bits that tell n-grams of a partition apart in its summary. Those that share them are one until they are counted exactly.
CODE_BITS = 32
#: Text bytes that are cut into words at a time, and n-grams that are gathered before a summary leaves a task.
SLICE_BYTES = 1 << 22
GATHERED = 1 << 22
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(PIECE_ENDS)] = 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


class Words:
    """The words of a slice of texts, in order: id, piece, language, and the different words with two hashes each."""

    def __init__(self, texts: pa.LargeBinaryArray, langs: np.ndarray):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        values = texts.buffers()[2]
        data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
        data, offsets = _LOWER[data], offsets - offsets[0]
        kind = _KIND[data]
        inside = kind == 0
        begins = offsets[:-1][np.diff(offsets) > 0]  # of texts that are not empty
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        cuts = (kind == 2).astype(np.int32)
        cuts[begins] += 1
        self.piece = np.cumsum(cuts, dtype=np.int32)[starts]
        self.lang = langs[np.searchsorted(offsets, starts, side="right") - 1]
        letters = data[inside]
        ends = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(letters)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.forms = coded.dictionary
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in self.forms.to_pylist())
        self.hashes = np.frombuffer(digests, np.uint64).reshape(-1, 2) if digests else np.zeros((0, 2), np.uint64)

    def __len__(self) -> int:
        return len(self.ids)

    def grams(self, longest: int, seeds: np.ndarray, which: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hash of the n-gram that starts at each word, whether it lies in one piece) for n = 1, 2, ..."""
        word = self.hashes[self.ids, which]
        total, whole = word ^ seeds[self.lang], np.ones(len(word), bool)
        for n in range(1, longest + 1):
            if n > 1:
                total = total[:-1] * _MIX[1] ^ word[n - 1 :] * _MIX[n % 2 + 3]
                whole = self.piece[n - 1 :] == self.piece[: len(total)]
            total = total ^ total >> np.uint64(31)
            total = total * _MIX[2]
            yield n, total ^ total >> np.uint64(29), whole


def _seeds(langs: list[str], which: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(lang, seed=which) for lang in langs], np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Batches of (text, lang) cut into slices of SLICE_BYTES, but never within a text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        lang = batch.column("lang").dictionary_encode()
        names = lang.dictionary.to_pylist()
        of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            yield Words(texts.slice(at, to - at), of[at:to]), names
            at = to


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the table of survivors has the hashes."""
    place = hashes % np.uint64(TABLE_BITS)
    return table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1


def _admitted(words: Words, names: list[str], low: int, high: int, tables: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hash by start, whether it goes on) of the n-grams of low to high words whose known parts all survive."""
    seeds = _seeds(names, 0)
    part = None
    for n, hashes, whole in words.grams(high, seeds):
        on = whole if part is None else whole & part[:-1] & part[1 : len(hashes) + 1]
        if n in tables:
            on = on & _known(tables[n], hashes)
        part = on
        if n >= low:
            yield n, hashes, on


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their counts added up."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def merge(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of Misra-Gries summaries, cut back to ``capacity`` counters, and what was taken off every counter.

    Taking off the largest count beyond the capacity removes at least capacity
    + 1 times as much mass, so all that is ever taken off stays below the mass
    divided by the capacity, in whatever order summaries are merged.
    """
    keys, counts = _counted(keys, counts)
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > off
    return keys[left], counts[left] - off, off


def masses(docs: DataFrame, levels: Sequence[tuple[int, int]], parts: int) -> DataFrame:
    """(part, m0, m1, ...) n-grams of each level in every hash partition, whether their parts survive or not."""
    schema = pa.schema([("part", pa.int32()), *((f"m{i}", pa.int64()) for i in range(len(levels)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros((len(levels), parts), np.int64)
        for words, names in _slices(batches):
            for n, hashes, whole in words.grams(levels[-1][1], _seeds(names, 0)):
                level = next(i for i, (low, high) in enumerate(levels) if low <= n <= high)
                mass[level] += np.bincount((hashes[whole] & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
        held = np.flatnonzero(mass.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(m[held]) for m in mass)], schema=schema)

    rows = docs.mapInArrow(count, "part int, " + ", ".join(f"m{i} long" for i in range(len(levels))))
    return rows.groupBy("part").agg(*(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(levels))))


def survivors(
    docs: DataFrame, low: int, high: int, tables: dict[int, np.ndarray], mass: DataFrame, parts: int, threshold: int
) -> DataFrame:
    """(gram) hashes of n-grams of low to high words, all that reach the threshold among them.

    ``mass`` has the number of n-grams of every hash partition, or more. Of a
    hash the lowest bits name the partition and CODE_BITS more are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    part_bits = parts.bit_length() - 1

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []

        def leave() -> pa.RecordBatch:
            # Turned so that the partition comes first in the order.
            keys = np.concatenate(gathered)
            gathered.clear()
            turned = (keys & np.uint64(parts - 1)) << np.uint64(CODE_BITS) | keys >> np.uint64(part_bits) & np.uint64((1 << CODE_BITS) - 1)
            turned, counts = _counted(turned, np.ones(len(turned), np.int64))
            part, codes = (turned >> np.uint64(CODE_BITS)).astype(np.int32), turned.astype(np.uint32)
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            rows = [(int(part[a]), codes[a:b].tobytes(), _packed(counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(part)])]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), _PARTIAL.types)], schema=_PARTIAL)

        for words, names in _slices(batches):
            for _, hashes, on in _admitted(words, names, low, high, shared.value):
                if on.any():
                    gathered.append(hashes[on])
            if sum(map(len, gathered)) >= GATHERED:
                yield leave()
        if gathered:
            yield leave()

    partial = docs.mapInArrow(summarise, "part int, codes binary, counts binary")
    dealt = partial.repartition("part").join(mass.select("part", "total"), "part").sortWithinPartitions("part")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def settle(to: int) -> None:
            state["codes"], state["counts"], off = merge(np.concatenate(state["more"]), np.concatenate(state["of"]), to)
            state["off"] += off
            state["more"], state["of"], state["size"] = [state["codes"]], [state["counts"]], 0

        def leave() -> pa.RecordBatch:
            settle(state["capacity"])
            found = state["codes"][state["counts"] + state["off"] >= threshold]
            return pa.RecordBatch.from_arrays([pa.array((found.astype(np.int64) << part_bits) + state["part"])], schema=_GRAM)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state["part"] != row["part"]:
                    if state is not None:
                        yield leave()
                    capacity = row["total"] // threshold + 1
                    state = {"part": row["part"], "capacity": capacity, "off": 0, "more": [], "of": [], "size": 0}
                codes = np.frombuffer(row["codes"], np.uint32)
                state["more"].append(codes)
                state["of"].append(_unpacked(row["counts"], len(codes)))
                state["size"] += len(codes)
                if state["size"] > max(4 * state["capacity"], GATHERED // 16):
                    settle(state["capacity"])
        if state is not None:
            yield leave()

    return dealt.mapInArrow(merged, "gram long")


_PARTIAL = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
_GRAM = pa.schema([("gram", pa.int64())])


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, and the places and full counts of those that need more."""
    small = np.minimum(counts, 255).astype(np.uint8)
    large = np.flatnonzero(small == 255).astype(np.int64)
    return small.tobytes() + large.tobytes() + counts[large].astype(np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = np.frombuffer(data[n:], np.int64).reshape(2, -1)
    counts[large[0]] = large[1]
    return counts


def survivor_table(found: DataFrame) -> np.ndarray:
    """Bit table of the survivors' hashes: TABLE_BITS bits, however many there are."""
    row_bits = 1 << 13

    def rows(key, group):
        bits = np.zeros(row_bits, np.uint8)
        bits[group.column("bit").to_numpy()] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"line": [key[0].as_py()], "bits": [packed]}, schema=pa.schema([("line", pa.int32()), ("bits", pa.binary())]))

    place = F.pmod("gram", F.lit(TABLE_BITS))
    places = found.select(place.alias("place")).distinct()
    lines = places.select((F.col("place") / row_bits).cast("int").alias("line"), (F.col("place") % row_bits).cast("int").alias("bit"))
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    # At most TABLE_BITS / row_bits rows of a kilobyte each reach the driver.
    for row in lines.groupBy("line").applyInArrow(rows, "line int, bits binary").collect():
        at = row["line"] * row_bits // 8
        table[at : at + row_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return table


def exact_counts(docs: DataFrame, tables: dict[int, np.ndarray], longest: int, threshold: int, parts: int) -> DataFrame:
    """(lang, phrase, words, n) of every phrase of up to ``longest`` words that reaches the threshold.

    A row of no words has the number of all words of the language. Within a slice phrases are told
    apart by 128 bits of hash, beyond it by their text. A task sends one row for each hash
    partition, with all its phrases there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bytes, int], int] = {}

        def leave() -> pa.RecordBatch:
            rows: dict[int, tuple[list, list, list, list]] = {}
            for (lang, phrase, n), size in total.items():
                row = rows.setdefault(xxhash.xxh3_64_intdigest(phrase) % parts, ([], [], [], []))
                for column, value in zip(row, (lang, phrase, n, size)):
                    column.append(value)
            total.clear()
            columns = [list(rows), *(list(c) for c in zip(*rows.values()))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PHRASES)], schema=_PHRASES)

        for words, names in _slices(batches):
            for lang, size in enumerate(np.bincount(words.lang, minlength=len(names)).tolist()):
                total[names[lang], b"", 0] = total.get((names[lang], b"", 0), 0) + size
            second = words.grams(longest, _seeds(names, 1), 1)
            for (n, first, on), (_, other, _) in zip(_admitted(words, names, 1, longest, shared.value), second):
                at = np.flatnonzero(on)
                at = at[np.lexsort((other[at], first[at]))]
                if not len(at):
                    continue
                new = np.append(True, (first[at][1:] != first[at][:-1]) | (other[at][1:] != other[at][:-1]))
                begin = np.flatnonzero(new)
                sizes = np.diff(np.append(begin, len(at)))
                heads = at[begin]
                forms = [words.forms.take(pa.array(words.ids[heads + k])).to_pylist() for k in range(n)]
                for lang, size, *form in zip(words.lang[heads].tolist(), sizes.tolist(), *forms):
                    key = (names[lang], b" ".join(form), n)
                    total[key] = total.get(key, 0) + size
            if len(total) >= GATHERED // 16:
                yield leave()
        if total:
            yield leave()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, {}

        def leave() -> pa.RecordBatch:
            kept = [(*key, size) for key, size in total.items() if size >= threshold or key[2] == 0]
            columns = list(zip(*kept)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield leave()
                    part, total = row["part"], {}
                for *key, size in zip(row["langs"], row["phrases"], row["sizes"], row["counts"]):
                    total[tuple(key)] = total.get(tuple(key), 0) + size
        yield leave()

    packed = docs.mapInArrow(count, "part long, langs array<string>, phrases array<binary>, sizes array<int>, counts array<long>")
    dealt = packed.repartition("part").sortWithinPartitions("part")
    counted = dealt.mapInArrow(add_up, "lang string, phrase binary, words int, n long")
    return counted.withColumn("phrase", F.col("phrase").cast("string"))


_PHRASES = pa.schema([
    ("part", pa.int64()), ("langs", pa.list_(pa.string())), ("phrases", pa.list_(pa.binary())),
    ("sizes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("n", pa.int64())])


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """``exact_counts`` of the documents, by levels of summaries and one exact pass."""
    text, lang = whole_text(), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = 1 << max(LEAST_PARTS - 1, size // BYTES_A_PART).bit_length()
    rows = docs.select(text.cast("binary").alias("text"), lang.alias("lang"))
    levels = [(low, min(high, longest)) for low, high in LEVELS if low <= longest]
    mass = materialise(masses(rows, levels, parts))
    tables: dict[int, np.ndarray] = {}
    for i, (low, high) in enumerate(levels):
        found = survivors(rows, low, high, tables, mass.withColumnRenamed(f"m{i}", "total"), parts, threshold)
        tables |= dict.fromkeys(range(low, high + 1), survivor_table(found))
    return exact_counts(rows, tables, longest, threshold, parts)


def scored(counts: DataFrame, cover_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one covers."""
    parts = counts.where("words > 0").select("lang", "phrase", "n")
    total = materialise(counts.where("words = 0").select("lang", F.col("n").alias("total")))
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.col("words")
    # A phrase that lies in a longer one also lies in one of a single word more, which is as frequent at least.
    shorter = F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", 2, size - 1))).alias("inner")
    covers = phrases.where("words > 2").select("lang", "a", shorter)
    covers = covers.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    covered = 100 * F.coalesce("longer", F.lit(0)) >= cover_percent * F.col("a")
    kept = phrases.join(covers, ["lang", "phrase"], "left").where(~covered).drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, size), " ").alias("tail"),
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    exact = "CAST(1000 * CAST({} AS DECIMAL(19, 0)) * CAST({} AS DECIMAL(19, 0)) AS DECIMAL(38, 0))"
    score = F.expr(f"{exact.format('a', 'total')} div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    with_total = cuts.join(total, "lang").select("lang", "phrase", "a", "total", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    least = with_total.groupBy("lang", "phrase", "a", "total").agg(F.min("cut").alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def first_of_each(rows: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each language with their rank; a language is cut down in shares before its shares meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    at = F.row_number()
    few = share.withColumn("_at", at.over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_at") <= top)
    ranked = few.withColumn("rank", at.over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("_share", "_at")


def mine(
    docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, cover_percent: int = COVER_PERCENT, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language.

    A-Z count as a-z. A null text counts as empty, a null language as ``und``.
    Texts are read whole and cut between them only; words of any length are
    whole. Phrases of equal score go by a, then by their bytes. Repeated rows
    count as often as they are stored. An empty table, or one without a phrase
    that reaches the threshold, gives no rows. doc_id and further columns are
    not read.
    """
    counts = materialise(frequent_phrases(docs, longest, threshold))
    rows = materialise(scored(counts, cover_percent))
    return first_of_each(rows, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
