"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is a sequence of lower-cased words and one end. A word is coded by its
path: a frequent word by that in a Huffman tree, any other one by the path of an
escape, of a class, and the bits of its number in the class. So a text is a
sequence of binary decisions. Each decision is predicted in several contexts
(its place on the paths alone, with the word before, with the two words before).
A context's predictor is a pair of counts. The predictors' log odds are added
with weights that a gate chooses by how much the contexts have been seen,
squashed to a probability, and refined by an adaptive map from (depth,
probability) to what was then observed.

The counts are of all training texts and exact (``context_counts``): what follows
a word is dealt to one part of the corpus, where it is sorted, so no table of
contexts has a size that the corpus could outgrow. Weights and the adaptive map
are learned in one pass over all parts, where every decision is left out of its
own counts: tasks add up, by gate, slope and curvature of the log probability at
``START`` and, by cell of the map, what was observed. The weights are one Newton
step away from ``START``; the map is addressed by the mix with ``START``, so both
come out of the same sums, whatever the order and partitioning of the texts. A
second pass over the parts scores, and its sums go back to the texts.

What is sent to the tasks has a fixed bound or grows with the different counts
of words: the ``DICTIONARY`` most frequent words, and how many words have each
count. All other words, of which there is no bound, get their numbers in a
shuffled join. Words are looked up once: the passes after read numbers, four
bytes each. ``bit_counts`` and ``fit_weights`` do the same over tables that one
task holds, in which contexts share 2^``TABLE_BITS`` slots.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ..session import materialise, written_once
from .common import freed_shuffles, remainder, slices, whole_text
from .context_counts import HOT, Heat, Paths, after_hot, before, dealt, numbered_whole, pack, parts_of, unpack

#: Words with a path of their own in the Huffman tree; the paths of the others begin with an escape.
HEAD = 2047
#: Words whose counts are sent to every task.
DICTIONARY = 150_000
TABLE_BITS = 20
BLOCK = 1 << 14
#: Weights from which the learned ones are a step away.
START = (0.3, 0.4, 0.4)
#: Sightings that the start counts as, for the weights of a gate and for a cell of the map.
PRIOR = 16.0
#: Decisions that are added up at once, and the fixed point of the sums that leave a task.
STRETCH = 1 << 15
#: Decisions of a token whose probabilities are multiplied, a power of two; with 1e-6 at least each, the product is no zero.
FACTORS = 32
FIXED = 1 << 16
CHUNK_TOKENS = 100_000
#: Tokens whose decisions are arrays at once, so that these stay in a core's cache.
STEP_TOKENS = 8_192
#: Tokens that a task counts at once.
COUNT_TOKENS = 1_500_000
#: Rows that are cut into tokens at once.
SLICE = 1_024
#: Tokens that are dealt to the parts at once, and bytes of text that make a part, with the end of a text as a word.
FLUSH_TOKENS = 1_000_000
PART_BYTES = 5_000_000
WORD_BYTES = 6
#: Fixed point of the log10 of a probability that leaves a part; texts whose sums are sent together, as a power of two.
UNIT = 2.0**-20
TEXT_BITS = 12
LOG10_2 = float(np.log10(2.0))
LEVELS = 33
SPAN = 8.0
_LOWER = bytes(range(256)).lower()
_WHITE = bytes(b in b"\t\n\x0b\x0c\r " for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words(text: str) -> list[bytes]:
    """Tokens of a text: words between ASCII white space with A-Z lower-cased, then the end, an empty token."""
    found = text.encode().lower().split()
    found.append(b"")
    return found


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all texts, one after the other, as ``words`` gives them, and the place of each text's first one."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].tobytes()
    offsets = offsets - offsets[0]
    letter = ~np.frombuffer(raw.translate(_WHITE), dtype=bool)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    text_begins = offsets[:-1][np.diff(offsets) > 0]
    begins[text_begins] = letter[text_begins]
    kept = np.frombuffer(raw.translate(_LOWER), dtype=np.uint8)[letter]
    word = np.append(np.flatnonzero(begins[letter]), len(kept))
    ends = np.searchsorted(np.flatnonzero(begins), offsets[1:])  # words up to the end of each text
    bounds = np.append(np.insert(word[:-1], ends, word[ends]), len(kept)).astype(np.int32)
    tokens = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return tokens, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts of ``docs``; tasks add up runs of ``COUNT_TOKENS`` tokens before the shuffle."""

    def emit(held: list[pa.Array]) -> pa.RecordBatch:
        counted = pa.chunked_array(held, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["token", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n = 0
        for batch in slices(batches, SLICE):
            held.append(tokens_of(batch.column(0))[0])
            n += len(held[-1])
            if n > COUNT_TOKENS:
                yield emit(held)
                held, n = [], 0
        yield emit(held)

    part = docs.select("text").mapInArrow(count, "token binary, c long")
    return part.groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The words that are as frequent as can be with ``most`` words or fewer, the most frequent first.

    A histogram over steps of 2 % of the count gives the least count; words are
    not sorted, and only the chosen ones come to the driver.
    """
    step = F.floor(F.log(F.col("c").cast("double")) / float(np.log(1.02))).cast("int")
    levels = counts.groupBy(step.alias("level")).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["n"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return [], []
    found = counts.where(F.col("c") >= least).toArrow().to_pylist()
    found.sort(key=lambda r: (-r["c"], bytes(r["token"])))
    return [bytes(r["token"]) for r in found], [r["c"] for r in found]


def huffman(counts: list[int]) -> list[list[tuple[int, int]]]:
    """Path of each symbol as (node, bit) from the root; nodes are numbered from 0."""
    queue = [(c, i, i) for i, c in enumerate(counts)]
    heapq.heapify(queue)
    parent: dict[int, tuple[int, int]] = {}
    made = len(counts)
    while len(queue) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(queue), heapq.heappop(queue)
        parent[left], parent[right] = (made, 0), (made, 1)
        heapq.heappush(queue, (a + b, made, made))
        made += 1
    paths = []
    for symbol in range(len(counts)):
        path, at = [], symbol
        while at in parent:
            at, bit = parent[at]
            path.append((at - len(counts), bit))
        paths.append(path[::-1])
    return paths


class Words:
    """The most frequent words, their counts and the paths of those in the head and of the escape."""

    def __init__(self, tokens: list[bytes], counts: list[int], n: int, v: int):
        self.n, self.v = n, v
        self.listed = pa.array(tokens, pa.binary())
        self.unlisted = len(tokens)
        self.head = min(HEAD, len(tokens))
        self.counts = np.array([*counts, 0], dtype=np.float64)
        #: Sum of c + 1 over the words outside of the head, and one for all unknown ones.
        self.tail = float(n - sum(counts[: self.head]) + (v - self.head) + 1)
        paths = huffman([*counts[: self.head], max(1, int(self.tail))])
        self.size = np.array([len(p) for p in paths], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        flat = [x for p in paths for x in p]
        self.nodes = np.array([x[0] for x in flat], dtype=np.int64)
        self.bits = np.array([x[1] for x in flat], dtype=np.int64)
        self.depth = np.array([d for p in paths for d in range(len(p))], dtype=np.int64)
        self.width = max(1, len(paths) - 1)
        self.spread = (self.nodes.astype(np.uint64) + np.uint64(1)) * _MIX[1]

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.listed.to_pylist())}

    def look_up(self, tokens: list[bytes] | pa.Array) -> np.ndarray:
        found = pc.index_in(tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.binary()), self.listed)
        return pc.fill_null(found, self.unlisted).to_numpy().astype(np.int64)

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word before and of the two words before each token; ``first`` marks tokens that begin a text."""
        one, two = before(ids, first, self.unlisted + 1)
        one_hash = (one.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        return one_hash, (one_hash ^ (two.astype(np.uint64) + np.uint64(1)) * _MIX[1]) * _MIX[2]

    def paths(self, ids: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(token, node, bit, depth, slots of two orders) of every decision of tokens in their contexts."""
        symbol = np.minimum(ids, self.head)
        size = self.size[symbol]
        token = np.repeat(np.arange(len(ids)), size)
        at = (self.start[symbol] - np.cumsum(size) + size)[token]
        at += np.arange(len(token))
        spread, slots = self.spread[at], []
        for context in contexts:
            mixed = context[token]
            mixed ^= spread
            mixed *= _MIX[2]
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MIX[0]
            mixed >>= np.uint64(64 - TABLE_BITS)
            slots.append(mixed.view(np.int64))
        return token, self.nodes[at], self.bits[at], self.depth[at], slots[0], slots[1]

    def decisions(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(token, node, bit, depth, slots of two orders) of every decision; ``first`` marks tokens that begin a text."""
        return self.paths(ids, self.contexts(ids, first))

    def steps(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[slice, tuple[np.ndarray, ...]]]:
        """The decisions of ``STEP_TOKENS`` tokens at a time, with these tokens' place; ``token`` counts from there."""
        contexts = self.contexts(ids, first)
        for a in range(0, len(ids), STEP_TOKENS):
            step = slice(a, min(a + STEP_TOKENS, len(ids)))
            yield step, self.paths(ids[step], [c[step] for c in contexts])


def chunks(texts: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of texts as tokens, up to CHUNK_TOKENS each, one by one; a longer text is a run of its own."""
    start, run, size = 0, [], 0
    for i, text in enumerate(texts):
        tokens = words(text)
        if run and size + len(tokens) > CHUNK_TOKENS:
            yield start, run
            start, run, size = i, [], 0
        run.append(tokens)
        size += len(tokens)
    if run:
        yield start, run


def flat(vocabulary: Words, run: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the tokens of a run of texts, marks of first tokens, number of each token's text."""
    sizes = np.array([len(t) for t in run])
    ids = np.concatenate([vocabulary.look_up(t) for t in run])
    first = np.zeros(len(ids), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    return ids, first, np.repeat(np.arange(len(run)), sizes)


def numbered(docs: DataFrame, vocabulary) -> DataFrame:
    """``docs`` with ``ids`` and ``unlisted`` in place of the text.

    ``ids`` are the numbers of a text's tokens, four bytes each, ``unlisted``
    the words outside of the dictionary, in their order.
    """
    at, rest = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    places = [docs.columns.index(c) for c in rest]
    schema = StructType(
        [docs.schema[i] for i in places]
        + [StructField("ids", BinaryType()), StructField("unlisted", ArrayType(BinaryType()))]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        for batch in slices(batches, SLICE):
            tokens, place = tokens_of(batch.column(at))
            numbers = own.look_up(tokens)
            unlisted = numbers >= own.unlisted
            lists = np.concatenate([[0], np.cumsum(unlisted)])[place]
            found = pa.BinaryArray.from_buffers(
                pa.binary(), len(place) - 1,
                [None, pa.py_buffer((4 * place).astype(np.int32)), pa.py_buffer(numbers.astype(np.int32))],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in places], found,
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), tokens.filter(pa.array(unlisted))),
                ],
                names=[*rest, "ids", "unlisted"],
            )

    return docs.mapInArrow(number, schema)


def numbers(docs: DataFrame, vocabulary) -> DataFrame:
    """(ids) of all rows of ``docs``, which has them or the texts."""
    return (docs if "ids" in docs.columns else numbered(docs.select("text"), vocabulary)).select("ids")


def runs(found: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts of up to CHUNK_TOKENS tokens what ``flat`` gives, from the numbers; a longer text is a run of its own."""
    texts = [np.frombuffer(v.as_buffer(), dtype=np.int32) for v in found]
    ends = np.cumsum([len(t) for t in texts])
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, side="right")))
        sizes = np.array([len(t) for t in texts[start:stop]])
        ids = np.concatenate(texts[start:stop]).astype(np.int64)
        first = np.zeros(len(ids), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        yield ids, first, np.repeat(np.arange(stop - start), sizes)
        start = stop


def bit_counts(docs: DataFrame, vocabulary) -> list[np.ndarray]:
    """Counts of (bit 0, bit 1) by node and by slot of the two hashed orders, over all rows of ``docs`` (text or ids).

    Every task sends its non-empty blocks; a reducing task adds up the blocks
    that it is dealt as they stream in, so it never holds more than the tables.
    """
    width = vocabulary.value.width
    sizes = [width * 2, 2 << TABLE_BITS, 2 << TABLE_BITS]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = vocabulary.value, [np.zeros(n, dtype=np.uint32) for n in sizes]
        for batch in batches:
            for ids, first, _ in runs(batch.column(0)):
                for _, (_, node, bit, _, *slots) in own.steps(ids, first):
                    for table, slot in zip(tables, (node, *slots)):
                        np.add.at(table, slot * 2 + bit, np.uint32(1))
        yield from blocks(tables)

    def blocks(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for t, table in enumerate(tables):
            for start in range(0, len(table), BLOCK):
                piece = table[start : start + BLOCK]
                if piece.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t * 100_000 + start // BLOCK], pa.int32()), pa.array([piece.tobytes()], pa.binary())],
                        names=["block", "counts"],
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                piece = np.frombuffer(raw.as_buffer(), dtype=np.uint32).astype(np.uint64)
                sums[block] = sums[block] + piece if block in sums else piece
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())],
                names=["block", "counts"],
            )

    schema = "block int, counts binary"
    added = numbers(docs, vocabulary).mapInArrow(fill, schema).repartition("block").mapInArrow(add, schema)
    tables = [np.zeros(n, dtype=np.uint32) for n in sizes]
    for row in added.toLocalIterator():
        t, start = divmod(row["block"], 100_000)
        piece = np.frombuffer(row["counts"], dtype=np.uint32)
        tables[t][start * BLOCK : start * BLOCK + len(piece)] = piece
    return [t.reshape(-1, 2) for t in tables]


class Mixer:
    """Gated logistic mixing of the predictors and the adaptive map behind it."""

    GATES = 8
    DEPTHS = 24

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.weights = np.tile(np.array(START), (self.GATES * self.GATES, 1))
        centres = np.linspace(-SPAN, SPAN, LEVELS)
        self.map = np.tile(1 / (1 + np.exp(-centres)), (self.DEPTHS, 1))

    def cell(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Place in the map of every decision, by its depth and its mix with ``START``."""
        mixed = np.clip(start, -SPAN, SPAN)
        cell = np.rint((mixed + np.float32(SPAN)) * np.float32((LEVELS - 1) / (2 * SPAN))).astype(np.int64)
        cell += np.minimum(depth, self.DEPTHS - 1) * LEVELS
        return cell

    def leave_out(self) -> None:
        """Log odds by slot and bit and sightings by slot, without one sighting of that bit, and empty sums."""
        self.odds, self.seen = [], []
        for table in self.tables:
            own = table.astype(np.float32)
            less = np.maximum(own - 1, 0)
            without = [(own[:, 1] + 0.4) / (less[:, 0] + 0.4), (less[:, 1] + 0.4) / (own[:, 0] + 0.4)]
            self.odds.append(np.log(np.stack(without, axis=1)).ravel())
            sightings = np.maximum(table.sum(axis=1, dtype=np.float32), 1)
            self.seen.append(np.minimum(np.log2(sightings).astype(np.uint8), self.GATES - 1))
        self.clear()

    def clear(self) -> None:
        """Empty sums."""
        self.slope, self.curve = np.zeros((3, self.GATES**2)), np.zeros((3, 3, self.GATES**2))
        self.observed = np.zeros(self.map.size * 2)

    def gate(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Gate by the log2 of the sightings after one word and after two."""
        return one * np.uint8(self.GATES) + two

    def add_up(self, decisions: tuple[np.ndarray, ...]) -> None:
        """Add decisions, each left out of its own counts, to the sums."""
        for a in range(0, len(decisions[1]), STRETCH):
            _, node, bit, depth, *slots = [d[a : a + STRETCH] for d in decisions]
            x = [odds[slot * 2 + bit] for odds, slot in zip(self.odds, (node, *slots))]
            self.observe(x, self.gate(self.seen[1][slots[0]], self.seen[2][slots[1]]), bit, depth)

    def observe(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, depth, times: np.ndarray | None = None) -> None:
        """Add decisions by their log odds in the contexts, each of them ``times`` times, to the sums."""
        gates, gate = self.GATES**2, gate.astype(np.int64)
        start = sum(np.float32(w) * odds for w, odds in zip(START, x))
        chance = 1 / (1 + np.exp(-start))
        error, curve = bit - chance, (chance * (1 - chance)).astype(np.float64)
        if times is not None:
            error, curve = error * times, curve * times
        x = [odds.astype(np.float64) for odds in x]
        for i in range(3):
            self.slope[i] += np.bincount(gate, error * x[i], gates)
            bent = curve * x[i]
            for j in range(i + 1):
                self.curve[i, j] += np.bincount(gate, bent * x[j], gates)
        self.observed += np.bincount(self.cell(start, depth) * 2 + bit, times, minlength=len(self.observed))

    def sums(self) -> np.ndarray:
        return np.rint(np.concatenate([s.ravel() for s in (self.slope, self.curve, self.observed)]) * FIXED).astype(np.int64)

    def learn(self, sums: np.ndarray) -> None:
        """Weights and map from the sums over all training texts."""
        gates = self.GATES**2
        slope, curve, observed = np.split(sums / FIXED, [3 * gates, 12 * gates])
        slope, half = slope.reshape(3, gates).T, curve.reshape(3, 3, gates).transpose(2, 0, 1)
        lower = np.tril(half)
        bent = lower + np.transpose(np.tril(half, -1), (0, 2, 1)) + PRIOR * np.eye(3)
        self.weights = self.weights + np.clip(np.linalg.solve(bent, slope[:, :, None])[:, :, 0], -1, 1)
        counts = observed.reshape(*self.map.shape, 2)
        self.map = (counts[:, :, 1] + PRIOR * self.map) / (counts.sum(axis=2) + PRIOR)

    def settle(self) -> None:
        """Log odds and amount of sightings of every slot, once, for scoring with fixed counts."""
        self.odds = [np.log((t[:, 1] + 0.4) / (t[:, 0] + 0.4), dtype=np.float32) for t in self.tables]
        self.seen = [
            np.minimum(np.log2(t.sum(axis=1, dtype=np.float32) + 1).astype(np.uint8), self.GATES - 1)
            for t in self.tables[1:]
        ]
        self.fix()

    def fix(self) -> None:
        """The weights and the map as they are now, for ``mix``."""
        self.columns = self.weights.T.astype(np.float32).copy()
        self.flat_map = self.map.astype(np.float32).ravel()

    def chances(self, decisions: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probability of every decision, after ``settle``."""
        _, node, bit, depth, one, two = decisions
        x = [odds[slot] for odds, slot in zip(self.odds, (node, one, two))]
        return self.mix(x, self.gate(self.seen[0][one], self.seen[1][two]), bit, depth)

    def mix(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, depth) -> np.ndarray:
        """Probability of decisions by their log odds in the contexts, after ``fix``."""
        mixed = start = np.float32(0)
        for weights, by_default, odds in zip(self.columns, START, x):
            mixed = mixed + weights.take(gate) * odds
            start = start + np.float32(by_default) * odds
        np.clip(mixed, -SPAN, SPAN, out=mixed)
        chance = 1 / (1 + np.exp(-mixed))
        chance += self.flat_map.take(self.cell(start, depth))
        chance = np.clip(chance / 2, 1e-6, 1 - 1e-6).astype(np.float64)
        return np.abs(chance - (1 - bit))

    def log10(self, decisions: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of the probability of every decision, after ``settle``."""
        return np.log10(self.chances(decisions))

    def token_log10(self, decisions: tuple[np.ndarray, ...], n: int) -> np.ndarray:
        """log10 of the probability of each of ``n`` tokens, after ``settle``; up to FACTORS decisions share a logarithm."""
        if not len(decisions[0]):
            return np.zeros(n)
        begin = np.flatnonzero((decisions[3] & (FACTORS - 1)) == 0)
        products = np.multiply.reduceat(self.chances(decisions), begin)
        return np.bincount(decisions[0][begin], weights=np.log10(products), minlength=n)


def fit_weights(docs: DataFrame, vocabulary, tables) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map from all rows of ``docs`` (text or ids); the tasks' sums are whole numbers, added up by Spark."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mixer = vocabulary.value, Mixer(tables.value)
        mixer.leave_out()
        for batch in batches:
            for ids, first, _ in runs(batch.column(0)):
                for _, decisions in own.steps(ids, first):
                    mixer.add_up(decisions)
        sums = mixer.sums()
        yield sums_of(mixer)

    return learned(numbers(docs, vocabulary).mapInArrow(add_up, "at int, value long"))


def sums_of(mixer: Mixer) -> pa.RecordBatch:
    """The sums of a task that are not zero."""
    sums = mixer.sums()
    at = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["at", "value"])


def learned(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map from the sums (at, value) of all tasks."""
    mixer = Mixer([])
    mixer.clear()
    total = mixer.sums()
    for row in sums.groupBy("at").agg(F.sum("value").alias("value")).collect():  # one row per sum at most
        total[row["at"]] = row["value"]
    mixer.learn(total)
    return mixer.weights, mixer.map


def fit_parts(blocks: DataFrame, paths, heat) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map from all that was learned of all parts, every decision left out of its own counts."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer([])
        mixer.clear()
        for part in parts_of(batches, paths.value, heat.value):
            times = part.learned
            for at, odds, one, two, bit, depth in part.decisions(times > 0, 1):
                mixer.observe(towards_one(odds, bit), mixer.gate(one, two), bit, depth, times.take(at))
        yield sums_of(mixer)

    return learned(blocks.mapInArrow(add_up, "at int, value long"))


def towards_one(odds: tuple[np.ndarray, ...], bit: np.ndarray) -> list[np.ndarray]:
    """Log odds of bit 1 from those of the bit itself."""
    sign = (2 * bit - 1).astype(np.float32)
    return [x * sign for x in odds]


def part_scores(blocks: DataFrame, paths, heat, weights) -> DataFrame:
    """(_row, mixed): log10 of the probability of all tokens of every text, as whole ``UNIT``s, over all parts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer([])
        mixer.weights, mixer.map = weights
        mixer.fix()
        for part in parts_of(batches, paths.value, heat.value):
            wanted = part.occurs > 0
            chance, logs = np.ones(len(wanted)), np.zeros(len(wanted))
            deepest = 0
            for at, odds, one, two, bit, depth in part.decisions(wanted, 0):
                if depth > deepest and depth % FACTORS == 0:
                    logs += np.log10(chance)
                    chance[:] = 1
                deepest = depth
                chance[at] = chance.take(at) * mixer.mix(towards_one(odds, bit), mixer.gate(one, two), bit, depth)
            logs += np.log10(chance)
            units = np.rint(logs / UNIT)
            row, text = np.unique(part.row, return_inverse=True)
            sums = np.bincount(text, weights=units[part.place]).astype(np.int64)
            many, begin = np.unique(row >> TEXT_BITS, return_index=True)
            ends = [*begin[1:], len(row)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(many, pa.int64()), pa.array([b - a for a, b in zip(begin, ends)], pa.int32()),
                    pa.array([pack([np.diff(row[a:b], prepend=0), sums[a:b]]) for a, b in zip(begin, ends)], pa.binary()),
                ],
                names=["texts", "n", "data"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for texts, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                row, sums = unpack(data, n, [np.int64, np.int64])
                if texts not in totals:
                    totals[texts] = np.zeros((2, 1 << TEXT_BITS), dtype=np.int64)
                at = np.cumsum(row) - (texts << TEXT_BITS)
                totals[texts][0, at] = 1
                totals[texts][1, at] += sums
        for texts, (there, sums) in totals.items():
            at = np.flatnonzero(there)
            yield pa.RecordBatch.from_arrays([pa.array(at + (texts << TEXT_BITS)), pa.array(sums[at])], names=["_row", "mixed"])

    found = blocks.mapInArrow(score, "texts long, n int, data binary")
    return found.repartition("texts").mapInArrow(add, "_row long, mixed long")


def base_scores(rows: DataFrame, paths) -> DataFrame:
    """``rows`` with tokens, known tokens and the sum of log10 (count + 1) in place of the words' numbers."""
    at, kept = rows.columns.index("ids"), [c for c in rows.columns if c != "ids"]
    schema = StructType([rows.schema[c] for c in kept])
    for name, kind in (("n_tokens", LongType()), ("n_known", LongType()), ("logs", DoubleType())):
        schema = schema.add(name, kind)
    places = [rows.columns.index(c) for c in kept]

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = paths.value
        for batch in batches:
            parts = [(np.empty(0),) * 3]
            for ids, _, text in runs(batch.column(at)):
                add = lambda values: np.bincount(text, weights=values)
                parts.append((np.bincount(text), add(ids < own.known), add(np.log10(own.counts(ids) + 1))))
            tokens, known, logs = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in places], pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)),
                    pa.array(logs),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(base, schema)


def score_documents(docs: DataFrame, divisor: int = 7, held: int = 2) -> DataFrame:
    """One row per document with its base score, its score by the mixed model, and bits per byte.

    Learns from the rows whose crc32 of the id is not ``held`` modulo
    ``divisor``. A null text counts as empty (one end), a null id as an empty
    one; equal rows are scored each, an empty table gives no rows. A table
    without a training text has probability one for every word. Texts may be
    longer than a part; further columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn(
        "held_out", remainder(F.col("doc_id"), divisor) == held
    )
    with freed_shuffles(spark):
        return written_once(spark, lambda: _scores(rows.withColumn("n_bytes", F.octet_length("text").cast("long"))))


def _scores(docs: DataFrame) -> DataFrame:
    context = docs.sparkSession.sparkContext
    counts = materialise(token_counts(docs.where(~F.col("held_out"))))
    levels = [(r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()]
    n, v = sum(c * k for c, k in levels), sum(k for _, k in levels)
    listed, listed_counts = frequent(counts, DICTIONARY)
    own = Words(listed, listed_counts, n, v)
    vocabulary, paths = context.broadcast(own), context.broadcast(Paths(own, levels, huffman))
    others = counts.where(F.col("c") < listed_counts[-1]) if listed else counts

    def numbers_of_all() -> DataFrame:
        rows = materialise(numbered(docs, vocabulary).withColumn("_row", F.monotonically_increasing_id()))
        return numbered_whole(rows, others, len(listed), v)

    rows = written_once(docs.sparkSession, numbers_of_all)
    size = rows.agg(
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.count(F.lit(1)).alias("texts"),
        F.count(F.when(~F.col("held_out"), 1)).alias("learned"),
    ).first()
    parts = 1 + (size["n_bytes"] + WORD_BYTES * size["texts"]) // PART_BYTES
    heat = Heat(paths.value, size["learned"], parts, HOT)
    hot = after_hot(rows, paths, heat, runs, FLUSH_TOKENS)
    heat = context.broadcast(heat)
    blocks = dealt(rows, hot, paths, heat, runs, FLUSH_TOKENS)
    weights = fit_parts(blocks, paths, heat)
    mixed = materialise(part_scores(blocks, paths, heat, weights))
    base = F.log10(F.lit(float(n + v + 1)))
    scores = base_scores(rows, paths).join(mixed, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("mixed") * UNIT).alias("score"), "n_bytes",
    )
    per_byte = -F.col("score") / LOG10_2 / F.greatest("n_bytes", F.lit(1))
    return scores.withColumn("bits_per_byte", per_byte).drop("n_bytes")
