"""Exact Jaccard join of documents' word n-gram sets, by pivots and their regions.

1 - Jaccard similarity is a metric. A group of documents is joined by choosing
pivots, measuring every member against them, and giving each member to the
region of its nearest pivot; a member whose distance to another pivot is within
twice the join radius of its nearest one could be linked across the border and
is replicated to that region too. There is one such round, for groups that stay
large; small regions compare what is left, larger ones meet in pairs of chunks. Members that are known to be
connected need no comparison, so a pivot in the middle of thousands of near
copies settles all of them with one comparison each.

Documents without a common n-gram are at distance one from each other, and no
pivot tells them apart. So the first regions are found by a pigeonhole
argument: sets of sizes a <= b that are linked differ in at most (a + b) / 19
elements (for similarity 0.9), so of a few more parts than that, dealt by a hash
of the elements, some at least are equal. Sets with an equal part form a group.
Groups that stay large after a round of pivots are cut by the prefix of their
members' n-grams that are rarest within the group, which is exact as well.

Nothing is capped or dropped: every pair of linked documents is connected by
links that were verified on whole sets of 64-bit hashes of the n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import in_batches, row_key, whole_text

PIVOTS = 2
#: Groups of so many members compare their pairs in the first round.
FIRST_LEAF = 8
#: Regions of so many members join in one task later on.
LEAF = 2048
#: Fewest slices of a sketch, and n-grams a slice at most on average in larger ones.
SLICES = 128
A_SLICE = 4
#: Cells of the table of n-gram counts, and those that are added up at a time.
CELLS = 1 << 20
#: Bits of the table that tells tasks which texts are wanted (8 MB, whatever the input).
MARKS = 1 << 26
PIECE = 1 << 14
COLUMNS = 2048
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_ODD = np.uint64(0x100000001B3)
_ODD_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        _POWERS["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD)]), dtype=np.uint64)
        _POWERS["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD_INVERSE)]), dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[i]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text; with fewer words, of all words as one.

    Words are what stands between ASCII white space, with A-Z lower-cased. A
    word's hash is a polynomial of its bytes, taken from running sums.
    """
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    words = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[3], 0)
    if len(words) < width:
        total = np.array([len(words)], dtype=np.uint64)
        for i in range(len(words)):
            total = _mixed(total * _ODD ^ words[i : i + 1], 1)
        return total
    grams = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        grams = _mixed(grams * _ODD ^ words[i : len(words) - width + 1 + i], 1)
    return np.unique(grams)


class Parts:
    """The pigeonhole: size classes, and for each the number of parts.

    Class k holds sizes from l to l / threshold; linked sets are in one class or
    in neighbouring ones, so a set has parts for its own class and for the one
    below. With ``spare`` more parts than the pigeonhole needs, ``spare`` + 1
    parts agree at least. So the last ``spare`` parts of a set in an order common
    to all sets need not be matched: at least one that agrees comes before them
    in both sets. The order is by the number of n-grams in a part, so the parts left out are
    those that are empty or hold one n-gram, which agree by chance most often.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.tops: list[int] = []

    def _grow(self, n: int) -> None:
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(low * 100 // self.percent)

    def differing(self, top: int) -> int:
        """Most elements by which linked sets differ, if the smaller one has ``top`` elements or fewer."""
        return (top * (100 + self.percent) * (100 - self.percent)) // (self.percent * (100 + self.percent))

    @lru_cache(maxsize=4096)
    def layout(self, k: int) -> tuple[int, int]:
        """(parts, spare) of class k; no parts if its sets link with equal ones only."""
        top = self.tops[k]
        needed = self.differing(top) + 1
        if needed == 1:
            return 0, 0
        spare = 1
        for _ in range(4):
            parts = needed + spare
            empty = parts * math.exp(-max(1.0, top * self.percent / 100) / parts)
            spare = math.ceil(1 + empty + 4 * math.sqrt(empty))
        return needed + spare, spare

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if not n:
            return np.empty(0, dtype=np.uint64)
        self._grow(n)
        own = int(np.searchsorted(self.tops, n))
        out = []
        spread = _mixed(grams, 2)
        for k in (own, own - 1):
            parts, spare = self.layout(k) if k >= 0 else (0, 0)
            if not parts:
                continue
            part = ((spread >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            size = np.bincount(part, minlength=parts)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(grams, 3)[order], dtype=np.uint64)])
            ends = np.cumsum(size)
            total = sums[ends] - sums[ends - size]
            place = np.arange(parts, dtype=np.uint64) * _MIX[1] + np.array([k * 1_000_003 + 17], dtype=np.uint64) * _MIX[0]
            found = _mixed(_mixed(total, 0) ^ place, 2)
            out.append(found[np.lexsort((found, -size))[: parts - spare]])
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def listed_sets(docs: DataFrame, width: int, percent: int, with_parts: bool) -> DataFrame:
    """(row, doc_id, n_shingles, set, sigs) of every document; a task lists the parts of equal sets once.

    The parts are by far the larger output, and making them twice costs less
    than storing them: they are left out where only the sets are asked for.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["row", "doc_id", "n_shingles", "set", "sigs"]

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, none = Parts(percent), set(), np.empty(0, dtype=np.int64)
        for batch in batches:
            sizes, sets, sigs = [], [], []
            for text in batch.column(2):
                grams = shingle_set(text.as_py(), width)
                number = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None
                sizes.append(len(grams))
                sets.append(number)
                sigs.append(none if not with_parts or number in seen else parts.signatures(grams).view(np.int64))
                seen.add(number)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=names,
            )

    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", whole_text().alias("text"))
    return keyed.mapInArrow(
        listing, f"row binary, doc_id {kind.simpleString()}, n_shingles long, set long, sigs array<long>"
    )


def first_groups(listed: DataFrame) -> DataFrame:
    """(g, set): the sets that share a part with a different set. Parts are sorted once and read as a stream."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, member, from_before = np.empty(0, np.int64), np.empty(0, np.int64), False

        def rows(sig, member, from_before, at_end):
            """Rows whose part has another set; the last row waits for what follows it."""
            same = sig[1:] == sig[:-1]
            keep = np.concatenate([[from_before], same]) | np.concatenate([same, [False]])
            if not at_end:
                keep[-1] = False
            return sig[keep], member[keep]

        for batch in batches:
            sig = np.concatenate([sig, batch.column(0).to_numpy()])
            member = np.concatenate([member, batch.column(1).to_numpy()])
            if not len(sig):
                continue
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])])
            sig, member = sig[fresh], member[fresh]
            g, s = rows(sig, member, from_before, False)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s)], names=["g", "set"])
            from_before = bool(len(sig) > 1 and sig[-1] == sig[-2]) or (from_before and len(sig) == 1)
            sig, member = sig[-1:], member[-1:]
        if len(sig):
            g, s = rows(sig, member, from_before, True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s)], names=["g", "set"])

    parts = listed.select(F.explode("sigs").alias("sig"), "set")
    return parts.repartition("sig").sortWithinPartitions("sig", "set").mapInArrow(shared, "g long, set long")


def distinct_groups(groups: DataFrame) -> DataFrame:
    """``groups`` without those of one member and without repeated ones (equal in number and hashes of members)."""
    mark = groups.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set")).alias("x"),
        F.bit_xor(F.xxhash64(F.col("set"), F.lit(7))).alias("y"),
    )
    first = mark.where(F.col("n") > 1).groupBy("n", "x", "y").agg(F.min("g").alias("g"))
    return groups.join(materialise(first.select("g")), "g")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (row, text) whose ``row`` may be in ``wanted``, so that the other texts are not shuffled.

    The table of marks has a fixed size; with more rows wanted than it can tell
    apart, more texts pass. A join has to follow.
    """
    mark = F.pmod(F.xxhash64("row"), F.lit(MARKS)).alias("mark")
    cells = wanted.select(mark).select(
        F.shiftright("mark", 5).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(mark & 31 as int))").alias("bit")
    )
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # MARKS bits
    table = np.zeros(MARKS // 32, dtype=np.uint32)
    table[found["cell"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    marks = rows.sparkSession.sparkContext.broadcast(table)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            held = (marks.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield batch.select(["row", "text"]).filter(pa.array(held.astype(bool)))

    return rows.select("row", "text", mark).mapInArrow(choose, "row binary, text string")


def sets_of(docs: DataFrame, listed: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(set, grams, n, sketch) for the sets in ``members``: the n-grams are made again from one text of each.

    Every set is one row, also if the document it is made from is stored several
    times. Texts are chosen in one stage and cut in another, also if the chosen
    rows are few: a task that did both would hold two Python workers, and an
    executor keeps those it has started.
    """
    stored = listed.join(members, "set", "left_semi").groupBy("set", "row").agg(F.count(F.lit(1)).alias("stored"))
    chosen = materialise(stored.groupBy("set").agg(F.min(F.struct("row", "stored")).alias("one")).select("set", "one.*"))
    rows = chosen.where(F.col("stored") == 1).select("set", "row")
    several = chosen.where(F.col("stored") > 1).select("set", "row")
    texts = marked(
        docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), whole_text().alias("text")), chosen
    )

    def grams(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t.as_py(), width) for t in batch.column(1)]
        return {
            "set": batch.column(0), "grams": [x.tobytes() for x in found], "n": [len(x) for x in found],
            "sketch": [sketch(x) for x in found],
        }

    found = texts.join(rows.hint("merge"), "row").select("set", "text")
    if not several.isEmpty():
        repeated = texts.join(several.hint("merge"), "row").groupBy("set").agg(F.first("text").alias("text"))
        found = found.unionByName(repeated)
    return in_batches(found, "set long, grams binary, n long, sketch binary", grams)


def sketch(grams: np.ndarray) -> bytes:
    """Number of n-grams in each slice of the hashes, a byte each.

    The slices are pivots too: a set's differences to another one are at least
    the sum of the differences of these numbers. Their number is a power of two
    that grows with the set, as few slices cannot tell large sets apart;
    ``folded`` brings two sketches to the same slices.
    """
    slices = max(SLICES, 1 << (max(1, len(grams) // A_SLICE) - 1).bit_length())
    spread = (_mixed(grams, 1) >> np.uint64(16)).astype(np.int64)
    while (found := np.bincount(spread & (slices - 1), minlength=slices)).max() > 255:
        slices *= 2
    return found.astype(np.uint8).tobytes()


def folded(found: np.ndarray, slices: int) -> np.ndarray:
    return found.reshape(-1, slices).sum(axis=0, dtype=np.int64)


def near_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes leave it possible that they are linked."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (v, w) in enumerate(zip(batch.column(3), batch.column(5))):
                x, y = (np.frombuffer(q.as_buffer(), dtype=np.uint8) for q in (v, w))
                slices = min(len(x), len(y))
                apart[i] = np.abs(folded(x, slices) - folded(y, slices)).sum()
            both = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(100 * (both - apart) >= percent * (both + apart)))

    left = sets.select(F.col("set").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    right = sets.select(F.col("set").alias("b"), "n", F.col("sketch").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "m", "x", "n", "y")
    return met.mapInArrow(possible, "a long, b long")


def distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance) of pairs of sets, from their whole n-gram sets."""

    def measure(batch: pa.RecordBatch) -> dict:
        linked, distance = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            union = len(p) + len(q) - both
            linked.append(100 * both >= percent * union)
            distance.append(1.0 - both / max(union, 1))
        return {"a": batch.column(0), "b": batch.column(1), "linked": linked, "distance": distance}

    pairs = materialise(pairs)
    left = sets.join(materialise(pairs.select(F.col("a").alias("set")).distinct()), "set", "left_semi")
    right = sets.join(materialise(pairs.select(F.col("b").alias("set")).distinct()), "set", "left_semi")
    left = left.select(F.col("set").alias("a"), F.col("grams").alias("x"))
    right = right.select(F.col("set").alias("b"), F.col("grams").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return in_batches(met, "a long, b long, linked boolean, distance double", measure)


def components(links: DataFrame) -> DataFrame:
    """(set, comp): smallest set reachable over ``links`` (a, b), for every set that has a link.

    Alternates large and small stars: each round hooks neighbours to the
    smallest one they know, until every set hangs on the smallest of its
    component. All of it is joins and partial aggregates over the links.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(materialise(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where(F.col("u") != F.col("v")).distinct())
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialise(after.where(F.col("u") != F.col("v")).distinct())
        open_sets = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        edges = after
        if open_sets.isEmpty() and several.isEmpty():
            break
    roots = edges.select(F.col("v").alias("set"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("set"), F.col("v").alias("comp")).unionByName(roots)


def gram_counts(grams: DataFrame) -> np.ndarray:
    """How often the members hold the n-grams of each of ``CELLS`` cells of the hashes: a table of fixed size.

    A task counts into one such table, whatever it reads; the tables are added up in pieces.
    """
    schema = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for v in batch.column(0):
                total += np.bincount(_cells(np.frombuffer(v.as_buffer(), np.uint64)), minlength=CELLS)
        pieces = total.reshape(-1, PIECE)
        held = np.flatnonzero(pieces.any(axis=1))
        rows = [pieces[i].astype(np.uint32).tobytes() for i in held]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(rows, pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[piece] = total.get(piece, 0) + np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64)
        rows = [x.tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    counted = grams.mapInArrow(count, "piece int, counts binary")
    found = np.zeros(CELLS, np.int64)
    for row in counted.repartition("piece").mapInArrow(add, "piece int, counts binary").collect():  # CELLS numbers
        found[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(row["counts"], np.int64)
    return found


def _cells(grams: np.ndarray) -> np.ndarray:
    return (_mixed(grams, 2) >> np.uint64(32)).astype(np.int64) & (CELLS - 1)


def rare_prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(g, set): groups of the sets in ``members`` that share one of their rarest n-grams.

    Linked sets of which one has n elements share at least one of the first
    n - ceil(n * threshold) + 1 in any common order, here that of ``gram_counts``
    and then of the hash; sets that share no such one need not meet. Only these
    n-grams leave a task.
    """
    chosen = materialise(sets.join(materialise(members), "set", "left_semi").select("set", "grams"))
    often = chosen.sparkSession.sparkContext.broadcast(gram_counts(chosen.select("grams")).astype(np.float32))

    def first(batch: pa.RecordBatch) -> dict:
        names, found = [], []
        for name, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams = np.frombuffer(v.as_buffer(), dtype=np.uint64)
            size = len(grams) - -(-len(grams) * percent // 100) + 1
            found.append(grams[np.lexsort((grams, often.value[_cells(grams)]))[:size]].view(np.int64))
            names.append(np.full(len(found[-1]), name, np.int64))
        none = np.empty(0, np.int64)
        return {"g": np.concatenate(found or [none]), "set": np.concatenate(names or [none])}

    return in_batches(chosen, "g long, set long", first)


def unsettled(groups: DataFrame, known: DataFrame | None) -> DataFrame:
    """(g, set, comp, n): the groups whose members are not all connected yet."""
    comp = F.col("set")
    if known is not None:
        groups, comp = groups.join(known, "set", "left"), F.coalesce("comp", "set")
    placed = groups.select("g", "set", comp.alias("comp"))
    mark = placed.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
    mark = materialise(mark.where(F.col("low") != F.col("high")).select("g", "n"))
    return materialise(placed.join(mark, "g"))


def region_links(percent: int):
    """Links inside of one region of bounded size, as few as connect what is linked.

    Common elements are counted by products of 0/1 matrices over the n-grams
    that two members have, in runs of columns; no pair leaves the task unless it
    is linked and joins two parts that were not connected yet.
    """

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names, comps = table["set"].to_numpy(), table["comp"].to_numpy()
        grams = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table["grams"]]
        sizes = np.array([len(x) for x in grams], dtype=np.int64)
        rows = np.repeat(np.arange(len(grams)), sizes)
        _, column, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        place = np.cumsum(often > 1) - 1
        rows, column = rows[often[column] > 1], place[column[often[column] > 1]]
        both = np.zeros((len(grams), len(grams)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((len(grams), COLUMNS), dtype=np.float32)
            part[rows[lo:hi], column[lo:hi] - start] = 1
            both += part @ part.T
        whole = both.astype(np.int64)
        linked = 100 * whole >= percent * (sizes[:, None] + sizes[None, :] - whole)
        left, right = np.nonzero(np.triu(linked & (comps[:, None] != comps[None, :]), 1))
        root = {c: c for c in comps.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = find(comps[i].item()), find(comps[j].item())
            if x != y:
                root[x] = y
                out.append((names[i].item(), names[j].item()))
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return join


def near_members(percent: int):
    """The members of a region of bounded size whose sketch leaves a link to one of another component possible.

    Sketches are compared at the fewest slices first, then what remains at more.
    """

    def choose(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comps, sizes = table["comp"].to_numpy(), table["n"].to_numpy()
        sketches = [np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in table["sketch"]]
        widths = np.array([len(x) for x in sketches])
        near = comps[:, None] != comps[None, :]
        slices = SLICES
        while slices <= widths.max():
            at = np.flatnonzero((widths >= slices) & near.any(axis=1))
            if not len(at):
                break
            found = np.stack([folded(sketches[i], slices) for i in at]).astype(np.int32)
            step = max(1, (1 << 22) // found.size)
            for start in range(0, len(at), step):
                own = at[start : start + step]
                apart = np.abs(found[start : start + step, None, :] - found[None, :, :]).sum(axis=2, dtype=np.int64)
                both = sizes[own][:, None] + sizes[at][None, :]
                near[np.ix_(own, at)] &= 100 * (both - apart) >= percent * (both + apart)
            slices *= 2
        return table.select(["g", "set", "comp"]).filter(pa.array(near.any(axis=1)))

    return choose


def chunk_pairs(large: DataFrame, size: int) -> DataFrame:
    """Regions of at most ``2 * size`` members, so that every two members of a group meet in one of them."""
    chunks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("set", F.lit(3)), chunks).cast("int")
    met = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pair = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    return met.where((F.col("own") != F.col("other")) | (chunks == 1)).select(pair.alias("g"), "set")


def linked_sets(
    groups: DataFrame, sets: DataFrame, percent: int, first_leaf: int = FIRST_LEAF, leaf: int = LEAF
) -> DataFrame:
    """(a, b): verified links that connect all sets of ``groups`` that are connected by links.

    First round: members are measured against one pivot of their group, in large
    groups a few, those that share most groups; then small groups compare what
    is unconnected, each pair once over all groups. Second: the members of
    unsettled large groups are grouped anew by their rarest n-grams; a group up to ``leaf`` joins in one
    task, a larger one is split into the regions of its pivots. Third: regions
    that are still larger, as all their members are about as far from each
    other, are cut into chunks that meet in pairs. Only what is not connected is
    carried on, and no round depends on how many members a group has.
    """
    degree = materialise(groups.groupBy("set").agg(F.count(F.lit(1)).alias("degree")))
    radius = 1 - percent / 100
    links: list[DataFrame] = []

    def linked() -> DataFrame:
        return reduce(DataFrame.unionByName, links)

    def measured_pivots(active: DataFrame, single_to: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members against the pivots of their group, one for groups up to ``single_to`` members."""
        place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("degree"), "set"))
        most = F.when(F.col("n") <= single_to, 1).otherwise(PIVOTS)
        ranked = active.select("g", "set", "n").join(degree, "set").withColumn("_p", place).where(F.col("_p") <= PIVOTS)
        pivots = materialise(ranked.where(F.col("_p") <= most).select("g", F.col("set").alias("pivot")))
        met = active.select("g", "set").join(pivots, "g").where(F.col("set") != F.col("pivot"))
        met = met.withColumns({"a": F.least("set", "pivot"), "b": F.greatest("set", "pivot")})
        asked = materialise(met.select("a", "b").distinct())
        near = asked if single_to == 0 else near_enough(asked, sets, percent)
        measured = materialise(distances(near, sets, percent))
        links.append(measured.where("linked").select("a", "b"))
        return pivots, met, measured

    def joined(regions: DataFrame) -> None:
        sketched = regions.select("g", "set", "comp").join(sets.drop("grams"), "set")
        near = sketched.groupBy("g").applyInArrow(near_members(percent), "g long, set long, comp long")
        members = materialise(near).join(sets, "set").select("g", "set", "comp", "grams")
        links.append(materialise(members.groupBy("g").applyInArrow(region_links(percent), "a long, b long")))

    active = unsettled(groups, None)
    measured_pivots(active, first_leaf)
    left = unsettled(groups, components(linked()))
    small = left.where(F.col("n") <= first_leaf)
    other = small.select("g", F.col("set").alias("b"), F.col("comp").alias("comp_b"))
    pairs = small.join(other, "g").where((F.col("set") < F.col("b")) & (F.col("comp") != F.col("comp_b")))
    pairs = materialise(pairs.select(F.col("set").alias("a"), "b").distinct())
    links.append(materialise(distances(near_enough(pairs, sets, percent), sets, percent)).where("linked").select("a", "b"))
    left = unsettled(left.where(F.col("n") > first_leaf).select("g", "set"), components(linked()))
    if left.isEmpty():
        return linked()
    groups = materialise(distinct_groups(materialise(rare_prefixes(left.select("set").distinct(), sets, percent))))
    active = unsettled(groups, components(linked()))
    joined(active.where(F.col("n") <= leaf))
    large = active.where(F.col("n") > leaf)
    if large.isEmpty():
        return linked()
    pivots, met, measured = measured_pivots(large, 0)
    away = met.join(measured.select("a", "b", "distance"), ["a", "b"])
    away = materialise(away.join(pivots.select("g", F.col("pivot").alias("set")), ["g", "set"], "left_anti"))
    nearest = materialise(away.groupBy("g", "set").agg(F.min("distance").alias("nearest")))
    inside = away.join(nearest, ["g", "set"]).where(F.col("distance") <= F.col("nearest") + 2 * radius + 1e-9)
    regions = materialise(distinct_groups(materialise(inside.select(F.xxhash64("g", "pivot").alias("g"), "set"))))
    active = unsettled(regions, components(linked()))
    cut = chunk_pairs(active.where(F.col("n") > leaf), leaf // 2)
    whole = active.where(F.col("n") <= leaf).select("g", "set")
    joined(unsettled(materialise(whole.unionByName(cut)), components(linked())))
    return linked()


def document_sets(
    docs: DataFrame, width: int, percent: int, first_leaf: int = FIRST_LEAF, leaf: int = LEAF
) -> DataFrame:
    """(row, doc_id, n_shingles, comp): the component of every document's set, null for an empty set."""
    listed = materialise(listed_sets(docs, width, percent, with_parts=False).drop("sigs"))
    parts = listed_sets(docs, width, percent, with_parts=True)
    groups = materialise(distinct_groups(materialise(first_groups(parts))))
    members = materialise(groups.select("set").distinct())
    sets = materialise(sets_of(docs, listed, members, width))
    comps = materialise(components(linked_sets(groups, sets, percent, first_leaf, leaf)))
    own = listed.select("row", "doc_id", "n_shingles", "set").join(comps, "set", "left")
    return materialise(own.select("row", "doc_id", "n_shingles", F.coalesce("comp", "set").alias("comp")))


def linked_documents(
    docs: DataFrame, width: int = 3, percent: int = 90, first_leaf: int = FIRST_LEAF, leaf: int = LEAF
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A set holds the distinct ``width``-word n-grams; documents link when their
    sets' intersection is ``percent`` of their union or more. component_id is
    the smallest doc_id that is reachable by links. A text without words (null,
    empty) has an empty set and is its own component; rows equal in id are in
    one component if their texts link. A null id never names a component unless
    it stands alone. An empty table gives no rows; other columns are not read.
    """
    own = document_sets(docs, width, percent, first_leaf, leaf)
    least = own.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return own.join(materialise(least), "comp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of every component: that of the smallest doc_id (a null id comes last).

    Documents without words are linked with nothing and all stay; of repeated
    rows one stays. The rows that stay are unchanged, whatever their columns.
    """
    own = document_sets(docs, width, percent).where(F.col("comp").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = materialise(own.groupBy("comp").agg(first.alias("first")).select(F.col("first.row").alias("row")))
    packed = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("row"),
        whole_text().rlike(r"[^\x20\x09-\x0D]").alias("worded"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"),
    )
    worded = packed.where("worded").join(stay, "row").groupBy("row").agg(F.first("kept").alias("kept")).select("kept")
    rest = packed.where(~F.col("worded")).select("kept")
    return worded.unionByName(rest).select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])
