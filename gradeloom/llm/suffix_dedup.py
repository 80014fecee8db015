"""Removal of byte strings that repeat, with suffix arrays sorted in two stages.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is
removed. Suffixes are dealt by content: among the hashes of the 64-byte strings
in the first ``LENGTH`` bytes of a suffix, the smallest one (the last of equal
ones) is its anchor, so equal strings have anchors of equal hash at the same
place. Consecutive suffixes with one anchor are a region. Regions whose anchor's
hash stands at one place only hold no repeat and end there; equal regions are
counted before anything is sorted and only one of them goes on.

The regions of a hash then meet in one block, in which the suffixes are sorted
in two stages: those smaller than their successor are sorted directly, the
others are induced by scanning the buckets of first bytes in order, as a suffix
that is larger than its successor follows from the successor's place. Adjacent
suffixes with a common prefix of ``LENGTH`` bytes or more are repeats.

A hash with very many different regions is cut further by the anchors of
independent hashes, which equal strings share as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import in_batches, row_key, whole_text

LENGTH = 400
GRAM = 64
#: Bytes that are sorted at a time; a group of regions stays together.
BLOCK_BYTES = 300_000
#: Different regions of a hash from which on they are cut by further hashes.
MANY_REGIONS = 512
SEPARATOR = b"\xff"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def doubled_hashes(data: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """Hashes of the strings of 1, 2, 4 ... 2^levels bytes at every place where they fit."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    h ^= h >> np.uint64(32)
    yield h
    for k in range(levels):
        n = len(h) - (1 << k)
        if n <= 0:
            return
        h = h[:n] * _MIX[1] + h[len(h) - n :] * _MIX[2]
        h ^= h >> np.uint64(29)
        yield h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def regions(data: np.ndarray, length: int, gram: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the runs of starts whose ``length``-byte strings have one anchor."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for h in doubled_hashes(data, gram.bit_length() - 1):
        pass
    h = h * _MIX[seed]
    h ^= h >> np.uint64(31)
    width = length - gram + 1
    least = sliding_least(h, width)
    fresh = h[width - 1 :] == least
    fresh[1:] |= least[1:] != least[:-1]
    fresh[0] = True
    first = np.flatnonzero(fresh)
    return least[first].view(np.int64), first, np.append(first[1:], len(least)) - 1


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, text_key, first, last) of all regions; a task lists equal texts once."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                hashes, first, last = regions(np.frombuffer(text.as_buffer(), dtype=np.uint8), length, gram)
                if len(hashes):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes), pa.array([key] * len(hashes), pa.binary()),
                            pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                        ],
                        names=["hash", "text_key", "first", "last"],
                    )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in listing(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    keyed = docs.select(F.unhex(F.md5(whole_text())).alias("text_key"), F.encode(whole_text(), "utf-8").alias("raw"))
    return keyed.where(F.octet_length("raw") >= length).mapInArrow(
        gathered, "hash long, text_key binary, first int, last int"
    )


def repeated_anchors(found: DataFrame) -> DataFrame:
    """The regions whose hash stands at two places or more; places in equal texts are one place.

    Of every hash only the least and the largest place (hashed to 64 bits) are
    kept, which combine before the shuffle. So a passage in very many documents
    goes through no single task: the join back is broadcast or its skewed side split.
    """
    found = materialise(found)
    place = F.xxhash64("text_key", "first")
    ends = found.groupBy("hash").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    several = materialise(ends.where(F.col("least") != F.col("most")).select("hash"))
    return found.join(several, "hash", "left_semi")


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step = np.append(step, -1)  # the last suffix is larger than the empty one
    place = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(place[::-1])[::-1]
    smaller = step[ahead] > 0  # than the successor
    raw = text.tobytes()
    direct = np.flatnonzero(smaller)
    keys = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    edges = np.searchsorted(text[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced, last = list(pending[c]), pending[c]
        while last:
            before = np.concatenate(last) - 1
            before = before[before >= 0]
            before = before[text[before] == c]
            last = [before] if len(before) else []
            induced += last
        bucket = np.concatenate([*induced, direct[edges[c] : edges[c + 1]]]) if induced else direct[edges[c] : edges[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        first = text[before]
        larger = first > c
        before, first = before[larger], first[larger]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            if len(part):
                pending[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each pair of places, up to 2 * 2^levels - 1 >= ``most``."""
    levels = list(doubled_hashes(text, most.bit_length() - 1))
    length = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        h, size = levels[k], len(levels[k])
        a, b = left + length, right + length
        fits = (a < size) & (b < size)
        same = np.zeros(len(left), dtype=bool)
        same[fits] = h[a[fits]] == h[b[fits]]
        length += same * (1 << k)
    return length


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece a mask of its starts whose ``length``-byte string also starts elsewhere in ``pieces``."""
    text = np.frombuffer(SEPARATOR.join(pieces) + SEPARATOR, dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    start = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(start, begin, 1)
    np.add.at(start, begin + np.maximum(sizes - length + 1, 0), -1)
    inside = np.cumsum(start[:-1]) > 0
    order = sorted_suffixes(text, length)
    order = order[inside[order]]
    again = np.zeros(len(text), dtype=bool)
    if len(order) > 1:
        equal = common_prefixes(text, order[:-1], order[1:], length) >= length
        again[order[:-1][equal]] = True
        again[order[1:][equal]] = True
    return [again[b : b + max(0, s - length + 1)] for b, s in zip(begin, sizes)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def region_spans(cut: DataFrame, length: int) -> DataFrame:
    """(row, first, last): runs of repeated starts, from regions (part, row, first, piece) dealt by ``part``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part = 0, None

        def settle() -> pa.RecordBatch:
            rows, firsts, lasts = [], [], []
            for (row, first, _), mask in zip(held, repeated_starts([h[2] for h in held], length)):
                for a, b in zip(*_runs(mask)):
                    rows.append(row)
                    firsts.append(first + int(a))
                    lasts.append(first + int(b))
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                names=["row", "first", "last"],
            )

        for batch in batches:
            for p, row, first, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK_BYTES and p != part:
                    yield settle()
                    held, size = [], 0
                held.append((row, first, piece))
                size += len(piece)
                part = p
        if held:
            yield settle()

    dealt = cut.select("part", "row", "first", "piece").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(search, "row long, first int, last int")


def repeated_spans(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, first, last): runs of repeated starts in ``marked`` (row, raw, regions)."""

    def narrow(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"hash": [], "digest": [], "row": [], "first": [], "last": []}
        for row, raw, regions in zip(*(c.to_pylist() for c in batch.columns)):
            for r in regions:
                out["hash"].append(r["hash"])
                out["digest"].append(hashlib.blake2b(raw[r["first"] : r["last"] + length], digest_size=16).digest())
                out["row"].append(row)
                out["first"].append(r["first"])
                out["last"].append(r["last"])
        yield out

    pieces = materialise(in_batches(
        marked.select("row", "raw", "regions"), "hash long, digest binary, row long, first int, last int", narrow
    ))
    copies = materialise(pieces.groupBy("hash", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "first", "last")).alias("one")
    ))
    settled = pieces.join(copies.where(F.col("copies") > 1).select("hash", "digest"), ["hash", "digest"])
    settled = settled.select("row", "first", "last")
    many = copies.groupBy("hash").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > 1)
    wanted = copies.join(materialise(many), "hash").select(
        "hash", "one.*", (F.col("different") > MANY_REGIONS).alias("many")
    )
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("hash", "first", "last", "many")).alias("wanted"))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, raw, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            out: dict[str, list] = {"part": [], "row": [], "first": [], "piece": []}

            def add(part: int, first: int, last: int) -> None:
                out["part"].append(part)
                out["row"].append(row)
                out["first"].append(first)
                out["piece"].append(raw[first : last + length])

            for w in wanted:
                if not w["many"]:
                    add(w["hash"], w["first"], w["last"])
                    continue
                data = np.frombuffer(raw[w["first"] : w["last"] + length], dtype=np.uint8)
                second, a, b = regions(data, length, gram, seed=4)
                for h, x, y in zip(second.tolist(), a.tolist(), b.tolist()):
                    third, c, d = regions(data[x : y + length], length, gram // 4, seed=2)
                    for g, p, q in zip(third.tolist(), c.tolist(), d.tolist()):
                        add(hash((w["hash"], h, g)), w["first"] + x + p, w["first"] + x + q)
            yield out

    regions_cut = in_batches(
        marked.join(wanted, "row").select("row", "raw", "wanted"), "part long, row long, first int, piece binary", cut
    )
    return settled.unionByName(region_spans(regions_cut, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, digest of what is left.

    Judged on the input: a byte goes if a string of ``length`` bytes over it
    also starts at another place of any document. Matches never cross documents.
    A null text counts as empty; texts shorter than ``length`` stay whole; of
    equal texts of that length or more nothing stays, which holds for repeated
    rows as well. An empty table gives no rows, other columns are not read.
    """
    rows = materialise(docs.select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        F.unhex(F.md5(whole_text())).alias("text_key"), F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        F.sha2(whole_text(), 256).alias("sha"),
    ))
    texts = rows.where(F.col("n_bytes") >= length).groupBy("text_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("row_key")
    )
    texts = materialise(texts)
    found = repeated_anchors(anchors(docs, length, gram))
    by_text = found.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("first", "last", "hash"))).alias("regions"))
    chosen = materialise(by_text.join(texts, "text_key").select("row_key", "text_key", "copies", "regions"))
    raw = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.encode(whole_text(), "utf-8").alias("raw")
    )
    marked = raw.join(chosen, "row_key").groupBy("text_key").agg(
        F.first("raw").alias("raw"), F.first("regions").alias("regions"), F.first("copies").alias("copies")
    )
    marked = materialise(marked.withColumn("row", F.monotonically_increasing_id()))
    spans = materialise(repeated_spans(marked, length, gram))
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def removed(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"text_key": batch.column(0).to_pylist(), "n_removed": [], "n_spans": [], "kept": []}
        for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            edge = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(edge, [s["first"] for s in spans], 1)
            np.add.at(edge, [s["last"] + length for s in spans], -1)
            gone = np.cumsum(edge[:-1]) > 0
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(_runs(gone)[0]))
            out["kept"].append(hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()).hexdigest())
        return out

    single = marked.where(F.col("copies") == 1).select("row", "text_key", "raw").join(by_row, "row")
    results = materialise(in_batches(
        single.select("text_key", "raw", "spans"), "text_key binary, n_removed long, n_spans long, kept string", removed
    ))
    several = texts.where(F.col("copies") > 1).select("text_key", F.lit(True).alias("whole"))
    joined = rows.join(results, "text_key", "left").join(materialise(several), "text_key", "left")
    whole = F.col("whole").isNotNull()
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
