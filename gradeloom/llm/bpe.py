"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word is held as a row of parts and, beside it, the row of the ranks of
adjacent parts. The smallest rank is looked up by a scan, the boundary it
stands for is deleted, and only the two ranks beside it are refreshed. Words
are short, so the scan over a contiguous row beats a priority queue; the rare
word beyond ``LONG_WORD`` bytes is merged with a queue, which gives the same
parts in n log n steps. The rows of words of about one length are a matrix, in
which every step is taken for all words at once.

Texts are encoded some megabytes at a time: they are cut into pieces, each
different piece is split into words, each different word is merged, and what a
text becomes is put together from its pieces. Nothing is kept in between.

The vocabulary is the JSON file of a byte-level BPE tokenizer; its path is a
parameter and must be readable where the tasks run.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import in_batches, kept_in_worker

LONG_WORD = 200
#: Lengths up to which words share a matrix, and the words of a matrix.
WIDTHS = [*range(1, 17), 20, 24, 32, 48, 64, 96, 128, LONG_WORD]
GROUP = 8_192
#: Words that are too few for a matrix.
FEW = 8
#: Bytes of whole texts that are encoded at a time; a longer text is encoded alone.
SLICE_BYTES = 8 << 20

# The word pattern of byte-level BPE and the characters that stand for bytes.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of which every reading of the pattern makes one word, and all white space (or more), for Arrow's expressions.
PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
SPACE = r"[\t-\r\x1c- \x85\xa0\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
UNEVEN = f"^{SPACE}|{SPACE}$| {SPACE}|{SPACE} "
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_of_character() -> dict[str, int]:
    """Printable bytes stand for themselves, the others follow from code point 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_of_character()
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {
            i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if token not in self.special
        } | {i: token.encode() for token, i in self.special.items()}
        self.byte_id = [0] * 256
        for character, byte in to_byte.items():
            self.byte_id[byte] = vocab[character]
        #: Rank of a pair of ids, and by rank the id of both together.
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.joined = [vocab[a + b] for a, b in pairs]
        #: The same as arrays: pairs in order, ranks of pairs of bytes, what an id stands for.
        self.pair = np.array(sorted(self.ranks), dtype=np.int64)
        self.pair_rank = np.array([self.ranks[p] for p in self.pair.tolist()], dtype=np.int32)
        self.joined_array = np.array([*self.joined, 0], dtype=np.int32)
        self.byte_array = np.array(self.byte_id, dtype=np.int32)
        self.byte_rank = self.find(np.repeat(self.byte_array, 256), np.tile(self.byte_array, 256))
        every = range(max(self.token_bytes) + 1)
        self.id_text = pa.array(map(str, every), pa.string())
        self.id_bytes = pa.array([self.token_bytes.get(i, b"") for i in every], pa.binary())
        self.word = regex.compile(WORD)
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.uneven = regex.compile(r"^\s|\s$| \s|\s ")

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of all ranks for a pair without one."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.pair_rank[at], np.int32(len(self.joined)))

    def merge_short(self, word: bytes) -> list[int]:
        """Parts of one word, by scans over the contiguous array of adjacent ranks."""
        find, none, joined = self.ranks.get, len(self.joined), self.joined
        parts = [self.byte_id[b] for b in word]
        ranks = [find(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at] = part = joined[best]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = find(part << 32 | parts[at + 1], none)
            if at:
                ranks[at - 1] = find(parts[at - 1] << 32 | part, none)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same parts for a long word: a queue of (rank, position) over linked parts."""
        find, none = self.ranks.get, len(self.joined)
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if (rank := find(parts[i] << 32 | parts[i + 1], none)) < none:
                queue.append((rank, i, parts[i], parts[i + 1]))
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = self.joined[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := find(parts[a] << 32 | parts[b], none)) < none:
                    heapq.heappush(queue, (rank, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def _merge_rows(self, rows: np.ndarray, raw: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        """(rows, number of parts, parts) of words of up to raw.shape[1] bytes, each word once; as ``merge_short`` for every row."""
        none, width = len(self.joined), raw.shape[1]
        parts = self.byte_array[raw]
        ranks = self.byte_rank[(raw[:, :-1].astype(np.int32) << 8) + raw[:, 1:]]
        ranks[np.arange(1, width) >= size[:, None]] = none
        while parts.shape[1] > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            done = best == none
            if done.any():
                yield rows[done], size[done], parts[done]
                rows, size, parts, ranks, at, best = [x[~done] for x in (rows, size, parts, ranks, at, best)]
                if not len(rows):
                    return
            line, width = np.arange(len(rows)), parts.shape[1] - 1
            size = size - 1
            parts[line, at] = part = self.joined_array[best]
            stays = np.ones(parts.shape, dtype=bool)
            stays[line, at + 1] = False
            parts, ranks = parts[stays].reshape(len(line), width), ranks[stays[:, 1:]].reshape(len(line), width - 1)
            after, before = np.flatnonzero(at + 1 < size), np.flatnonzero(at)
            ranks[after, at[after]] = self.find(part[after], parts[after, at[after] + 1])
            ranks[before, at[before] - 1] = self.find(parts[before, at[before] - 1], part[before])
        yield rows, size, parts

    def _merge_words(self, words: pa.Array) -> pa.ListArray:
        """Ids of every word."""
        offsets, data = _buffers(words)
        start, length = offsets[:-1], np.diff(offsets)
        found = []
        for content, i in self.special.items():
            if (at := pc.index(words, content).as_py()) >= 0:
                found.append((np.array([at]), np.array([1]), np.array([[i]])))
                length[at] = 0
        for least, width in zip([0, *WIDTHS], WIDTHS):
            chosen = np.flatnonzero((length > least) & (length <= width))
            if len(chosen) < FEW:
                length[chosen] += LONG_WORD  # merged one by one below
                continue
            for a in range(0, len(chosen), GROUP):
                rows = chosen[a : a + GROUP]
                raw = data[np.minimum(start[rows][:, None] + np.arange(width), len(data) - 1)]
                found += self._merge_rows(rows, raw, length[rows])
        for at in np.flatnonzero(length > LONG_WORD).tolist():
            word = words[at].as_py().encode()
            ids = self.merge_short(word) if len(word) <= LONG_WORD else self.merge_long(word)
            found.append((np.array([at]), np.array([len(ids)]), np.array([ids])))
        sizes = np.zeros(len(words), dtype=np.int64)
        for rows, size, _ in found:
            sizes[rows] = size
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(ends[-1], dtype=np.int32)
        for rows, size, parts in found:
            place = np.arange(parts.shape[1])
            stays = place < size[:, None]
            ids[(ends[rows][:, None] + place)[stays]] = parts[stays]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    def _pieces(self, text: str) -> list[str]:
        """Cuts that no word crosses: before a single space between two characters that are not white space.

        A text with other white space beside a space is cut with a pattern that looks at both sides.
        """
        if self.uneven.search(text):
            cuts = [m.start() for m in regex.finditer(r"(?<=\S) (?=\S)", text)]
            return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, one after the other, and the place of each text's first one."""
        offsets, data = _buffers(texts)
        cut = data == ord(" ")
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        odd = pc.match_substring_regex(texts, UNEVEN)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            cut[offsets[i] : offsets[i + 1]] = False
            at, text = offsets[i], texts[i].as_py()
            for section in self.split_special.split(text) if self.split_special else [text]:
                for piece in [section] if section in self.special else self._pieces(section) if section else []:
                    cut[at] = True
                    at += len(piece.encode())
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, offsets[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
        return pieces, np.searchsorted(starts, offsets)

    def _encode_pieces(self, pieces: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of the different pieces, and by piece its place among them."""
        found = pieces.dictionary_encode()
        plain = pc.match_substring_regex(found.dictionary, PLAIN).to_numpy(zero_copy_only=False)
        others = found.dictionary.filter(pa.array(~plain)).to_pylist()
        split = [[p] if p in self.special else self.word.findall(p) for p in others]
        words = pa.concat_arrays(
            [found.dictionary.filter(pa.array(plain)), pa.array([w for s in split for w in s], pa.string())]
        ).dictionary_encode()
        taken = self._merge_words(words.dictionary).take(words.indices)
        n = int(plain.sum())
        bounds = np.concatenate([np.arange(n + 1), n + np.cumsum([len(s) for s in split], dtype=np.int64)])
        ends = taken.offsets.to_numpy()[bounds]
        place = np.empty(len(plain), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(plain))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.values), place[found.indices.to_numpy()]

    def encoded(self, texts: pa.Array) -> Iterator[Encoded]:
        """Runs of the texts as they are encoded, ``SLICE_BYTES`` at a time; a null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends, start = _buffers(texts)[0], 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + SLICE_BYTES, side="right")) - 1)
            pieces, first = self._cut(texts.slice(start, stop - start))
            yield Encoded(self, *self._encode_pieces(pieces), first)
            start = stop

    def encode(self, text: str) -> list[int]:
        return [i for run in self.encoded(pa.array([text], pa.string())) for i in run.ids()[0].as_py()]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoded:
    """What a run of texts becomes: ids by different piece, each text's pieces, and the place of its first one."""

    def __init__(self, bpe: ByteBpe, runs: pa.ListArray, pieces: np.ndarray, first: np.ndarray):
        self.bpe, self.runs, self.pieces, self.first = bpe, runs, pieces, first
        self.ends = np.concatenate([[0], np.cumsum(np.diff(runs.offsets.to_numpy())[pieces])])[first]

    def n_tokens(self) -> np.ndarray:
        return np.diff(self.ends)

    def ids(self) -> pa.ListArray:
        flat = self.runs.take(pa.array(self.pieces)).flatten()
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), flat)

    def ids_text(self) -> pa.Array:
        """Ids of every text in decimal, joined by commas."""
        return self._joined(self.bpe.id_text, ",")

    def decoded(self) -> pa.Array:
        """Bytes that the ids of every text stand for."""
        return self._joined(self.bpe.id_bytes, b"")

    def _joined(self, by_id: pa.Array, between: str | bytes) -> pa.Array:
        runs = pc.binary_join(pa.ListArray.from_arrays(self.runs.offsets, by_id.take(self.runs.values)), between)
        taken = runs.take(pa.array(self.pieces))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.first, pa.int32()), taken), between)


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0 on, and bytes of an array of strings without nulls."""
    if not len(strings):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return offsets - offsets[0], np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]


@lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def _forget() -> bool:
    held = _loaded.cache_info().currsize > 0
    _loaded.cache_clear()
    return held


kept_in_worker(_forget)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column ``ids`` (replaced if there). A null text has no ids."""

    def encode(bpe: ByteBpe, texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *[run.ids() for run in bpe.encoded(texts)]])

    return _added(docs, path, text, ids, "array<int>", encode)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` stand for; null ids give an empty text."""

    def decode(bpe: ByteBpe, found: pa.Array) -> pa.Array:
        return pa.array([bpe.decode(i or []) for i in found.to_pylist()], pa.string())

    return _added(docs, path, ids, text, "string", decode)


def _added(docs: DataFrame, path: str, read: str, name: str, kind: str, function) -> DataFrame:
    rest = docs.drop(name)
    from pyspark.sql import types as T

    schema = T.StructType([*rest.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def apply(batches):
        bpe = _loaded(path)
        for batch in batches:
            values = function(bpe, batch.column(batch.schema.get_field_index(read)))
            kept = [i for i, n in enumerate(batch.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], values], names=[*[batch.schema.names[i] for i in kept], name]
            )

    return docs.mapInArrow(apply, schema)


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document, and its ids if asked for.

    Encodes and decodes every whole text where it is read, without a shuffle. A
    null text counts as empty (no tokens). Rows are independent: repeated rows
    repeat their result, an empty table gives no rows, and columns other than
    doc_id and text are not read.
    """

    def apply(batch):
        start = 0
        for run in _loaded(path).encoded(batch.column(1)):
            n = run.n_tokens()
            yield {
                "doc_id": batch.column(0).slice(start, len(n)), "n_tokens": n,
                "ids_sha256": [hashlib.sha256(v.as_buffer()).hexdigest() for v in run.ids_text()],
                "decoded_sha256": [
                    hashlib.sha256(v.as_py().decode("utf-8", "replace").encode()).hexdigest() for v in run.decoded()
                ],
                "ids": run.ids() if with_ids else None,
            }
            start += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_batches(docs.select("doc_id", "text"), schema + ", ids array<int>" * with_ids, apply)
