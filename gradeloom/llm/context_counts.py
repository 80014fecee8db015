"""Counts of words in their contexts, exact for a corpus of any size.

Every word has a number, by falling count, and a path of binary decisions. For a
decision in a context is counted how often the path of what followed there began
like the path up to the decision, and how often it went on with either bit. Such
counts are sums over a range of the words that followed, in the order of their
paths, so no table of decisions is kept:

- without a context, over a range of word numbers. Words are numbered by falling
  count, so the sums come from the different counts and how many words have each;
- after a word and after two words, over a range of the sorted words that
  followed. All occurrences after a word are dealt to one part of the corpus.

A word that is followed by more than ``HOT`` tokens is dealt to several parts by
the word before it, two words that are, by the text. What follows these is added
up by Spark beforehand and sent to each of their parts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import number_rows
from ..session import materialise

#: Tokens after a word, or after two words, beyond which these are dealt to several parts.
HOT = 1_000_000
#: Parts that a task goes through, one after the other.
TASK_PARTS = 2
#: Occurrences of a part that are sorted and scored at once, so that these stay in a core's cache.
PIECE = 300_000
#: Rare words that a task gathers at once, and the texts whose rare words are sent together, as a power of two.
RARE_TOKENS = 1_000_000
FEW_TEXTS = 6
#: Decisions that are arrays at once, so that these stay in a core's cache.
STRETCH = 1 << 15
#: Largest number of a word, as four bytes hold it.
MOST = 2**31 - 3
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SIGHTINGS = np.log2(np.arange(1, 129)).astype(np.uint8)
_LOW = np.uint64(0xFFFFFFFF)


def before(ids: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the second word before each token, ``none`` where the text has none; ``first`` marks tokens that begin a text."""
    one = np.where(first, none, np.concatenate([[none], ids[:-1]]))
    second = np.concatenate([[True], first[:-1]]) | first
    return one, np.where(second, none, np.concatenate([[none], one[:-1]]))


def top_bit(numbers: np.ndarray) -> np.ndarray:
    """Place of the highest bit of 64-bit numbers, -1 for zero."""
    high = numbers >> np.uint64(32)
    some = high > 0
    half = np.where(some, high, numbers).astype(np.float64)
    return np.frexp(half)[1] - 1 + 32 * some


class Paths:
    """Number, count and path of every word of the vocabulary, whatever its size.

    Words of the head have a path of their own. Any other one has the path of the
    escape, that of a class, and in the class the bits of its number: class k
    holds 2^k words. Words that were not learned are one class more.
    ``escape`` and the paths of the head are those of ``vocabulary`` (``Words``);
    ``levels`` has (count, words with that count) of all learned words.
    """

    def __init__(self, vocabulary, levels: list[tuple[int, int]], huffman):
        self.head, self.known = vocabulary.head, vocabulary.v
        self.unknown, self.none = self.known, self.known + 1
        levels = sorted(levels, reverse=True)
        if self.known > MOST:
            raise ValueError(f"{self.known} different words; four bytes number {MOST}")
        sizes = np.array([n for _, n in levels], dtype=np.int64)
        #: First number and count of the words of a level, and the tokens of all levels before.
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.count = np.array([*[c for c, _ in levels], 0], dtype=np.int64)
        self.tokens = np.concatenate([[0], np.cumsum(sizes * self.count[:-1])]).astype(np.int64)
        if self.first[-1] != self.known:
            raise ValueError("the levels do not hold all words")
        classes = int(self.known - self.head).bit_length()
        begin = np.minimum(self.head - 1 + (1 << np.arange(classes + 1, dtype=np.int64)), self.known)
        total = np.diff(self.before(begin))
        escape = self._path(vocabulary, self.head)
        paths = [self._path(vocabulary, s) for s in range(self.head)]
        paths += [escape + [b for _, b in p] for p in huffman([*total.tolist(), 1])]
        #: Paths of the words of the head, of the classes and of unknown words; ``deeper`` bits of the number follow.
        self.deeper = np.array([0] * self.head + [*range(classes), 0], dtype=np.int64)
        self.size = np.array([len(p) for p in paths], dtype=np.int64)
        if (self.size + self.deeper).max() > 64:
            raise ValueError("paths of more than 64 decisions")
        self.code = np.array([sum(b << (63 - i) for i, b in enumerate(p)) for p in paths], dtype=np.uint64)
        self.begun = self._begun(np.concatenate([self.counts(np.arange(self.head)), total, [0]]))

    @staticmethod
    def _path(vocabulary, symbol: int) -> list[int]:
        start = vocabulary.start[symbol]
        return vocabulary.bits[start : start + vocabulary.size[symbol]].tolist()

    def _begun(self, counts: np.ndarray) -> np.ndarray:
        """Tokens whose path begins like that of a symbol, by symbol and depth up to the symbol's."""
        found = np.zeros((len(self.code), int(self.size.max()) + 1), dtype=np.int64)
        for depth in range(found.shape[1]):
            there = np.flatnonzero(self.size >= depth)
            begin = self.code[there] >> np.uint64(64 - depth) if depth else np.zeros(len(there), dtype=np.uint64)
            _, group = np.unique(begin, return_inverse=True)
            sums = np.zeros(int(group.max()) + 1, dtype=np.int64)
            np.add.at(sums, group, counts[there])
            found[there, depth] = sums[group]
        return found

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """How often words occur in the training texts; those beyond the known ones do not."""
        return self.count[np.searchsorted(self.first, ids, side="right") - 1]

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of all words with a smaller number."""
        level = np.searchsorted(self.first, ids, side="right") - 1
        return self.tokens[level] + (ids - self.first[level]) * self.count[level]

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        tail = np.clip(ids - self.head + 1, 1, None)
        found = np.where(ids < self.head, ids, self.head + np.frexp(tail.astype(np.float64))[1] - 1)
        return np.where(ids >= self.known, len(self.code) - 1, found)

    def codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths of words, from the highest bit on, and their lengths."""
        symbol = self.symbols(ids)
        deeper, size = self.deeper[symbol], self.size[symbol]
        rest = np.where(deeper > 0, ids - self.head + 1 - (np.int64(1) << deeper), 0).astype(np.uint64)
        return self.code[symbol] | (rest << ((64 - size - deeper) & 63).astype(np.uint64)), size + deeper

    def odds(self, ids: np.ndarray, less: int) -> Iterator[np.ndarray]:
        """Depth by depth the log odds of the bit that words take without a context, without ``less`` sightings of it.

        At the end of a word's path its value stays what it was.
        """
        symbol = self.symbols(ids)
        size, found = self.size.take(symbol), np.zeros(len(ids), dtype=np.float32)
        open_bits = self.deeper.take(symbol)
        deepest = int((size + open_bits).max(initial=0))
        deep = np.flatnonzero(open_bits)
        size, open_bits = size[deep], open_bits[deep]
        low = self.head - 1 + (np.int64(1) << open_bits)
        place = ids[deep] - low
        before_low = self.before(np.minimum(low, self.known))
        total = self.before(np.minimum(low + (np.int64(1) << open_bits), self.known)) - before_low
        for depth in range(deepest):
            if depth < self.begun.shape[1] - 1:
                by_symbol = _log_odds(self.begun[:, depth + 1], self.begun[:, depth], less)
                here = np.flatnonzero((self.size > depth).take(symbol))
                found[here] = by_symbol.take(symbol.take(here))
            on = size <= depth
            if on.any():
                # what is left of the class is halved; its words are known by where it begins and by its tokens
                now = np.flatnonzero(on)
                half = np.int64(1) << (open_bits.take(now) - 1)
                begin, before, all_ = low.take(now), before_low.take(now), total.take(now)
                upper = (place.take(now) & half) > 0
                until = self.before(np.minimum(begin + half, self.known))
                own = np.where(upper, before + all_ - until, until - before)
                found[deep.take(now)] = _log_odds(own, all_, less)
                low[now], before_low[now], total[now] = begin + half * upper, np.where(upper, until, before), own
                open_bits[now] -= 1
                some = open_bits > 0
                if not some.all():
                    deep, size, open_bits, low, place = deep[some], size[some], open_bits[some], low[some], place[some]
                    before_low, total = before_low[some], total[some]
            yield found


def _log_odds(own: np.ndarray, total: np.ndarray, less: int) -> np.ndarray:
    """Log odds of a bit that was seen ``own`` times of all, without ``less`` of these times."""
    found = np.maximum(own - less, 0).astype(np.float32) + np.float32(0.4)
    found /= (total - own).astype(np.float32) + np.float32(0.4)
    return np.log(found, out=found)


class Heat:
    """Which part of the corpus an occurrence is dealt to, and where the counts after hot contexts go.

    A word with more than ``hot`` occurrences has slots, to which its occurrences
    are dealt by the word before; two such words have further slots, by text.
    """

    def __init__(self, paths: Paths, texts: int, parts: int, hot: int):
        self.texts, self.parts, self.hot, self.unknown, self.none = texts, parts, hot, paths.unknown, paths.none
        many = int(np.searchsorted(-paths.count, -hot, side="right"))
        #: Words up to this number are hot.
        self.words = int(paths.first[many])
        counts = paths.counts(np.arange(self.words))
        self.slots = np.concatenate([-(-counts // hot), [-(-texts // hot) if texts >= hot else 0]])
        self.set_pairs(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))

    def set_pairs(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        """Sets the pairs of words (as ``pair`` packs them) that are hot, with their counts."""
        order = np.argsort(pairs)
        self.pairs, self.pair_slots = pairs[order], -(-counts[order] // self.hot)
        self.pair_base = np.zeros(len(pairs), dtype=np.int64)
        used = self.slots.copy()
        for i, one in enumerate(self.place((self.pairs >> np.uint64(32)).astype(np.int64))):
            self.pair_base[i] = used[one]
            used[one] += self.pair_slots[i]
        self.used = used

    def place(self, one: np.ndarray) -> np.ndarray:
        """Place of hot words in ``slots``, -1 for any other word."""
        none = np.where((one == self.none) & (self.slots[-1] > 0), self.words, -1)
        return np.where(one < self.words, one, none)

    @staticmethod
    def pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (one.astype(np.uint64) << np.uint64(32)) | two.astype(np.uint64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Number of hot pairs, -1 for any other two words."""
        found = np.full(len(one), -1)
        if len(self.pairs):
            hot = np.flatnonzero(self.place(one) >= 0)
            keys = self.pair(one[hot], two[hot])
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            found[hot] = np.where(self.pairs[at] == keys, at, -1)
        return found

    def part(self, one: np.ndarray, slot: np.ndarray) -> np.ndarray:
        mixed = ((one.astype(np.uint64) + np.uint64(1)) * _MIX[0]) ^ ((slot.astype(np.uint64) + np.uint64(1)) * _MIX[1])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[2]
        return ((mixed >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int32)

    def deal(self, one: np.ndarray, two: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Part of every occurrence; nothing is counted after unknown words, so what follows these is dealt by text."""
        slot = np.where(one == self.unknown, row, 0)
        place = self.place(one)
        hot = np.flatnonzero(place >= 0)
        two_or_row = np.where(two[hot] == self.unknown, row[hot], two[hot])
        mixed = ((two_or_row.astype(np.uint64) + np.uint64(1)) * _MIX[2]) >> np.uint64(32)
        slot[hot] = (mixed % self.slots[place[hot]].astype(np.uint64)).astype(np.int64)
        pair = self.find(one, two)
        both = np.flatnonzero(pair >= 0)
        slot[both] = self.pair_base[pair[both]] + row[both] % self.pair_slots[pair[both]]
        return self.part(one, slot)

    def parts_of_word(self, one: int) -> np.ndarray:
        slots = np.arange(self.used[self.place(np.array([one]))[0]])
        return np.unique(self.part(np.full(len(slots), one), slots))

    def parts_of_pair(self, pair: int) -> np.ndarray:
        slots = self.pair_base[pair] + np.arange(self.pair_slots[pair])
        return np.unique(self.part(np.full(len(slots), self.pairs[pair] >> np.uint64(32)), slots))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as compressed bytes, those of equal weight side by side."""
    planes = [(c >> c.dtype.type(8 * k)).astype(np.uint8) for c in columns for k in range(c.itemsize)]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data, n: int, kinds: list[type]) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd"), dtype=np.uint8)
    planes, columns = iter(raw.reshape(-1, n)) if n else None, []
    for kind in kinds:
        column = np.zeros(n, dtype=kind)
        for k in range(column.itemsize if n else 0):
            column |= next(planes).astype(kind) << column.dtype.type(8 * k)
        columns.append(column)
    return columns


#: Columns of a block by its kind: occurrences (before, second before, word, difference of 2 x row + learned), and
#: counts after a hot word (before, word, count) or after two (pair, word, count).
OCCURRENCES, AFTER_ONE, AFTER_TWO = 0, 1, 2
BLOCK_SCHEMA = "part int, kind int, n int, data binary"
BLOCKS = [[np.int32, np.int32, np.int32, np.int64], [np.int32, np.int32, np.int64], [np.int32, np.int32, np.int64]]


class Followers:
    """Words that follow contexts, in the order of (context, path), and the log odds of their decisions, depth by depth.

    ``less`` sightings of a decision are left out. A word that shares the path
    so far with no other one is sure of the rest; only the others are looked at.
    """

    def __init__(self, context: np.ndarray, code: np.ndarray, seen: np.ndarray, less: int):
        self.less = less
        #: For each word the log odds of the bit that it takes at this depth, and the log2 of all sightings there.
        self.odds, self.sightings = _log_odds(seen, seen, less), self._log2(seen)
        self.sure, self.left = (self.odds.copy(), self.sightings.copy()), np.empty(0, dtype=np.int64)
        self.shared = np.full(len(code), -1, dtype=np.int64)
        self.shared[1:] = np.where(context[1:] == context[:-1], 63 - top_bit(code[1:] ^ code[:-1]), -1)
        self.open, self.seen, self.total = np.arange(len(code)), seen, seen
        self._narrow(*self._groups(0))

    def _log2(self, total: np.ndarray) -> np.ndarray:
        return _SIGHTINGS[np.clip(total - self.less, 0, 127)]

    def _groups(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For the open words the sightings of all that share ``depth`` bits in the context, and whether others do."""
        if not len(self.open):
            return self.seen, np.empty(0, dtype=bool)
        first = np.flatnonzero(self.shared < depth)
        members = np.diff(first, append=len(self.open))
        return np.repeat(np.add.reduceat(self.seen, first), members), np.repeat(members > 1, members)

    def _narrow(self, total: np.ndarray, others: np.ndarray) -> None:
        self.left = self.open[~others]
        self.open, self.seen, self.shared, self.total = self.open[others], self.seen[others], self.shared[others], total[others]

    def step(self, depth: int) -> None:
        """Set the log odds and sightings to those of ``depth``, which follows the one before."""
        self.odds[self.left], self.sightings[self.left] = self.sure[0][self.left], self.sure[1][self.left]
        own, others = self._groups(depth + 1)
        self.odds[self.open], self.sightings[self.open] = _log_odds(own, self.total, self.less), self._log2(self.total)
        self._narrow(own, others)


def occurrences_of(data, n: int) -> list[np.ndarray]:
    *words, row = unpack(data, n, BLOCKS[OCCURRENCES])
    return [*words, np.cumsum(row)]


def columns_of(blocks: dict[int, list[tuple[bytes, int]]]) -> list[list[np.ndarray]]:
    """The columns of all blocks of each kind."""
    columns = []
    for kind in (OCCURRENCES, AFTER_ONE, AFTER_TWO):
        found = [occurrences_of(*b) if kind == OCCURRENCES else unpack(*b, BLOCKS[kind]) for b in blocks.get(kind, [])]
        columns.append([np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, dtype=k) for k in BLOCKS[kind]])
    return columns


def in_pieces(columns: list[list[np.ndarray]], heat: Heat) -> Iterator[list[list[np.ndarray]]]:
    """The columns in pieces of about ``PIECE`` occurrences; all that follows a word stays together."""
    many = 1 + len(columns[OCCURRENCES][0]) // PIECE
    split = []
    for kind, found in enumerate(columns):
        one = (heat.pairs[found[0]] >> np.uint64(32)) if kind == AFTER_TWO else found[0]
        piece = ((((one.astype(np.uint64) + np.uint64(1)) * _MIX[1]) >> np.uint64(40)) % np.uint64(many)).astype(np.int32)
        order = np.argsort(piece.astype(np.uint16) if many <= 1 << 16 else piece, kind="stable")
        ends = np.searchsorted(piece[order], np.arange(many), side="right")
        split.append(([c[order] for c in found], [0, *ends.tolist()]))
    columns.clear()
    for k in range(many):
        piece = [[c[ends[k] : ends[k + 1]] for c in found] for found, ends in split]
        if len(piece[OCCURRENCES][0]):
            yield piece


class Part:
    """All that follows the contexts of a part: the different (two words before, word) and the decisions of each."""

    def __init__(self, paths: Paths, heat: Heat, columns: list[list[np.ndarray]]):
        one, two, word, row = columns[OCCURRENCES]
        after_one, word_one, count_one = columns[AFTER_ONE]
        pair, word_two, count_two = columns[AFTER_TWO]
        columns.clear()
        n, self.paths, self.row = len(row), paths, row >> 1
        learned = row & 1
        words, inverse = np.unique(np.concatenate([word, word_two, word_one]), return_inverse=True)
        code, _ = paths.codes(words)
        order = np.argsort(code)
        rank = np.empty(len(order), dtype=np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        rank = rank[inverse]
        del inverse, word, row
        #: The different words, in the order of their paths, which is that of the numbers that stand for them below.
        self.words = words[order]
        code, self.length = paths.codes(self.words)
        m = n + len(word_two)

        pairs = np.concatenate([heat.pair(one, two), heat.pairs[pair]])
        contexts, context = np.unique(pairs, return_inverse=True)
        del pairs
        self.context_two, self.word, place, add = self._different(context, rank[:m])
        nothing = np.zeros(len(pair), dtype=np.int64)
        #: For each occurrence the place of what occurred; for that, how often it is learned from and how often it occurs.
        self.place = place[:n]
        self.learned, self.occurs = add(np.concatenate([learned, nothing])), np.bincount(self.place, minlength=len(self.word))
        alone = np.concatenate([heat.find(one, two) < 0, nothing]) if len(heat.pairs) else np.ones(m, dtype=bool)
        self.seen_two = add(np.concatenate([learned, count_two]) * np.concatenate([alone[:n], np.ones(len(pair), dtype=bool)]))
        self.code = code[self.word]

        one = (contexts >> np.uint64(32)).astype(np.int64)[self.context_two]
        seen = np.where(heat.place(one) >= 0, 0, self.learned)
        _, context = np.unique(np.concatenate([one, after_one]), return_inverse=True)
        self.context_one, word, place, add = self._different(context, np.concatenate([self.word.astype(np.uint64), rank[m:]]))
        self.last, self.code_one = place[: len(one)], code[word]
        self.seen_one = add(np.concatenate([seen, count_one]))

    @staticmethod
    def _different(context: np.ndarray, word: np.ndarray) -> tuple:
        """The different (context, word) in their order, the place of each one given, and what adds up values by them."""
        keys = (context.astype(np.uint64) << np.uint64(32)) | word
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        keys = keys[begin]
        add = lambda values: np.add.reduceat(values[order], begin)
        return (keys >> np.uint64(32)).astype(np.int64), (keys & _LOW).astype(np.int64), place, add

    def decisions(self, wanted: np.ndarray, less: int) -> Iterator[tuple]:
        """(place, log odds in three contexts, log2 of the sightings in two, bit, depth) of all decisions of ``wanted``.

        The log odds favour the bit that is decided. ``less`` sightings of the
        decision are left out in every context.
        """
        at = np.flatnonzero(wanted)
        code, last, word, size = self.code[at], self.last[at], self.word[at], self.length[self.word[at]]
        one = Followers(self.context_one, self.code_one, self.seen_one, less)
        two = Followers(self.context_two, self.code, self.seen_two, less)
        for depth, alone in enumerate(self.paths.odds(self.words, less)):
            longer = size > depth
            if not longer.all():
                at, code, last, word, size = at[longer], code[longer], last[longer], word[longer], size[longer]
            if not len(at):
                return
            one.step(depth)
            two.step(depth)
            for a in range(0, len(at), STRETCH):
                some, mine = at[a : a + STRETCH], last[a : a + STRETCH]
                bit = ((code[a : a + STRETCH] >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)
                x = (alone.take(word[a : a + STRETCH]), one.odds.take(mine), two.odds.take(some))
                yield some, x, one.sightings.take(mine), two.sightings.take(some), bit, depth


def flushed(batches: Iterator[pa.RecordBatch], paths, runs, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(before, second before, word, row, learned) of the tokens of (_row, held_out, ids), of ``most`` tokens or one run more at once."""
    held: list[tuple] = []
    n = 0
    for batch in batches:
        row, learned = batch.column(0).to_numpy(), ~batch.column(1).to_numpy(zero_copy_only=False)
        start = 0
        for ids, first, text in runs(batch.column(2)):
            one, two = before(ids, first, paths.none)
            text = text + start
            start = int(text[-1]) + 1
            held.append((one.astype(np.int32), two.astype(np.int32), ids.astype(np.int32), row[text], learned[text]))
            n += len(ids)
            if n >= most:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def numbered_whole(rows: DataFrame, counts: DataFrame, listed: int, known: int) -> DataFrame:
    """``rows`` (as ``numbered`` makes them, with ``_row``) with the number of every word in ``ids``, and without ``unlisted``.

    ``counts`` are (token, c) of the words that are not listed; they are numbered
    by falling count, after those that are. Words that are not known share the
    number after all others.
    """
    if known == listed:
        return rows.drop("unlisted")
    ranked = number_rows(counts, [], [F.desc("c"), F.asc("token")], "id", start=listed)
    rare = rows.select("_row", F.posexplode("unlisted").alias("pos", "token"))
    rare = rare.join(ranked.select("token", F.col("id").cast("int").alias("id")), "token", "left")
    rare = rare.select("_row", "pos", F.coalesce("id", F.lit(known).cast("int")).alias("id"))
    plain = rows.drop("unlisted")
    names, at, key = plain.columns, plain.columns.index("ids"), plain.columns.index("_row")

    def together(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        row, pos, ids = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(row, kind="stable")
        row, pos, ids = row[order], pos[order], ids[order]
        texts, begin = np.unique(row >> FEW_TEXTS, return_index=True)
        ends = [*begin[1:], len(row)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(texts, pa.int64()), pa.array([b - a for a, b in zip(begin, ends)], pa.int32()),
                pa.array(
                    [pack([np.diff(row[a:b], prepend=0), pos[a:b], ids[a:b]]) for a, b in zip(begin, ends)], pa.binary()
                ),
            ],
            names=["texts", "n", "data"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n >= RARE_TOKENS:
                yield from together(held)
                held, n = [], 0
        if n:
            yield from together(held)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in the order of ``texts``; what was gathered for some texts comes before them."""
        held: dict[int, list[list[np.ndarray]]] = defaultdict(list)
        for batch in batches:
            texts, n, data = batch.columns[-3:]
            there = n.is_null()
            for one, size, raw in zip(*[c.filter(n.is_valid()).to_pylist() for c in (texts, n, data)]):
                row, pos, ids = unpack(raw, size, [np.int64, np.int32, np.int32])
                held[one].append([np.cumsum(row), pos, ids])
            batch, texts = batch.filter(there), texts.filter(there).to_numpy()
            if not len(texts):
                continue
            found = [np.frombuffer(v.as_buffer(), dtype=np.int32) for v in batch.column(at)]
            sizes = np.array([len(v) for v in found])
            whole = np.concatenate(found)
            rest = whole >= listed
            if rest.any():
                row, pos, ids = (np.concatenate(c) for c in zip(*[p for t in np.unique(texts).tolist() for p in held.get(t, [])]))
                order = np.lexsort((pos, row))
                many = np.add.reduceat(rest, np.cumsum(sizes) - sizes, dtype=np.int64)
                begin = np.searchsorted(row[order], batch.column(key).to_numpy()) - (np.cumsum(many) - many)
                whole[rest] = ids[order][np.repeat(begin, many) + np.arange(many.sum())]
            for one in [t for t in held if t < texts[-1]]:
                del held[one]
            place = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
            filled = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(place), pa.py_buffer(whole)])
            columns = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*columns[:at], filled, *columns[at + 1 :]], names=names)

    packed = rare.mapInArrow(gather, "texts long, n int, data binary")
    both = plain.withColumn("texts", F.shiftright("_row", FEW_TEXTS)).unionByName(packed, allowMissingColumns=True)
    both = both.select(*names, "texts", "n", "data").repartition("texts").sortWithinPartitions("texts", F.col("n").isNull())
    return both.mapInArrow(fill, plain.schema)


def after_hot(rows: DataFrame, paths, heat, runs, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(one, word, c) after hot words and (pair, word, c) after hot pairs, which it enters in ``heat``, over training rows."""
    spark, own = rows.sparkSession, heat
    if not own.slots.any():
        return None, None
    training = rows.where(~F.col("held_out")).select("_row", "held_out", "ids")
    warm = spark.sparkContext.broadcast(own)

    def counted(of) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one, two, word, _, _ in flushed(batches, paths.value, runs, most):
                context = of(one, two)
                hot = np.flatnonzero(context >= 0)
                keys, n = np.unique(Heat.pair(context[hot], word[hot]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & _LOW).astype(np.int32)), pa.array(n)],
                    names=["context", "word", "c"],
                )

        part = training.mapInArrow(count, "context int, word int, c long")
        return materialise(part.groupBy("context", "word").agg(F.sum("c").alias("c")))

    ones = counted(lambda one, two: np.where(warm.value.place(one) >= 0, one, -1))
    found = ones.where(F.col("c") >= own.hot).collect()  # one row at most for HOT tokens
    pairs = [(r["word"], r["context"], r["c"]) for r in found]
    if own.slots[-1]:
        pairs.append((own.none, own.none, own.texts))
    one, two, c = (np.array([p[i] for p in pairs], dtype=np.int64) for i in range(3))
    own.set_pairs(Heat.pair(one, two), c)
    if not pairs:
        return ones, None
    warm = spark.sparkContext.broadcast(own)
    return ones, counted(lambda one, two: warm.value.find(one, two))


def dealt(rows: DataFrame, hot: tuple, paths, heat, runs, most: int) -> DataFrame:
    """(part, kind, n, data): what follows the contexts of each part, in blocks; a part's are in one task."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, word, row, learned in flushed(batches, paths.value, runs, most):
            part = heat.value.deal(one, two, row)
            order = np.argsort(part.astype(np.uint16) if heat.value.parts <= 1 << 16 else part, kind="stable")
            row = 2 * row + learned
            columns = [c[order] for c in (one, two, word, row)]
            ends = np.searchsorted(part[order], np.arange(heat.value.parts), side="right")
            for p, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                if b > a:
                    yield block(p, OCCURRENCES, [*[c[a:b] for c in columns[:3]], np.diff(columns[3][a:b], prepend=0)])

    def block(part: int, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(columns[0])], pa.int32()),
                pa.array([pack(columns)], pa.binary()),
            ],
            names=["part", "kind", "n", "data"],
        )

    def send(kind: int):
        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_numpy() for c in batch.columns]
                order = np.argsort(columns[0], kind="stable")
                columns = [c[order] for c in columns]
                contexts, begin = np.unique(columns[0], return_index=True)
                for context, a, b in zip(contexts, begin, [*begin[1:], len(order)]):
                    parts = (heat.value.parts_of_word if kind == AFTER_ONE else heat.value.parts_of_pair)(int(context))
                    for p in parts:
                        yield block(int(p), kind, [c[a:b] for c in columns])

        return sent

    found = rows.select("_row", "held_out", "ids").mapInArrow(deal, BLOCK_SCHEMA)
    for kind, counts in zip((AFTER_ONE, AFTER_TWO), hot):
        if counts is not None:
            found = found.unionByName(counts.select("context", "word", "c").mapInArrow(send(kind), BLOCK_SCHEMA))
    return found.repartition(-(-heat.value.parts // TASK_PARTS), "part")


def parts_of(batches: Iterator[pa.RecordBatch], paths: Paths, heat: Heat) -> Iterator[Part]:
    """The parts of a task, one after the other; all others wait in compressed blocks."""
    held: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for batch in batches:
        for part, kind, n, data in zip(*[c.to_pylist() for c in batch.columns]):
            held[part][kind].append((data, n))
    while held:
        _, blocks = held.popitem()
        if OCCURRENCES in blocks:
            for columns in in_pieces(columns_of(blocks), heat):
                yield Part(paths, heat, columns)
