"""Scores by the mixed model against counts of every decision in dictionaries, and what the counts are dealt by."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import context_counts, context_mixing
from gradeloom.llm.common import ship

SCHEMA = "doc_id long, text string"


def texts():
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 5_000}"
    found = [None, "", "the", "the " * 400, "never seen words", "The the w1\tW2\n"]
    found += [" ".join(rng.choice(["the", "of the", word()]) for _ in range(rng.randrange(60))) for _ in range(150)]
    return found + found[20:30]


def rows_of(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[7], rows[40], (None, "the of the"), (None, "the of the")]
    ship(spark)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute_force(rows) -> list[float]:
    """Scores of all rows, with a slot of its own for every (context, bits of the path so far)."""
    tokens = [context_mixing.words(t or "") for _, t in rows]
    counts = Counter(w for (i, _), t in zip(rows, tokens) if not held_out(i) for w in t)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    most = [w for w in order if counts[w] >= counts[order[min(context_mixing.DICTIONARY, len(order)) - 1]]]
    own = context_mixing.Words(most, [counts[w] for w in most], sum(counts.values()), len(counts))
    levels = list(Counter(counts.values()).items())
    paths = context_counts.Paths(own, levels, context_mixing.huffman)
    number = {w: i for i, w in enumerate(order)}
    bits = {}
    for w, i in [*number.items(), (None, len(order))]:
        code, size = (int(x[0]) for x in paths.codes(np.array([i])))
        bits[i] = [code >> (63 - d) & 1 for d in range(size)]
    assert len({tuple(b) for b in bits.values()}) == len(bits)
    slots, made = [{}, {}, {}], [[] for _ in rows]
    for t, mine in zip(tokens, made):
        ids = [None, None, *[number.get(w, len(order)) for w in t]]
        for two, one, i in zip(ids, ids[1:], ids[2:]):
            for d, bit in enumerate(bits[i]):
                so_far = tuple(bits[i][:d])
                keys = (so_far, (one, so_far), (one, two, so_far))
                mine.append((0, *[s.setdefault(key, len(s)) for s, key in zip(slots, keys)], bit, d))

    def decisions(some):
        token, node, one, two, bit, depth = (np.array([m[i] for m in some], dtype=np.int64) for i in range(6))
        return token, node, bit, depth, one, two

    learned = decisions([m for (i, _), t in zip(rows, made) if not held_out(i) for m in t])
    tables = [np.zeros((len(s), 2), dtype=np.uint32) for s in slots]
    for table, slot in zip(tables, (learned[1], *learned[4:])):
        np.add.at(table, (slot, learned[2]), 1)
    mixer = context_mixing.Mixer(tables)
    mixer.leave_out()
    mixer.add_up(learned)
    mixer.learn(mixer.sums())
    mixer.settle()
    return [float(mixer.log10(decisions(t)).sum()) for t in made]


@pytest.mark.parametrize("small", [False, True])
def test_scores_hold_the_counts_of_every_word_in_every_context(spark, monkeypatch, small):
    """Words outside of the head are predicted in their contexts too, whatever is dealt apart."""
    monkeypatch.setattr(context_mixing, "HEAD", 7)
    if small:  # every word is looked up, dealt and added up in the ways meant for large tables
        for name, value in (("DICTIONARY", 12), ("HOT", 25), ("PART_BYTES", 400), ("FLUSH_TOKENS", 300)):
            monkeypatch.setattr(context_mixing, name, value)
    rows, docs = rows_of(spark)
    want = sorted(zip([(-1 if i is None else i) for i, _ in rows], brute_force(rows)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in context_mixing.score_documents(docs).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert math.isclose(a, b, rel_tol=2e-4, abs_tol=2e-3)


def test_a_hot_context_is_dealt_to_several_parts(spark, monkeypatch):
    """One word, and one pair of words, in nearly every place: no part holds most of it, and no score changes."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "a", "a", "b", f"c{rng.randrange(40)}"]) for _ in range(50))) for i in range(100)]
    ship(spark)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    whole = {r["doc_id"]: r["score"] for r in context_mixing.score_documents(docs).collect()}
    for name, value in (("HOT", 200), ("PART_BYTES", 600)):
        monkeypatch.setattr(context_mixing, name, value)
    sizes, deal = [], context_mixing.dealt

    def seen(*given):
        blocks = deal(*given)
        for r in blocks.where(f"kind = {context_counts.OCCURRENCES}").groupBy("part").agg({"n": "sum"}).collect():
            sizes.append(r[1])
        return blocks

    monkeypatch.setattr(context_mixing, "dealt", seen)
    parts = {r["doc_id"]: r["score"] for r in context_mixing.score_documents(docs).collect()}
    assert parts.keys() == whole.keys() and all(math.isclose(parts[i], whole[i], rel_tol=1e-5) for i in whole)
    assert sum(sizes) == 51 * len(rows) and max(sizes) < 0.3 * sum(sizes)


def test_odds_without_context_are_sums_of_counts():
    """At every depth of every word, the log odds are of the tokens of all words whose path begins alike."""
    counts = sorted([60, 31, 30, 9, 9, 9, 5, 3, 3, 2, *[1] * 30], reverse=True)
    for head in (2, 7, len(counts)):
        own = context_mixing.Words([b"%d" % i for i in range(head)], counts[:head], sum(counts), len(counts))
        paths = context_counts.Paths(own, list(Counter(counts).items()), context_mixing.huffman)
        ids = np.arange(len(counts) + 1)
        assert paths.counts(ids).tolist() == [*counts, 0]
        bits = [tuple(int(c) >> (63 - d) & 1 for d in range(n)) for c, n in zip(*paths.codes(ids))]
        assert not any(a != b and a == b[: len(a)] for a in bits for b in bits) and len(set(bits)) == len(bits)
        below = lambda begin: sum(c for c, b in zip([*counts, 0], bits) if b[: len(begin)] == begin)
        for less in (0, 1):
            steps = [x.copy() for x in paths.odds(ids, less)]
            assert len(steps) == max(map(len, bits))
            for i, mine in enumerate(bits):
                for depth in range(len(mine)):
                    taken, all_ = below(mine[: depth + 1]), below(mine[:depth])
                    want = math.log((max(taken - less, 0) + 0.4) / (all_ - taken + 0.4))
                    assert math.isclose(steps[depth][i], want, rel_tol=1e-5, abs_tol=1e-6)


def test_words_outside_of_the_head_are_told_by_the_words_before(spark, monkeypatch):
    """Rare words that always come in one order: a text that keeps it is likelier than one of the same words that does not."""
    monkeypatch.setattr(context_mixing, "HEAD", 2)
    rng = random.Random(6)
    kept = [i for i in range(400) if not held_out(i)]
    pairs = [f"x{i} y{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(pairs, 20))) for i in kept[:200]]
    ordered, mixed = [i for i in range(400) if held_out(i)][:2]
    rows += [(ordered, " ".join(pairs[:20])), (mixed, " ".join(f"x{i} y{(i + 1) % 20}" for i in range(20)))]
    ship(spark)
    scores = {r["doc_id"]: r["score"] for r in context_mixing.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert scores[ordered] > scores[mixed] + 20


def test_blocks_come_back_as_they_were():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, 2**31 - 1, n, dtype=np.int32), rng.integers(-(2**62), 2**62, n)]
        back = context_counts.unpack(context_counts.pack(columns), n, [np.int32, np.int64])
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back))
    numbers = [0, 1, 2, 3, 2**31, 2**32 - 1, 2**32, 2**53 + 1, 2**63, 2**64 - 1]
    assert context_counts.top_bit(np.array(numbers, dtype=np.uint64)).tolist() == [n.bit_length() - 1 for n in numbers]
