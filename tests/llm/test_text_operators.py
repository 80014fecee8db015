"""Text operators against brute force on small tables with nulls, copies, ties and odd texts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gradeloom.llm import (
    bpe, context_mixing, exact_dedup, html_text, jaccard_join, language_id, line_dedup, mixing, suffix_dedup, topk_search,
)
from gradeloom.llm.common import empty_worker, ship, slices
from gradeloom.session import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, `_doc` string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = "\n".join(line(12) for _ in range(9))
    base = line(150)
    found = [None, "", "   \n\t ", "One two", "x" * 3000, "ha " * 700, "a\x1fb \x85 c\n\nd", base, base, base.upper()]
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = word()
        found.append(" ".join(words))
    for k in range(14):
        found.append(f"{line(15)}\n{line(3)}\n{passage}\nshort\n{line(9 * k + 2)}\n\nshort\n{line(4)}")
    found += ["short", "<|endoftext|> tail<|endoftext|>", line(4000), "日本語 ​ text 👍🏽"]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", None, "s1"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[7], rows[23], (None, "no id at all, but some words here", "en", "s1", 3)]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


def words(text):
    return (text or "").encode().lower().split()


def test_line_dedup(docs, plain):
    first, gone = {}, defaultdict(set)
    keyed = {(i is not None, i or 0, t) for i, t in plain}
    texts_of = {k: [x for x in (k[2] or "").split("\n") if x.split()] for k in keyed}
    row = lambda k: hashlib.md5(f"{k[1] if k[0] else '-'}|{k[2] or ''}".encode()).digest()
    for k in sorted(keyed, key=lambda k: (k[0], k[1], row(k))):
        lines = texts_of[k]
        for a in range(len(lines)):
            n = 0
            for e in range(a, len(lines)):
                n += len(lines[e].split())
                if n >= 5:
                    if first.setdefault(tuple(lines[a : e + 1]), (k, a)) != (k, a):
                        gone[k].update(range(a, e + 1))
                    break
    result = line_dedup.dedup_lines(docs).collect()
    assert len(result) == len(plain)
    want = Counter()
    for i, t in plain:
        kept, n = [], -1
        for x in (t or "").split("\n"):
            if x.split():
                n += 1
                if n in gone[(i is not None, i or 0, t)]:
                    continue
            kept.append(x)
        want[(i, None if t is None else "\n".join(kept))] += 1
    assert Counter((r["doc_id"], r["text"]) for r in result) == want
    assert sum(r["n_removed"] for r in result) > 50 and {r["row"] for r in result} == {"clash"}
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_whole_runs(spark):
    """Every run of five words or more that stands before goes, with short lines at its end."""
    rng = random.Random(11)
    pool = ["Les.", "a b", "c d e", "f g h i", "j k l m n", "o p q r s t", "u", "v w"]
    texts_of = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts_of += ["one two three four five six\nLes.", "one two three four five six\nLes.", "x\none two three four five six\nLes.\ny"]
    lines_of = [t.split("\n") for t in texts_of]
    first, dropped = {}, [set() for _ in lines_of]
    for k, lines in enumerate(lines_of):
        for a in range(len(lines)):
            for e in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:e]) >= 5 and first.setdefault(tuple(lines[a:e]), (k, a)) != (k, a):
                    dropped[k] |= set(range(a, e))
    wanted = ["\n".join(x for i, x in enumerate(lines) if i not in dropped[k]) for k, lines in enumerate(lines_of)]
    assert wanted[-2:] == ["", "x\ny"]
    rows = spark.createDataFrame(list(enumerate(texts_of)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(rows, whole_runs=True).collect()}
    assert found == {k: (wanted[k], len(dropped[k])) for k in range(len(texts_of))}


def test_language(spark, docs):
    rng = random.Random(1)
    vocabulary = {"en": "the and of that with for not have this but".split(), "fr": "les des une dans pour avec sur est nous vous".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[g], k=30)), g) for i in range(200) for g in ["en" if i % 2 else "fr"]]
    rows += [(900, None, "en"), (901, "123 ..", "fr"), (902, "les des une", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(table))
    found = {r["doc_id"]: r for r in language_id.identify(table, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in held)
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[902]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = {r["doc_id"] for r in language_id.keep_identified(table, model, 0.3).collect()}
    assert kept == set(found) - {900, 901}
    nothing = language_id.train(empty(docs))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_filter_has_every_language_of_a_gram():
    import numpy as np

    grams = np.arange(4000, dtype=np.uint64)
    model = language_id.LanguageFilter([f"l{i:02}" for i in range(40)], np.tile(grams, 2), np.repeat([3, 38], 4000))
    found = model.languages(grams)
    assert (found[:, 0] >> np.uint32(3) & np.uint32(1)).all() and (found[:, 1] >> np.uint32(6) & np.uint32(1)).all()


@pytest.mark.parametrize(("width", "percent", "leaf"), [(3, 90, 2048), (5, 80, 2048), (3, 80, 3)])
def test_jaccard(docs, plain, width, percent, leaf):
    sets, root = [], list(range(len(plain)))
    for _, t in plain:
        w = words(t)
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        sets.append(grams)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(plain):
        least[find(k)].append(i)
    want = Counter(
        (i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(plain)
    )
    found = jaccard_join.linked_documents(docs, width, percent, first_leaf=min(leaf, 8), leaf=leaf).collect()
    assert Counter(tuple(r) for r in found) == want
    assert jaccard_join.linked_documents(empty(docs), width, percent).count() == 0


def test_jaccard_with_repeated_rows(spark):
    """Rows stored several times count once: one row of each set, and the rarest n-grams still meet."""
    ship(spark)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(30):
        own = list(base)
        for place in rng.sample(range(300), 6):
            own[place] = f"own{k}x{place}"
        rows += [(k, " ".join(own))] * (k % 3 + 4)
    rows += [(None, rows[0][1])] * 5
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    listed = jaccard_join.listed_sets(table, 1, 90, False)
    members = listed.select("set").distinct()
    sets = jaccard_join.materialise(jaccard_join.sets_of(table, listed, members, 1))
    assert sets.count() == sets.select("set").distinct().count() == 30
    groups = jaccard_join.rare_prefixes(members, sets, 90)
    met = {(r["g"], r["set"]) for r in groups.collect()}
    assert groups.count() == len(met) and len({s for _, s in met}) == 30
    found = jaccard_join.linked_documents(table, 1, 90, first_leaf=3, leaf=8).collect()
    assert len(found) == len(rows) and {r["component_id"] for r in found} == {0}


def test_texts_are_chosen_and_cut_in_two_stages(spark):
    """However few rows are chosen, no task holds a Python worker for each of the two."""
    ship(spark)
    few = spark.createDataFrame([(i, f"a b c d {i % 3} {i}") for i in range(9)], "doc_id long, text string")
    listed = materialise(jaccard_join.listed_sets(few, 3, 90, with_parts=False).drop("sigs"))
    sets = jaccard_join.sets_of(few, listed, listed.select("set").distinct(), 3)
    _, *nodes = sets._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(nodes) == 2 and "Exchange hashpartitioning" in nodes[0]
    assert sets.count() == 9


def test_keep_one(docs, plain):
    kept = jaccard_join.keep_one(docs).collect()
    groups = {r["component_id"] for r in jaccard_join.linked_documents(docs, 5, 80).where("n_shingles > 0").collect()}
    assert {r["doc_id"] for r in kept if words(r["text"])} == groups
    assert sum(not words(r["text"]) for r in kept) == sum(not words(t) for _, t in plain)


def test_exact(docs, plain):
    found = exact_dedup.mark_copies(docs).collect()
    same = defaultdict(list)
    for i, t in plain:
        same[t or ""].append(i)
    assert len(found) == len(plain)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in same.items()}
    for r in found:
        ids = by_digest[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)
    assert exact_dedup.mark_copies(empty(docs)).count() == 0


def test_scoring(docs, plain):
    learned = [t for i, t in plain if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learned for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    for r in context_mixing.score_documents(docs).collect():
        text = next(t for i, t in plain if i == r["doc_id"])
        tokens = [*words(text), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(w in counts for w in tokens) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and r["score"] < 0
    assert context_mixing.score_documents(empty(docs)).count() == 0


def test_mixed_probabilities_add_up():
    """Over all continuations of a history, head words and the escape have probability one."""
    import numpy as np

    rng = np.random.default_rng(1)
    own = context_mixing.Words([b"", b"a", b"b", b"c", b"d"], [9, 8, 4, 2, 1], 30, 8)
    mixer = context_mixing.Mixer(
        [rng.integers(0, 9, (own.width, 2)).astype(np.uint32)] + [rng.integers(0, 9, (1 << 20, 2)).astype(np.uint32)] * 2
    )
    mixer.settle()
    total = 0.0
    for last in range(own.head + 1):
        d = own.decisions(np.array([1, 2, last]), np.array([True, False, False]))
        total += 10 ** mixer.log10(d)[d[0] == 2].sum()
    assert math.isclose(total, 1.0, rel_tol=1e-6)


def test_weights_are_learned_from_every_training_text(spark):
    """The sums hold each decision of each of 2,500 texts, more than any sample that was taken, however they are dealt."""
    texts = spark.range(2_500).select(F.concat(F.lit("a b "), (F.col("id") % 7).cast("string"), F.lit(" c")).alias("text"))
    counts = Counter(w for i in range(2_500) for w in [b"", b"a", b"b", str(i % 7).encode(), b"c"])
    own = context_mixing.Words(list(counts), list(counts.values()), sum(counts.values()), len(counts))
    vocabulary = spark.sparkContext.broadcast(own)
    tables = spark.sparkContext.broadcast(context_mixing.bit_counts(texts, vocabulary))
    mixer = context_mixing.Mixer(tables.value)
    mixer.leave_out()
    for _, run in context_mixing.chunks([f"a b {i % 7} c" for i in range(2_500)]):
        ids, first, _ = context_mixing.flat(own, run)
        mixer.add_up(own.decisions(ids, first))
    assert mixer.observed.sum() == sum(c * own.size[i] for i, c in enumerate(counts.values()))
    mixer.learn(mixer.sums())
    for dealt in (texts.coalesce(1), texts.repartition(5)):
        weights, cells = context_mixing.fit_weights(dealt, vocabulary, tables)
        assert np.allclose(weights, mixer.weights, atol=1e-4) and np.allclose(cells, mixer.map, atol=1e-9)


def test_words_are_looked_up_once(spark):
    """Counts, weights and map come from the numbers of the words, without the texts, and are the same."""
    found = ["a b zz c", None, "", "c c A\tb rare rare", "b " * 300]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = context_mixing.Words([b"b", b"", b"c", b"a"], [301, 5, 3, 2], 314, 6)
    vocabulary = spark.sparkContext.broadcast(own)
    ids = materialise(context_mixing.numbered(texts, vocabulary))
    rows = {r["doc_id"]: r for r in ids.collect()}
    for i, t in enumerate(found):
        tokens = context_mixing.words(t or "")
        assert np.frombuffer(rows[i]["ids"], np.int32).tolist() == own.look_up(tokens).tolist()
        assert [bytes(w) for w in rows[i]["unlisted"]] == [w for w in tokens if w not in own.ids]
    ids = ids.select("ids")
    plain, numbers = (context_mixing.bit_counts(d, vocabulary) for d in (texts, ids))
    assert all((a == b).all() for a, b in zip(plain, numbers))
    tables = spark.sparkContext.broadcast(plain)
    for a, b in zip(context_mixing.fit_weights(texts, vocabulary, tables), context_mixing.fit_weights(ids, vocabulary, tables)):
        assert np.allclose(a, b, atol=1e-9)


def test_numbers_come_in_the_runs_of_their_texts(monkeypatch):
    monkeypatch.setattr(context_mixing, "CHUNK_TOKENS", 4)
    own = context_mixing.Words([b"", b"a", b"b"], [3, 2, 1], 6, 3)
    found = ["a", "b b", "a b a b a b", "", "a a", ""]
    ids = pa.array([own.look_up(context_mixing.words(t)).astype(np.int32).tobytes() for t in found], pa.binary())
    want = [context_mixing.flat(own, run) for _, run in context_mixing.chunks(found)]
    got = list(context_mixing.runs(ids))
    whole = lambda parts: [np.concatenate(x).tolist() for x in zip(*[p[:2] for p in parts])]
    assert whole(got) == whole(want) and sum(len(set(p[2])) for p in got) == len(found)
    assert list(context_mixing.runs(ids[:0])) == []


def test_tokens_are_cut_and_looked_up_together():
    """Tokens of many texts are one Arrow array, cut as ``words`` cuts one text, and are numbered without Python objects."""
    rng = random.Random(8)
    own = context_mixing.Words([b"", b"a", "\u00e9".encode(), b"b"], [9, 5, 4, 1], 20, 5)
    for _ in range(200):
        found = ["".join(rng.choice("aAb\u00e9 \t\n\x0b\x0c\r\x1c\xa0\u00c4") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(7))]
        tokens, place = context_mixing.tokens_of(pa.array(["b A", *found], pa.string()).slice(1))
        each = tokens.to_pylist()
        assert [each[a:b] for a, b in zip(place, place[1:])] == [context_mixing.words(t) for t in found]
        assert own.look_up(tokens).tolist() == [own.ids.get(w, own.unlisted) for w in each]


def test_decisions_in_steps_are_those_of_the_whole_run(monkeypatch):
    """Steps keep the contexts of the words before them; products of up to FACTORS probabilities give the same logarithm."""
    rng = np.random.default_rng(2)
    counts = [1 << (40 - k) for k in range(40)]  # paths of up to 40 decisions
    own = context_mixing.Words([b"", *[b"w%d" % k for k in range(1, 40)]], counts, sum(counts), 40)
    mixer = context_mixing.Mixer(
        [rng.integers(0, 9, (own.width, 2)).astype(np.uint32)] + [rng.integers(0, 9, (1 << 20, 2)).astype(np.uint32)] * 2
    )
    mixer.settle()
    ids, first = rng.integers(0, 41, 500), rng.random(500) < 0.1
    first[0] = True
    whole = own.decisions(ids, first)
    assert whole[3].max() >= context_mixing.FACTORS
    monkeypatch.setattr(context_mixing, "STEP_TOKENS", 7)
    steps = list(own.steps(ids, first))
    assert max(len(d[0]) for _, d in steps) < len(whole[0])
    for k in range(1, 6):
        assert np.concatenate([d[k] for _, d in steps]).tolist() == whole[k].tolist()
    got = np.concatenate([mixer.token_log10(d, s.stop - s.start) for s, d in steps])
    assert np.allclose(got, np.bincount(whole[0], weights=mixer.log10(whole), minlength=500), rtol=1e-12)


def test_a_worker_gives_back_the_tokenizer_before_it_identifies():
    bpe._loaded.cache_clear()
    bpe._loaded(TOKENIZER)
    assert bpe._loaded.cache_info().currsize == 1
    empty_worker()
    assert bpe._loaded.cache_info().currsize == 0
    batches = [pa.RecordBatch.from_pydict({"n": list(range(n))}) for n in (0, 5, 2)]
    pieces = list(slices(iter(batches), 2))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1], [2, 3], [4], [0, 1]]


def test_suffix_dedup(docs, plain):
    for length, gram in ((60, 16), (400, 64)):
        seen = Counter()
        for _, t in plain:
            raw = (t or "").encode()
            seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
        want = Counter()
        for i, t in plain:
            raw, gone = (t or "").encode(), set()
            for k in range(len(raw) - length + 1):
                if seen[raw[k : k + length]] > 1:
                    gone.update(range(k, k + length))
            spans = sum(k - 1 not in gone for k in gone)
            left = bytes(b for k, b in enumerate(raw) if k not in gone)
            want[(i, len(raw), len(gone), spans, hashlib.sha256(left).hexdigest())] += 1
        assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, length, gram).collect()) == want
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_two_stage_sorting():
    import numpy as np

    rng = random.Random(5)
    for letters, n in (("ab", 300), ("abcd", 500), ("a", 40), ("abcdefgh", 1)):
        raw = "".join(rng.choice(letters) for _ in range(n)).encode()
        order = suffix_dedup.sorted_suffixes(np.frombuffer(raw, dtype=np.uint8), n)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])


def test_many_regions_of_one_hash(docs, plain, monkeypatch):
    whole = sorted(map(tuple, suffix_dedup.remove_repeats(docs, 60, 16).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "MANY_REGIONS", 0)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, 60, 16).collect()), key=str) == whole


def test_top_k(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.gauss(0, rng.choice([0.2, 3.0])) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 340)] + [(350, None), (351, [1.0, None]), (400, [nan] * 6), (401, [inf] * 6)]
    rows += [(402, [0.0] * 6), (450, [0.0] * 6), rows[3], (None, [1.0] * 6), (403, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    good = {(r["vec_id"], tuple(math.floor(256 * x) for x in r["embedding"])) for r in table.collect()
            if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    want = set()
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in topk_search.top_k(table).collect()} == want
    assert topk_search.top_k(table.limit(0)).count() == 0


def test_bpe(docs, plain):
    reference = Tokenizer.from_file(TOKENIZER)
    own = bpe.ByteBpe(TOKENIZER)
    for r in bpe.round_trip(docs, TOKENIZER, with_ids=True).collect():
        text = next(t for i, t in plain if i == r["doc_id"]) or ""
        ids = reference.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids == own.encode(text) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert own.decode(ids) == decoded and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("aab  \n\t\r\x1c\x85\xa0's٣1２é漢　.,<|endoftext|>👍") for _ in range(rng.randrange(30)))
        assert own.encode(text) == reference.encode(text, add_special_tokens=False).ids
    long = "".join(rng.choice("abthe") for _ in range(2000)).encode()
    assert own.merge_long(long) == own.merge_short(long)
    back = bpe.decode_documents(bpe.encode_documents(docs, TOKENIZER), TOKENIZER).select("text", "decoded", "row").collect()
    assert all(r["decoded"] == (r["text"] or "") and r["row"] == "clash" for r in back)


def test_bpe_merges_words_of_about_one_length_together(monkeypatch):
    own, reference, rng = bpe.ByteBpe(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(6)
    letters = ["the and ingtion ", "aeéß漢", "ab1.,'s\n"]
    words = ["".join(rng.choice(letters[k % 3]) for _ in range(k % 130)) for k in range(6000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] + ["", None, " a", "<|endoftext|>b  c", "x" * 900]
    singly = []
    for name in ("merge_short", "merge_long"):
        monkeypatch.setattr(own, name, lambda w, merge=getattr(own, name): singly.append(w) or merge(w))
    for size in (1, 3_000, bpe.SLICE_BYTES):
        monkeypatch.setattr(bpe, "SLICE_BYTES", size)
        singly.clear()
        runs = list(own.encoded(pa.array(["left out", *texts], pa.string()).slice(1)))
        want = [reference.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [i for run in runs for i in run.ids().to_pylist()] == want
        assert [n for run in runs for n in run.n_tokens().tolist()] == [len(i) for i in want]
        assert [t for run in runs for t in run.ids_text().to_pylist()] == [",".join(map(str, i)) for i in want]
        assert [t.decode() for run in runs for t in run.decoded().to_pylist()] == [t or "" for t in texts]
    assert len(runs) == 1 and sum(len(w) <= bpe.LONG_WORD for w in singly) < 100


PAGE = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav>{}<footer>&copy; us</footer></body>"


def test_html(spark):
    ship(spark)
    furniture = "<div>Site name</div><p>Daily news &amp; views</p>"
    rows = [(i, f"http://a.org/x/{i}?p=1", PAGE.format(f"{furniture}<p>Story {i} is\n long<br>and told</p><div>Call now</div>")) for i in range(6)]
    rows += [(6, "http://a.org/x/5#top", rows[5][2]), (7, None, None), (8, "http://b.org/1", ""), (9, "nonsense", "<p>Alone")]
    article = "<article><h1>T &lt;1&gt;</h1><p>Daily news &amp; views<div class='comments'><p>first!</div><script>var a='</p>'</script><p>End</article>"
    rows += [(10, "http://a.org/x/6", PAGE.format(furniture + article + "<aside>More</aside>"))]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i} is long and told" for i in range(6))
    assert found[7] == found[8] == "" and found[9] == "Alone"
    assert found[10] == "T <1>\nDaily news & views\nEnd"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differences_beside_main_and_behind_copies(spark):
    """Lines beside an article are differenced, by query too and behind runs of copies; states name no furniture."""
    ship(spark)
    page = "<body><div>Site name</div><h1>Lead {0}</h1><article class='has-sidebar comments-open'><p>Body {0}</p></article></body>"
    rows = [(i, f"http://a.org/p?id={i}", page.format(i)) for i in range(3)]
    near = "<body><div>Menu of the site</div><p>" + "</p><p>".join(f"Long line {k} of a story that is told again" for k in range(12)) + "</p><p>End {}</p></body>"
    rows += [(10 + i, f"http://b.org/x/a{i}", near.format(i)) for i in range(5)]
    rows += [(20, "http://b.org/x/b", "<body><div>Menu of the site</div><p>Other story</p></body>")]
    rows += [(30 + i, f"http://c.org/{i}", "<body><div>Top</div><p>Same</p></body>") for i in range(4)]
    rows += [(40, "http://c.org/9", "<body><div>Top</div><p>" + "Something else " * 9 + "</p></body>")]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Lead {i}\nBody {i}" for i in range(3))
    assert all(found[i].startswith("Long line 0") and found[i].endswith(f"End {i - 10}") for i in range(10, 15))
    assert found[20] == "Other story" and all(found[i] == "Same" for i in range(30, 34))


def test_common_lines():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = html_text.common_lines(a, b)
        assert len(places) == best[-1][-1] and places == sorted(set(places))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in places)


def test_mixing(spark, docs, plain):
    even = mixing.mix(docs, weights={"s0": 1.0, None: 1.0}, total=40).collect()
    assert {r["source"] for r in even} <= {"s0", None} and {r["row"] for r in even} == {"clash"}
    rows = [(i, f"t{i}", "s" if i % 10 else "rare") for i in range(20000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(table, weights={"s": 1.0, "rare": 3.0})
    sizes = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(sizes["s"] - 5000) < 350 and abs(sizes["rare"] - 15000) < 600
    copies = Counter(r["count"] for r in mixed.where("source = 'rare'").groupBy("doc_id").count().collect())
    mean = 7.5
    expected = 2000 * math.exp(-mean) * mean**7 / math.factorial(7)
    assert abs(copies[7] - expected) < 6 * math.sqrt(expected)
    assert mixing.mix(empty(docs)).count() == 0


def test_pipeline(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns, name
        rows = materialise(after)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    reference = Tokenizer.from_file(TOKENIZER)
    want = Counter(
        (r["doc_id"], len(reference.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows.collect()
    )
    assert Counter((r["doc_id"], r["n_tokens"]) for r in result) == want and result


def test_sketches_never_rule_out_links():
    from gradeloom.llm import jaccard_join as join

    rng = np.random.default_rng(3)
    for n in (5, 400, 3_000, 20_000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.11, 0.3):
            away = int(len(x) * share)
            y = np.unique(np.concatenate([x[away:], rng.integers(0, 1 << 63, 2 * away, dtype=np.uint64)]))
            p, q = (np.frombuffer(join.sketch(v), np.uint8) for v in (x, y))
            slices = min(len(p), len(q))
            apart = np.abs(join.folded(p, slices) - join.folded(q, slices)).sum()
            assert apart <= len(np.setxor1d(x, y))
    few = join.sketch(np.arange(1, dtype=np.uint64))
    assert len(few) == join.SLICES and np.frombuffer(few, np.uint8).sum() == 1


def test_large_groups_are_thinned_without_losing_links():
    from gradeloom.llm import jaccard_join as join

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 4_000, dtype=np.uint64))
    sets = [base, base[:3_700], np.unique(rng.integers(0, 1 << 63, 4_000, dtype=np.uint64)), base[:3_000], base[100:]]
    table = pa.table({
        "g": pa.array([1] * 5), "set": pa.array([10, 11, 12, 13, 14]), "comp": pa.array([10, 11, 12, 13, 10]),
        "n": pa.array([len(x) for x in sets]), "sketch": pa.array([join.sketch(x) for x in sets], pa.binary()),
    })
    kept = join.near_members(90)(table)["set"].to_pylist()
    assert {10, 11, 14} <= set(kept) and 12 not in kept and 13 not in kept


def test_parts_of_linked_sets_agree():
    from gradeloom.llm import jaccard_join as join

    rng = np.random.default_rng(7)
    for percent in (80, 90):
        parts = join.Parts(percent)
        for n in [*range(1, 60), 200, 999, 5_000]:
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for away in {0, n * (100 - percent) // (100 + percent), n * (100 - percent) // 100}:
                for fresh in {0, away}:
                    y = np.unique(np.concatenate([x[away:], rng.integers(0, 1 << 63, fresh, dtype=np.uint64)]))
                    both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
                    if both < union and 100 * both >= percent * union:
                        assert len(np.intersect1d(parts.signatures(x), parts.signatures(y))), (percent, n, away, fresh)
