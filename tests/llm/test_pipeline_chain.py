"""The whole pipeline against its five stages written plainly, in one process."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gradeloom.llm.common import ship

VOCABULARY = {
    "en": "the and of that with for not have this but you from they which would there their what about when make".split(),
    "fr": "les des une dans pour avec sur est nous vous mais plus cette sont comme tout faire aussi leur bien".split(),
}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = random.Random(5)
    line = lambda g, n: " ".join(rng.choices(VOCABULARY[g], k=n))
    shared = {g: [line(g, 9) for _ in range(4)] for g in VOCABULARY}
    rows = []
    for i in range(90):
        g = "en" if i % 3 else "fr"
        lines = [line(g, rng.randrange(6, 14)) for _ in range(rng.randrange(2, 6))]
        if i % 4 == 0:
            lines[1:1] = shared[g][: 2 + i % 3]
        rows.append([i, "\n".join(lines), g if i % 5 else None, ["hot", "hot", "hot", "rare", None][i % 5]])
    for k, near in enumerate(range(10, 30)):  # near copies on one long line, and exact ones
        words = rows[near][1].split() * 3
        if k % 2:
            words[len(words) // 2] = words[0]
        rows.append([200 + k, " ".join(words), None, "hot"])
        rows.append([300 + k, " ".join([*words, words[1]]), None, "rare"])
    rows.append([400, "\n".join(shared["en"]), "en", "rare"])  # nothing but lines seen before
    rows += [[500, None, "en", "hot"], [501, "", "fr", "hot"], [502, "12 + 30 ..", None, "rare"]]
    rows += [[503, " ".join(["zzxqj", "qqkwx", "jxzvk"] * 20), None, "rare"], [504, line("fr", 3000), None, "hot"]]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in rows]


def identified(docs):
    known = defaultdict(set)
    for i, t, g, *_ in docs:
        if g and zlib.crc32(str(i).encode()) % 4 != 2:
            known[g].update((t or "").split())

    def share(words):
        return max(sum(w in own for w in words) / max(len(words), 1) for own in known.values())

    return [d for d in docs if share([w for w in (d[1] or "").split() if w.isalpha()]) >= corpus_pipeline.LEAST_SCORE]


def deduplicated(docs):
    seen, left = set(), []
    for i, t, g, s, n in sorted(docs):
        lines, gone, own = t.split("\n"), set(), set()
        for a in range(len(lines)):
            for e in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:e]) >= 5:
                    run = tuple(lines[a:e])
                    if run in seen or run in own:
                        gone.update(range(a, e))
                    own.add(run)
        seen |= own
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.strip():
            left.append((i, text, g, s, len(text) if gone else n))
    return left


def without_near_copies(docs):
    sets, root = [], list(range(len(docs)))
    for _, t, *_ in docs:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)), key=lambda k: docs[k][0])
                root[high] = low
    return [d for k, d in enumerate(docs) if find(k) == k]


def mixed(docs):
    sizes = Counter(d[3] for d in docs)
    whole = sum(math.sqrt(n) for n in sizes.values())
    found = []
    for d in docs:
        rate = round(math.sqrt(sizes[d[3]]) / whole * len(docs) / sizes[d[3]], 9)
        parts, copies = math.ceil(rate / 8), 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"17:{d[0]}:{j}".encode()).hexdigest()[:12], 16) / 2**48
            below, term, k = 0.0, math.exp(-rate / parts), 0
            while u >= below + term:
                below, k = below + term, k + 1
                term *= rate / parts / k
            copies += k
        found += [d] * copies
    return found


def encoded(docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.no_truncation()
    model.no_padding()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for i, t, *_ in docs:
        ids = model.encode(t, add_special_tokens=False).ids
        yield i, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids, skip_special_tokens=False))


def test_pipeline_equals_the_plain_chain(spark, tmp_path):
    ship(spark)
    docs = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (identified, deduplicated, without_near_copies, mixed)):
        before = docs
        docs = plain(docs)
        folder = str(tmp_path / name)
        stage(spark, at, str(tmp_path)).write.parquet(folder)
        at = spark.read.parquet(folder)
        assert at.columns == COLUMNS
        assert Counter(tuple(r) for r in at.collect()) == Counter(docs), name
        assert name == "mixing" and len(docs) != len(set(docs)) or len(docs) < len(before), name
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result)
    assert found == Counter(encoded(docs)) and found
