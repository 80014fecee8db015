"""Phrases, url rules and the filter audit against brute force, with nulls, repeats, ties and odd texts."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from gradeloom.llm import filter_audit, phrase_mining, url_filter
from gradeloom.llm.common import ship


# --- phrases ----------------------------------------------------------------


def brute_phrases(rows, longest, threshold, cover, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    out = {}
    for (lang, w), a in found.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(m == lang and len(v) > len(w) and inside(v) and 100 * b >= cover * a for (m, v), b in found.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score))
    rows = []
    for lang, phrases in out.items():
        phrases.sort(key=lambda p: (-p[5], -p[1], p[0].encode()))
        rows += [(lang, i, *p) for i, p in enumerate(phrases[:top], 1)]
    return sorted(rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "new", "york", "city", "été", "日本", "a-b", "x\x1f", "z" * 5000, "q\u00a0r"]
    rows = [(None, "en"), ("", None), ("   \t ", "en"), (".,;:", "en"), ("one", "fr"), (" New York.City, ", "und")]
    for _ in range(250):
        n = rng.randrange(40)
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"]) for _ in range(n))
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    return rows + rows[20:30] + [("new york city " * 3000, "en")]


@pytest.mark.parametrize("threshold,cover,top,slice_bytes", [(5, 100, 2000, 1 << 22), (3, 60, 7, 900), (1, 100, 50, 1 << 22)])
def test_phrases(spark, texts, monkeypatch, threshold, cover, top, slice_bytes):
    ship(spark)
    monkeypatch.setattr(phrase_mining, "SLICE_BYTES", slice_bytes)
    rows = texts if threshold > 1 else texts[:60]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = phrase_mining.mine(docs, threshold=threshold, cover_percent=cover, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, threshold, cover, top)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")
    assert phrase_mining.mine(docs.limit(0)).collect() == []
    assert phrase_mining.mine(docs).collect() == []


def test_summaries_keep_every_frequent_key():
    """Merged in any grouping, no key that reaches mass / capacity is lost, and no count is off by more than was taken."""
    rng = np.random.default_rng(5)
    stream = np.concatenate([rng.zipf(1.3, 20_000) % 5000, rng.integers(5000, 30_000, 20_000), np.full(900, 7)]).astype(np.uint32)
    rng.shuffle(stream)
    true = Counter(stream.tolist())
    threshold = 250
    capacity = len(stream) // threshold + 1
    for pieces in (3, 40):
        keys, counts, off = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        for piece in np.array_split(stream, pieces):
            own_keys, own_counts, own_off = phrase_mining.merge(piece, np.ones(len(piece), np.int64), capacity)
            keys, counts, more = phrase_mining.merge(np.append(keys, own_keys), np.append(counts, own_counts), capacity)
            off += own_off + more
        held = dict(zip(keys.tolist(), counts.tolist()))
        assert 0 < off < threshold and len(held) <= capacity
        assert {k for k, n in true.items() if n >= threshold} <= held.keys()
        assert all(true[k] - off <= n <= true[k] for k, n in held.items())


def test_packed_counts():
    counts = np.array([1, 255, 254, 10**12, 3], np.int64)
    assert phrase_mining._unpacked(phrase_mining._packed(counts), 5).tolist() == counts.tolist()


# --- urls -------------------------------------------------------------------

HOSTS = ["a.net", "net", "bnet", "example.net", "www.Example.NET", "xexample.net", "example.com", "a.b.org", "casino-win.example.com",
         "casinos.example.com", "mycasino.io", "bücher.net", "net:80", "", ".net", "adult"]
TAILS = ["", "/", "/en/1", "/EN/1", "/de/", "/de", "/fr/x?y=/de/", "?q=casino", "#top", "/x#a?b", "/casino.html", "/en/ads/1", "//", "/a b\nc"]


def brute_verdict(url, patterns):
    url_ = url or ""
    host = path = ""
    if "://" in url_:
        rest = url_.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule, verdict in url_filter.HOST_RULES:
        h, _, p = rule.partition("/")
        if f".{host}".endswith(f".{h}") and path.startswith(f"/{p}"):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), url_)
    hits = [v for test, v in patterns if test(lower)]
    return host, path, None, "allow" if "allow" in hits else "block" if hits else "allow"


def test_urls(spark):
    patterns = [("^casino^", "block"), ("||adult^", "block"), ("*ads/*", "block"), ("|https://a.b.", "block"), ("^html|", "block"), ("^top|", "allow")]
    whole = lambda w: re.compile(rf"(^|[^a-z0-9]){w}([^a-z0-9]|\Z)").search
    brute = [(whole("casino"), "block"), (re.compile(r"://([^/?#]*\.)?adult([^a-z0-9]|\Z)").search, "block"), (lambda u: "ads/" in u, "block"),
             (lambda u: u.startswith("https://a.b."), "block"), (re.compile(r"(^|[^a-z0-9])html\Z").search, "block"),
             (re.compile(r"(^|[^a-z0-9])top\Z").search, "allow")]
    urls = [f"{s}://{h}{t}" for s in ("http", "https") for h in HOSTS for t in TAILS]
    urls += [None, "", "no scheme", "a://b://net/x", "http://www." + "x." * 3000 + "net/", "http://y.com/" + "casino" * 5000, "http://y.com/-casino"]
    urls += ["http://hot.example.org/x"] * 500 + ["http://www.net/"] * 3
    rows = [(i if i % 50 else None, u, "h", "v", "r") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, rule_text string").repartition(4)
    got = url_filter.judge(pages, pattern_rules=patterns)
    want = Counter((r[0], *brute_verdict(r[1], brute)) for r in rows)
    assert Counter(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert got.where("rule IS NOT NULL AND pattern IS NOT NULL").count() == 0


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0)).collect() == []
    assert [tuple(r) for r in url_filter.judge(pages, (), ()).collect()] == [(1, "a.net", "/", None, "allow", None)]


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://site{i}.example.net/en/",) for i in range(9)] + [("http://example.io/",)], "lower string")
    rules = [url_filter.host_rule("example.net/en/", "allow"), url_filter.pattern_rule("^en^io^", "block"), url_filter.pattern_rule("cas*no", "block")]
    filed = {r["rule_text"]: r["token"] for r in url_filter.rule_index(urls, rules).collect()}
    assert filed == {"example.net/en/": "en", "^en^io^": "io", "cas*no": ""}


# --- filters ----------------------------------------------------------------


def brute_audit(docs, labels):
    rows, good, toxic = [], Counter(), Counter()
    for i, quality, bad in labels:
        good[i] |= int(quality == 1)
        toxic[i] |= int(bad == 1)
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((source or "", {k for k, x in fails.items() if x}, 0 if i is None else good[i], 0 if i is None else toxic[i]))
    out, removals = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                failing = [r for r in own if name in r[1]]
                removals[part, name] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                            sum(r[1] == {name} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, removals[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(260))
    texts = [None, "", " \n\t\x0b", "short text", long, long + " 100%", "ha " * 300, "HA " * 300, long.upper(), "é" * 5000, "x y " * 150 + "\x85#"]
    docs = [(i, rng.choice(texts), rng.choice(["s0", "s0", "s1", None, ""])) for i in range(120)]
    docs += [docs[5], docs[7], (5, "another text of an id stored twice", "s0"), (None, long, "s1"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, text string, source string, part string, n int").repartition(4)
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = filter_audit.audit(table, marks)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert filter_audit.audit(table.limit(0), marks).collect() == []
    assert filter_audit.audit(table, marks.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0
