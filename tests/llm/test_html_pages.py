"""Pages that are odd, long or hostile, and differencing against brute force."""

import random
import time

import pytest

from gradeloom.llm import html_text
from gradeloom.llm.common import ship


def text(page):
    return "\n".join(t for t, _ in html_text.page_lines(page))


@pytest.mark.parametrize("page,want", [
    ("<body><form action=/><h1>Head</h1><p>All of the page is in one form.</p><input><button>Go</button></form></body>", "Head\nAll of the page is in one form."),
    ("<form><article><p>In a form</p></article></form><form>Find <input name=q></form>", "In a form"),
    ("<article><p>Body</p></article><form><h3>News</h3><p>Write to us</p></form>", "Body"),
    ("<article><p>Body</p><form><h3>Reply</h3><p>Your name</p></form></article>", "Body"),
    ("<article><section class='popup-culture'><p>One</p></section><div class='related-work'>Two</div><p id='search'>Three</p></article>", "One\nTwo\nThree"),
    ("<article><p>One</p><div class='comment-list'><p>first!</p></div><div class='ad-box'>Buy</div><ul class=share><li>x</li></ul></article>", "One"),
    ("<div class='sidebar left'>x</div><div class='popup-culture'>y</div><p>z", "z"),
    ("<article>a<!-- never closed <p>b", "a"),
    ("<article><p>1 < 2 and 3 > 2</p><a href=\"x", "1 < 2 and 3 > 2\n<a href=\"x"),
    ("<div class=nav><div>m</div></div></div></p><p>k</p>", "k"),
])
def test_parts(page, want):
    assert text(page) == want


def test_long_pages_take_time_by_their_length():
    n = 40_000
    pages = ["<div>" * n, "<div>" * n + "</b>" * n, "<a href=\"x " * n, "<svg>" * n, "<b>" * n + "<p>x" * n, "<ul>" + "<li>a" * n,
             "<form>" * n + "<h1>x<p>y", "<!--" * n, "&amp" * n, "<p>" + "word " * n, "<![CDATA[" * n]
    for page in pages:
        start = time.perf_counter()
        html_text.page_lines(page)
        assert time.perf_counter() - start < 5, page[:12]
    for a, b in (([1] * 9000, [2] + [1] * 9001 + [3]), (list(range(30_000)), list(range(30_000, 0, -1)))):
        start = time.perf_counter()
        html_text.common_lines(a, b)
        assert time.perf_counter() - start < 10


@pytest.mark.parametrize("bits", [1, 40, 1 << 27])
def test_common_lines_in_any_memory(monkeypatch, bits):
    monkeypatch.setattr(html_text, "ROW_BITS", bits)
    rng = random.Random(bits)
    for _ in range(200):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = html_text.common_lines(a, b)
        assert len(places) == best[-1][-1] and places == sorted(set(places))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in places)


def brute(rows):
    """Every page against the neighbour of nearest address that is no copy, pages of equal lines being one."""
    split = lambda page: [t for t, _ in html_text.page_lines(page)]
    found = {}
    for host in {html_text.address(u)[0] for _, u, _ in rows}:
        own = {}
        for i, url, page in rows:
            if html_text.address(url)[0] == host:
                own.setdefault(tuple(split(page)), []).append((html_text.address(url)[1:], i))
        order = sorted((min(places)[0], min(places)[1], lines) for lines, places in own.items())
        for at, (place, _, lines) in enumerate(order):
            near = []
            for step in (-1, 1):
                k = at + step
                while 0 <= k < len(order):
                    other = order[k][2]
                    shared = html_text.common_lines(list(map(hash, lines)), list(map(hash, other)))
                    chars = sum(len(lines[x]) for x in shared)
                    sizes = [sum(map(len, x)) for x in (lines, other)]
                    if place != order[k][0] and chars < html_text.COPY_SHARE * max(1, min(sizes)):
                        same = html_text._shared_path("?".join(place), "?".join(order[k][0]))
                        near.append((same, step < 0, shared))
                        break
                    k += step
            drop = max(near)[2] if near else []
            kept = "\n".join(t for x, t in enumerate(lines) if x not in drop)
            for _, i in own[lines]:
                found[i] = kept
    return found


def test_differencing_of_pages_without_articles(spark):
    """Furniture that differs from site to site and stands beside the text, on pages without a main part."""
    ship(spark)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for host in range(4):
        menu, foot = [" ".join(word() for _ in range(2)) for _ in range(4)], " ".join(word() for _ in range(6))
        for k in range(25):
            body = [" ".join(word() for _ in range(12)) for _ in range(rng.randrange(1, 6))]
            blocks = [*menu[: rng.randrange(2, 5)], *body, foot]
            rows.append((len(rows), f"http://h{host}.org/{'ab'[k % 2]}/{k}", "<body>" + "".join(f"<div>{b}</div>" for b in blocks)))
    rows += [(len(rows) + i, f"http://h1.org/b/{3}?v={i}", rows[28][2]) for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert got == brute(rows)
