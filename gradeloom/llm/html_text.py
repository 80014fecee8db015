"""Main text of web pages by differencing each page against the one of nearest URL.

A page becomes its lines: the text of its blocks, without what its markup names
as furniture (menus, footers, asides, adverts, forms, scripts, comments). Pages
with other lines than their host's earlier ones are put in the order of (host,
path, query); each one is paired with the nearest page of its host, before or
after it, that is not a copy of it, the one whose address has the longer common
beginning. Lines that both have, by a longest common subsequence, are the
furniture of the site and are deleted.

Lines inside an ``article`` or ``main`` element, which the page itself marks as
its text, are kept from differencing, and it decides all other lines, on pages
with such an element too. Hosts whose pages have no other lines are left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import number_rows
from ..session import materialise
from .common import in_batches

#: A neighbour that shares this part of the smaller page's characters is a copy, not a sibling.
COPY_SHARE = 0.8
#: A line outside of an article is a menu if links hold more than this part of it.
LINK_SHARE = 0.5

#: Bits of rows that a comparison of two pages keeps at a time.
ROW_BITS = 1 << 27

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][\w:-]*)(?P<attrs2>[^>]*+)>|<[!?][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ADDRESS = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?")

# Elements by their part in a page, and words that name furniture in a class, id or role.
RAW = frozenset("script style noscript textarea title iframe svg template object select math canvas audio video".split())
FURNITURE = frozenset("head nav footer aside button menu dialog label input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "complementary contentinfo disqus footer menu modal nav navbar navigation newsletter notice overlay popup promo related "
    "replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Words beside a name of furniture that leave it one: in an article a name counts only if all its words are of these.
PLACES = frozenset(
    "area bar block body box button buttons container content feed footer form foot group head header holder inner item items "
    "layer left link links list module outer panel post posts right section slot stories story thread top bottom unit wrap wrapper".split()
)
#: Elements whose names count in an article; a paragraph or heading is text whatever it is called.
BOXES = frozenset("div section ul ol dl table figure span center aside details".split())
# Words that make a class a state of the element (has-sidebar, comments-open) and no name of its part.
STATES = frozenset("has is no with without".split())
STATES_AFTER = frozenset("open closed enabled disabled on off".split())


def _names_furniture(value: str, in_main: bool) -> bool:
    """Whether one of the names in a class, id or role is that of furniture, not of a state of the element.

    In the main part every word of the name must be one of furniture, or of a place of it.
    """
    for one in value.split():
        parts = [p for p in re.split(r"[_-]+", one) if p]
        if HINTS.isdisjoint(parts) or (len(parts) > 1 and (parts[0] in STATES or parts[-1] in STATES_AFTER)):
            continue
        if in_main and not all(p in HINTS or p in PLACES or p.isdigit() for p in parts):
            continue
        return True
    return False


def _part(name: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the page's main part."""
    drop = name in FURNITURE or (name == "header" and not in_main)
    main = name in MAIN
    if attrs:
        for key, a, b, c in ATTRIBUTE.findall(attrs):
            value = (a or b or c).lower()
            if key.lower() == "aria-hidden":
                drop = drop or value == "true"
            elif value in ("main", "articlebody"):
                main = True
            elif _names_furniture(value, in_main):
                drop = drop or (name not in ("html", "body") and (not in_main or name in BOXES))
            elif value == "banner" or (value in ("header", "site-header", "page-header") and not in_main):
                drop = True
    return drop, main


class _Open:
    """The elements that are open, with counts of what they are, so that each costs the same however deep it lies."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.drops = self.fixed = self.mains = 0

    def push(self, name: str, drop: bool, main: bool) -> None:
        self.places.setdefault(name, []).append(len(self.elements))
        self.elements.append((name, drop, main))
        self._count(name, drop, main, 1)

    def _count(self, name: str, drop: bool, main: bool, by: int) -> None:
        self.drops += by * drop
        self.fixed += by * (drop and name in FURNITURE)
        self.mains += by * main

    def last(self, name: str) -> int:
        """Depth of the innermost element of the name; -1 if none is open."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def first_above(self, name: str, depth: int) -> int | None:
        """Depth of the outermost element of the name that lies deeper than ``depth``."""
        places = self.places.get(name, [])
        at = bisect_right(places, depth)
        return places[at] if at < len(places) else None

    def pop_to(self, depth: int) -> None:
        while len(self.elements) > depth:
            name, drop, main = self.elements.pop()
            self.places[name].pop()
            self._count(name, drop, main, -1)

    def rescue(self) -> None:
        """Take back that the open elements are furniture, which a main part inside shows they are not."""
        self.elements = [(name, False, main) for name, _, main in self.elements]
        self.drops = self.fixed = 0


def page_lines(page: str) -> list[tuple[str, bool]]:
    """(text, in the main part) of every block that is not furniture, in page order.

    Character references are decoded, white space becomes one space, empty
    blocks have no line. Unclosed elements end with their parent, a paragraph
    also at the next block. A form is furniture unless it holds a main part, or,
    on a page that has none, a heading and a paragraph. The time grows with the page's length, whatever
    its depth and however many elements or quotes are left open.
    """
    lines: list[tuple[str, bool | None]] = []  # None: in a form that counts only on a page without a main part
    elements = _Open()
    words: list[str] = []
    linked = 0
    forms: list[list] = []  # first line, whether there is a main part, a heading, a paragraph
    unclosed: set[str] = set()

    def end_block() -> None:
        nonlocal linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text and (elements.mains or linked <= LINK_SHARE * len(text)):
                lines.append((text, elements.mains > 0))
                if forms and elements.last("p") >= 0:
                    forms[-1][3] = True
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not elements.drops:
            words.append(text)
            if elements.last("a") >= 0:
                linked += len(text.strip())

    def close_forms(depth: int) -> None:
        while forms and len(forms) > bisect_left(elements.places["form"], depth):
            first, main, heading, paragraph = forms.pop()
            if not main and not (heading and paragraph):
                del lines[first:]
                continue
            if not main:
                lines[first:] = [(text, None) for text, _ in lines[first:]]
            if forms:
                forms[-1][1:] = [x or y for x, y in zip(forms[-1][1:], (main, heading, paragraph))]

    def pop_to(depth: int) -> None:
        close_forms(depth)
        elements.pop_to(depth)

    at, last = 0, page.rfind(">") + 1
    while match := TOKEN.search(page, at, last):
        add(page[at : match.start()])
        at = match.end()
        if at == last and match[0].startswith(("<!--", "<![CDATA[")) and not match[0].endswith(("-->", "]]>")):
            at = len(page)  # never closed, so it goes on to the end
        if match["data"] is not None:
            add(html.escape(match["data"] + page[match.end() : at]))
        name = match["name"] or match["name2"]
        if not name:
            continue
        name = name.lower()
        attrs = match["attrs"] or match["attrs2"] or ""
        block = name in BLOCKS
        if block:
            end_block()
        if match["close"] or match["close2"]:
            if elements.last(name) >= 0:
                pop_to(elements.last(name))
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = None if name in unclosed else re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
                if end is None:
                    unclosed.add(name)
                at = end.end() if end else (len(page) if name in ("script", "style") else at)
            continue
        if name in VOID:
            if name in ("br", "img") and not elements.drops:
                words.append(" ")
            continue
        if block:
            barrier = max(elements.last(b) for b in ("ul", "ol", "div", "article", "td", "section"))
            ends = [d for n in ("p", "li")[: 1 + (name == "li")] if (d := elements.first_above(n, barrier)) is not None]
            if ends:
                pop_to(min(ends))
        elif name in ("td", "th") and not elements.drops:
            words.append(" ")
        if attrs.rstrip().endswith("/"):
            continue
        own_drop, own_main = _part(name, attrs, elements.mains > 0)
        if name in MAIN and elements.drops and not elements.fixed:
            elements.rescue()
        if forms:
            forms[-1][1] = forms[-1][1] or own_main
            forms[-1][2] = forms[-1][2] or (name in HEADINGS and not elements.drops)
        if name == "form":
            forms.append([len(lines), False, False, False])
        elements.push(name, own_drop, own_main)
    tail = page[at:]
    add(tail[: re.search(r"<!--|<!\[CDATA\[|\Z", tail).start()])
    end_block()
    close_forms(0)
    has_main = any(main for _, main in lines)
    return [(text, bool(main)) for text, main in lines if main is not None or not has_main]


def address(url: str | None) -> tuple[str | None, str, str]:
    """Host, path and query of a URL, without scheme, fragment, and the path's final slash and page suffix."""
    match = ADDRESS.match(url or "")
    if not match:
        return None, "", ""
    return match[1].lower(), re.sub(r"(\.html?)?/*$", "", match[2]), match[3] or ""


def parsed(pages: DataFrame) -> DataFrame:
    """Pages as lines, with host, path, query, a hash of every line and one of all.

    ``outside`` tells whether a line is in no main part.
    """

    def parse(batch: pa.RecordBatch) -> dict:
        urls = batch.column(1).to_pylist()
        found = [page_lines(p or "") for p in batch.column(2).to_pylist()]
        addresses = [address(u) for u in urls]
        return {
            "page_id": batch.column(0), "url": batch.column(1), "host": [a[0] for a in addresses],
            "path": [a[1] for a in addresses], "query": [a[2] for a in addresses],
            "digest": [xxhash.xxh3_128_digest("\n".join(t for t, _ in lines)) for lines in found],
            "outside": [any(not m for _, m in lines) for lines in found],
            "lines": [[{"text": t, "main": m, "at": i} for i, (t, m) in enumerate(lines)] for lines in found],
            "hashes": [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in lines] for lines in found],
            "sizes": [[len(t) for t, _ in lines] for lines in found],
        }

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = (
        f"page_id {kind}, url string, host string, path string, query string, digest binary, outside boolean, "
        "lines array<struct<text:string,main:boolean,at:int>>, hashes array<long>, sizes array<int>"
    )
    return in_batches(pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")), schema, parse)


def _rows(a: list[int], masks: dict[int, int], width: int) -> Iterator[int]:
    """After each element of ``a`` a bit row over ``b``; its zeros below a place count the longest common subsequence there."""
    full = (1 << width) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _masks(b: list[int]) -> dict[int, int]:
    """Bits of the places of every element."""
    found: dict[int, bytearray] = {}
    for j, x in enumerate(b):
        found.setdefault(x, bytearray((len(b) + 7) // 8))[j >> 3] |= 1 << (j & 7)
    return {x: int.from_bytes(bits, "little") for x, bits in found.items()}


def _zeros(row: int, width: int) -> list[int]:
    """Number of zeros of a bit row below every place."""
    counts = [0]
    for bit in reversed(bin(row | 1 << width)[3:]):
        counts.append(counts[-1] + (bit == "0"))
    return counts


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal beginnings and ends are taken off first. Lengths are found for a
    machine word of ``b`` at a time, whatever repeats; where the rows would take
    much memory, ``a`` is halved at the best place of ``b``.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    middle: list[int] = []
    todo = [(start, len(a) - end, start, len(b) - end)]
    while todo:
        i, to, j, upto = todo.pop()
        # Lines that the other page lacks match nothing.
        other = set(b[j:upto])
        own = [k for k in range(i, to) if a[k] in other]
        seen = {a[k] for k in own}
        theirs = [x for x in b[j:upto] if x in seen]
        if not own or not theirs:
            continue
        if len(own) == 1:
            middle.append(own[0])
        elif len(own) * len(theirs) <= ROW_BITS:
            middle += [own[k] for k in _traced([a[k] for k in own], theirs)]
        else:
            half, width = len(own) // 2, len(theirs)
            *_, ahead = _rows([a[k] for k in own[:half]], _masks(theirs), width)
            *_, behind = _rows([a[k] for k in own[: half - 1 : -1]], _masks(theirs[::-1]), width)
            before, after = _zeros(ahead, width), _zeros(behind, width)[::-1]
            best = max(range(width + 1), key=lambda k: before[k] + after[k])
            places = [k for k in range(j, upto) if b[k] in seen]
            cut = places[best] if best < width else upto
            todo += [(i, own[half], j, cut), (own[half], to, cut, upto)]
    return [*range(start), *sorted(middle), *range(len(a) - end, len(a))]


def _traced(a: list[int], b: list[int]) -> list[int]:
    """``common_lines`` by keeping every row."""
    rows = list(_rows(a, _masks(b), len(b)))
    i, j, places = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1  # as long without b's last line
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1  # as long without a's last line
        else:
            i, j = i - 1, j - 1
            places.append(i)
    return places[::-1]


def _shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compared(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """(no, to, copy, near, shared) of the pairs (no, to) of pages of one host, by their numbers in ``placed``.

    ``shared`` has the places of the lines that page ``no`` has in common with
    page ``to``, ``near`` the length of their addresses' common beginning.
    """
    page = F.struct("path", "query", "hashes", "sizes")
    met = pairs.join(placed.select("no", "host", page.alias("page")), "no")
    met = met.join(placed.select(F.col("no").alias("to"), F.col("host").alias("_host"), page.alias("other")), "to")

    def match(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"copy": [], "near": [], "shared": []}
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            same = (x["path"], x["query"]) == (y["path"], y["query"])
            places = [] if same else common_lines(x["hashes"], y["hashes"])
            chars = sum(x["sizes"][i] for i in places)
            copy = same or chars >= COPY_SHARE * max(1, min(sum(x["sizes"]), sum(y["sizes"])))
            out["copy"].append(copy)
            out["near"].append(_shared_path(f"{x['path']}?{x['query']}", f"{y['path']}?{y['query']}"))
            out["shared"].append([] if copy else places)
        return {"no": batch.column(0), "to": batch.column(1), **out}

    met = met.where(F.col("host") == F.col("_host")).select("no", "to", "page", "other")
    return materialise(in_batches(met, "no long, to long, copy boolean, near int, shared array<int>", match))


def run_ends(copies: DataFrame) -> DataFrame:
    """(no, ahead, end): the last page of the run of copies that page ``no`` begins, in either direction.

    ``copies`` has the pairs (no, to) of adjacent copies. The steps double, so a
    run of any length takes a few joins and no task holds it.
    """
    hops = materialise(copies.select("no", (F.col("to") > F.col("no")).alias("ahead"), F.col("to").alias("end")))
    while True:
        further = hops.select(F.col("no").alias("end"), "ahead", F.col("end").alias("_further"))
        joined = hops.join(further, ["end", "ahead"], "left")
        after = materialise(joined.select(
            "no", "ahead", F.coalesce("_further", "end").alias("end"), F.col("_further").isNotNull().alias("moved")
        ))
        hops = after.drop("moved")
        if after.where("moved").isEmpty():
            return hops


def shared_lines(pages: DataFrame) -> DataFrame:
    """(row, shared): places of the lines that a page has in common with the nearest one that is no copy of it.

    Equal lists of lines of a host are one page. The order is global and
    range-partitioned, so a host with a third of all pages is spread over a
    third of the tasks; neighbours meet by their number. Pages whose neighbour
    is a copy go on behind the run of copies.
    """
    keyed = pages.where(F.col("host").isNotNull() & (F.size("hashes") > 0))
    keyed = keyed.join(materialise(keyed.where("outside").select("host").distinct()), "host", "left_semi")
    first = keyed.groupBy("host", "digest").agg(F.min(F.struct("path", "query", "row")).alias("first"))
    order = [F.col(c) for c in ("host", "path", "query", "row")]
    numbered = number_rows(first.select("host", "digest", "first.*"), [], order, "no", start=0)
    placed = materialise(numbered.join(keyed.select("row", "hashes", "sizes"), "row"))
    beside = lambda step: placed.select("no", (F.col("no") + step).alias("to"))
    met = compared(beside(-1).unionByName(beside(1)), placed)
    found, copies, ends = met.where(~F.col("copy")), met.where("copy").select("no", "to"), None
    while not copies.isEmpty():
        ends = run_ends(copies) if ends is None else ends
        ahead = copies.withColumn("ahead", F.col("to") > F.col("no"))
        behind = ahead.join(ends.withColumnRenamed("no", "to"), ["to", "ahead"], "left")
        step = F.when(F.col("ahead"), 1).otherwise(-1)
        met = compared(behind.select("no", (F.coalesce("end", "to") + step).alias("to")), placed)
        found, copies = found.unionByName(met.where(~F.col("copy"))), met.where("copy").select("no", "to")
    nearest = found.groupBy("no").agg(F.max(F.struct("near", F.col("to") < F.col("no"), "shared")).alias("best"))
    shared = nearest.join(placed.select("no", "host", "digest"), "no").select("host", "digest", "best.shared")
    return keyed.where("outside").select("row", "host", "digest").join(materialise(shared), ["host", "digest"]).select("row", "shared")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of characters, for every row of ``pages``.

    The text is the lines in an article or main element, and of the others
    those that the nearest page of the host does not share. Null html counts as
    empty, a page without text has an empty one, a page without a host has no
    neighbour. Repeated rows of one URL are copies and not compared with each
    other. Pages are read whole and in time that grows with their length, two
    pages are compared line by line whatever repeats in them. An empty table
    gives no rows. Further columns are not read.
    """
    table = materialise(parsed(pages).withColumn("row", F.monotonically_increasing_id()))
    shared = materialise(shared_lines(table))
    joined = table.select("row", "page_id", "url", "lines").join(shared, "row", "left")
    kept = F.filter("lines", lambda x: x["main"] | F.coalesce(~F.array_contains("shared", x["at"]), F.lit(True)))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return (
        joined.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
