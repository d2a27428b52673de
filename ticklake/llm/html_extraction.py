"""Main text of web pages by consensus of each host's pages.

Every page scores its containers by the text that their blocks hold. A container's path, its tags and classes from the
root with numbers taken alike, gets the page's vote; Spark sums votes per host, and the path with most is where that
host keeps its articles. Each page is then read again along its host's path, or along its own best container's if the
page has nothing there. A page is read in time linear in its length, whatever its nesting, quotes or unclosed tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, small_side

OPENS = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
# fixed values: HTML elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset("address blockquote dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre summary table tbody tfoot th thead tr ul br aside footer form header nav dialog menu option select caption".split())
CLOSES_P = BLOCKS - {"br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# fixed values: elements, roles and class or id words that hold no article text
OUTSIDE = frozenset("nav header footer aside form button select option dialog menu svg canvas object audio video map head input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# what a class or id says by its last word: parts that never hold the article, and those that do where they are its frame or its own heading
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
COMMENT_PARTS = frozenset("author avatar count date footer header meta metadata name text time title".split())
PARTS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "cookie cookies consent gdpr alert popup modal newsletter subscribe subscription signup login share sharing social related recommended pagination pager widget toolbar".split()
)
FRAMES = frozenset("header footer side masthead banner notice notices overlay skip hidden".split())
# words about place and shape, which say nothing of what a part holds; words of the article; and of a layout
OTHERS = frozenset("articles posts stories reading content".split())  # after related and the like
SHAPES = frozenset("list lists item items wrap wrapper container section area box block body inner outer holder thread form content unit slot bar row col column group panel top bottom left right primary secondary mobile desktop sticky fixed links link button buttons icons".split())
ARTICLE = frozenset("article post entry story news blog".split())
HEADED = ARTICLE | frozenset("page content text main".split())
LAYOUT = frozenset("has no with without is".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _outside(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the element holds no article text, by its tag, role or style."""
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES or "display:none" in attributes.get("style", "").replace(" ", "")


def _named(tag: str, attributes: dict[str, str]) -> int:
    """What the classes and the id name: 0 nothing, 1 the frame of a page or a part beside the article, 2 a part that holds none whatever is in it.

    A name counts by its last word that isn't about place or shape: ``article-comments`` are comments, ``comment-on-policy``
    isn't one. ``header`` and the like of an article, such as ``entry-header``, are its own. An inline element counts by
    whole names that are one word only, an ``article`` or ``main`` by comments only.
    """
    if not attributes or tag in ("html", "body"):
        return 0
    if "comment" in attributes.get("itemtype", "").lower().rpartition("/")[2] or attributes.get("itemprop", "").lower() == "comment":
        return 2
    most = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if len(w) > 1]
        if not words or not LAYOUT.isdisjoint(words[:-1]) or (tag not in BLOCKS and len(words) > 1):
            continue
        shaped = len(words)
        while len(words) > 1 and words[-1] in SHAPES:
            words.pop()
        head = words[0] if words[-1] in OTHERS and words[0] in ("related", "recommended", "sponsored") else words[-1]
        if head in COMMENTS or (words[0] in COMMENTS and head in COMMENT_PARTS):
            return 2
        if tag in ("article", "main"):
            continue
        if head in FRAMES and (HEADED if head == "header" else ARTICLE).isdisjoint(words[:-1]):
            most = 1
        elif head in PARTS:  # as in content-sidebar-wrap, a part with a shape may be named for what stands in it
            most = max(most, 1 if shaped > len(words) and (head in ("sidebar", "nav", "menu") or not HEADED.isdisjoint(words)) else 2)
    return most


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = [re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()[:2]]
    return ".".join([tag, *classes])


class Element:
    """An element of a page; ``path`` names its innermost container's path by a hash of all its steps and the last one."""

    __slots__ = ("block", "container", "framed", "holds", "linked", "named", "outside", "parent", "path", "place", "score", "tag")

    def __init__(self, tag: str, path: str, place: int, parent: Element | None, outside: bool, named: int, linked: bool):
        self.tag, self.path, self.place, self.parent, self.outside, self.named, self.linked = tag, path, place, parent, outside, named, linked
        self.holds, self.score = tag if tag in ("article", "main") and not outside and named < 2 else "", 0.0
        self.framed = False
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.container = self if tag in CONTAINERS else parent and parent.container


class Page:
    """The elements of a page in order, and its pieces: a text with the element that it stands in, or None where a block starts or ends."""

    def __init__(self, html: str):
        root = Element("", "", 0, None, False, 0, False)
        self.elements, self.pieces = [root], []
        self.stack, self.open = [root], {}
        self._walk(html)
        for e in self.elements[1:]:
            e.outside = e.outside or e.named == 2 or e.parent.outside
            e.framed = e.named == 1 or e.parent.framed
        free = any(e.holds and not e.framed and not e.outside for e in self.elements)
        for e in reversed(self.elements[1:]):
            if e.holds and not e.outside:  # a main counts more than an article
                e.parent.holds = max(e.parent.holds, e.holds)
        for e in self.elements[1:]:  # a frame is kept for the page's main part, or for its articles where none stands free
            kept = e.holds == "main" or (e.holds == "article" and not free)
            e.outside = e.outside or e.parent.outside or (e.named == 1 and not kept)

    def _close(self, place: int) -> None:
        for e in self.stack[place:]:
            self.open[e.tag].pop()
        del self.stack[place:]

    def _last(self, tag: str) -> int:
        return self.open[tag][-1] if self.open.get(tag) else 0

    def _walk(self, html: str) -> None:
        stack, at, last, quotes = self.stack, 0, html.rfind(">"), True
        while at < len(html):
            m = OPENS.search(html, at)
            if m is None or m.start() > last:  # no tag ends any more, and no comment
                comment = html.find("<!--", at)
                self.pieces.append((stack[-1], html[at : comment if comment >= 0 else len(html)]))
                return
            if m.start() > at:
                self.pieces.append((stack[-1], html[at : m.start()]))
            if m[1]:
                end = html.find("-->", m.end())
                at = end + 3 if end >= 0 else len(html)
                continue
            tag, found = (m[3] or "").lower(), quotes and m[3] and QUOTED.match(html, m.end())
            if m[3] and quotes and not found:
                quotes = False  # a quote that never closes: none counts from here on
            at = found.end() if found else html.index(">", m.end()) + 1
            if not tag:
                continue
            if m[2]:
                if tag in BLOCKS:
                    self.pieces.append((stack[-1], None))
                place = self._last(tag)
                if place and (tag in BLOCKS or place > stack[-1].block.place):  # a stray end of an inline element closes no block
                    self._close(place)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = html.find(">", end.end()) + 1 if end else 0
                at = at or len(html)
                continue
            text = html[m.end() : at - 1]
            if tag in BLOCKS:
                self.pieces.append((stack[-1], None))
            if tag in VOID or text.endswith("/") and tag not in BLOCKS:
                continue
            block = stack[-1].block
            if tag in CLOSES_P and block.tag == "p":
                self._close(block.place)
            if limit := CLOSES_SAME.get(tag):
                place = self._last(tag)
                if place and place > max(map(self._last, limit)):
                    self._close(place)
            up, attributes = stack[-1], _attributes(text)
            path = up.path
            if tag in CONTAINERS:
                step = _step(tag, attributes)
                path = f"{blake2b(f'{path}/{step}'.encode(), digest_size=8).hexdigest()}/{step}"
            e = Element(tag, path, len(stack), up, _outside(tag, attributes), _named(tag, attributes), up.linked or tag == "a")
            self.open.setdefault(tag, []).append(len(stack))
            stack.append(e)
            self.elements.append(e)

    def scores(self) -> dict[str, float]:
        """Per path of containers, the best score of a container there. A text counts in full for the container of its block, in half for the next one out, and so on; text of links counts a quarter."""
        for e in self.elements:
            e.score = 0.0
        for e, text in self.pieces:
            if text is None or e.outside or not (size := len(text.strip())):
                continue
            block = e.block
            if block.tag in CONTAINERS and block.tag not in ("article", "main", "body", "html"):
                block = block.parent  # a block of its own: what holds it is the container
            if block.container is not None:
                block.container.score += size * (0.25 if e.linked else 1.0)
        found: dict[str, float] = {}
        for e in reversed(self.elements[1:]):
            if e.container is e and e.score:
                article = 1.25 if e.tag in ("article", "main") else 1.0
                found[e.path] = max(found.get(e.path, 0.0), e.score * article)
                if e.parent.container is not None:
                    e.parent.container.score += e.score / 2
        return found

    def text(self, path: str) -> str:
        """Text of the containers at ``path``; of the whole page if it is empty."""
        inside = {id(self.elements[0])} if not path else set()
        parts = []
        for e in self.elements[1:]:
            if id(e.parent) in inside or (e.container is e and e.path == path):
                inside.add(id(e))
        for e, text in self.pieces:
            parts.append(" " if text is None or e.outside or id(e) not in inside else unescape(text))
        return " ".join("".join(parts).split())


def read(html: str, path: str | None) -> str:
    """Text of the containers at ``path``; of the page's own best ones if there are none."""
    page = Page(html)
    if path and (out := page.text(path)):
        return out
    ranked = page.scores()
    return page.text(max(reversed(ranked), key=ranked.__getitem__) if ranked else "")  # of equal ones the first in the page


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            host, path, weight = [], [], []
            for h, html in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = Page(html.as_py() or "").scores()
                total = sum(found.values())
                for p, score in found.items():
                    host.append(h)
                    path.append(p)
                    weight.append(round(1_000_000 * score / total))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(weight, pa.int64())], ["host", "path", "weight"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host`` and the ``path`` with most votes of its pages; a page votes for all its containers' paths in proportion to their scores."""
    rows = pages.select(_host(url), F.col(html).cast("string").alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, weight bigint").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return votes.groupBy("host").agg(F.max(F.struct("weight", "path")).alias("best")).select("host", "best.path")


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), HOST, 1), F.lit(""))).alias("host")


def _read(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [read(html.as_py() or "", path) for path, html in zip(part.column(2).to_pylist(), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names)

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` (the article without menus, headers, forms, adverts, comments and the like; blocks joined by one space) and ``n_chars`` (code points).

    A null or empty html, and one without text, gives an empty text. Pages without a readable host share the host ``''``.
    A tag that never ends is text; once a quote in a tag never closes, quotes don't count in the rest of the page. Very
    long pages and deep nesting are read whole, in time linear in their length, one page at a time.
    Rows are read each for itself; equal rows get equal results; an empty table gives none; other columns are ignored.
    Hosts' paths are broadcast while few; beyond that pages are joined by host, where a large host's part is split.
    """
    paths = small_side(cut(host_paths(pages, url, html)), 200_000)
    rows = pages.select(F.col(page_id), F.col(url), _host(url), F.col(html).cast("string").alias("__html")).join(paths, "host", "left")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    schema = f"`{page_id}` {kinds[page_id]}, `{url}` {kinds[url]}, text string"
    read_again = rows.select(page_id, url, "path", "__html").mapInArrow(_read([page_id, url, "text"]), schema)
    return read_again.withColumn("n_chars", F.char_length("text").cast("bigint"))
