"""Main text of web pages by consensus of each host's pages.

Pass 1 finds every page's best container: the lowest one that holds nearly all text outside links and boilerplate.
A container with text of its own (a heading, a lead) is not left for a part of it, nor is an article. Each page votes
for the generalised path of its best container (tags with their classes, digits left out). The votes are counted by
host and path in Spark, and each host's path with most votes wins. Pass 2 reads every page again and extracts the
text of all containers at its host's path in page order, with the text right around them; a page without one, or with
far better text elsewhere, keeps its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, by
tag or role, or by class and id of the tags that make up a layout. A class or id counts only where all of its words
speak of boilerplate (``share-buttons``, not ``share-price``); headings, paragraphs and table cells are never judged by
theirs but for a class that is an advert's own, and an id within an article only where it is that of comments or adverts. An
article's own header stays. Character references are decoded, white space in a block becomes one space, and blocks are
joined in page order by a newline.

Pages are read in one pass without backtracking, and a container knows its parent and its own step alone, so time
and memory grow with the page's length even if it is one unfinished tag or nests without end.

Defined cases: null or broken html gives what text there is, empty if none; a quote without an end is a character of its
tag; an unfinished tag at a page's end is markup; very long and very deep pages are read whole, one at a time; a null url is a
host of its own; repeated rows repeat; ties of votes go to the smaller path; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, join_named, table, trimmed

#: Fixed values of HTML: elements without an end tag, raw text, what ends a paragraph, what a block is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt figcaption td th".split())
CONTAINER = frozenset("article body div main section".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea title dialog menu audio video xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Tags whose class and id are looked at: those that make up a layout.
JUDGED = frozenset("div section ul ol dl span center table html body main article details fieldset".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus respond replies reply widget widgets pagination pager toolbar skip login search".split()
)
#: What is left out even by an id in an article, and all that counts for the frames of a page: reader comments and adverts.
STRONG = frozenset("comment comments disqus respond reply replies ad ads adv advert adverts advertisement advertising sponsor sponsored promo share sharing newsletter cookie cookies consent gdpr".split())
FRAMES = frozenset("html body main article".split())
FRAME_WORDS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo".split())
#: A class of these, whole, marks any tag as an advert.
ADVERT = frozenset("ad ads advert adverts advertisement sponsored".split())
#: Words that may stand beside those above in the name of a part of the layout.
COMPANIONS = frozenset("area bar block bottom box button buttons container content desktop div form global header icons inner item items left li link links list main mobile module page panel post posts primary read more reader readers right secondary section site sticky strip the thread top user wrap wrapper".split())
#: A page keeps its own best container if the host's have less than this share of the text elsewhere.
LEAST_SHARE = 0.3
#: Nearly all text.
NEARLY = 0.9
#: Hosts that are broadcast with their paths; of more only the heavy ones are.
BROADCAST_ROWS = 100_000

#: A tag from its name on: values in quotes, other characters, a quote without an end. Nothing that matched is given back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's start ends: open elements of the first tags, if none of the second stands between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


class Node:
    __slots__ = ("tag", "step", "key", "out", "parent", "own", "total", "heading", "start", "end", "anchor", "up", "inside", "titled")

    def __init__(self, tag: str, step: str, out: bool, parent: Node | None, anchor: bool):
        self.tag, self.step, self.out, self.parent, self.anchor = tag, step, out, parent, anchor
        self.key = _key(parent.key, step) if parent is not None else 0
        self.own, self.total, self.heading = 0, 0, False  # characters outside links: right in it, in all of it; whether a heading is right in it
        self.start, self.end = 0, 0
        # the container around it; whether an article or main is; whether a heading is, within that container
        self.up = parent if parent is None or parent.parent is None or parent.tag in CONTAINER else parent.up
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.titled = tag in _HEADING or parent is not None and parent.tag not in CONTAINER and parent.titled

    @property
    def path(self) -> str:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return "".join(f">{x}" for x in reversed(steps))


def _key(above: int, step: str) -> int:
    """A number for a path: that of the path above and the last step."""
    return (above * 0x9E3779B97F4A7C15 + zlib.crc32(step.encode()) + 1) & (1 << 64) - 1


def _path_key(path: str) -> int:
    key = 0
    for step in path.split(">")[1:]:
        key = _key(key, step)
    return key


def _named(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id is that of boilerplate: its words are among ``words`` or their companions, one at least among ``words``."""
    parts = [w.lower() for w in _WORD.findall(name)]
    return any(w in words for w in parts) and all(w in words or w in COMPANIONS for w in parts)


def _left_out(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is boilerplate; ``inside`` tells that it is in an article or main."""
    if tag in LEFT_OUT:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if tag not in FRAMES and attributes.get("role", "").strip().lower() in ROLES:
        return True
    if "style" in attributes and _HIDDEN.search(attributes["style"]):
        return True
    named = attributes.get("class", "").split()
    if tag not in JUDGED:
        return any(c.lower() in ADVERT for c in named)
    words = FRAME_WORDS if tag in FRAMES else WORDS
    return any(_named(c, words) for c in named) or _named(attributes.get("id", ""), words & STRONG if inside or tag in FRAMES else words)


def _general(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"[\d>]+", "", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *filter(None, classes)])


class Page:
    """The containers of a page and its text pieces: (text, starts a block) in order."""

    def __init__(self, html: str):
        self.pieces: list[tuple[str, bool, bool]] = []  # text, left out, block boundary before it
        self.nodes: list[Node] = []
        self.top = Node("", "", False, None, False)
        self._read(html)

    def _read(self, html: str) -> None:
        stack, at, boundary = [self.top], 0, True
        places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
        blocks = [0]  # and of all open blocks
        block: list[tuple[Node, int, int]] = []
        pieces, nodes = self.pieces, self.nodes

        def last(*tags: str) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=0)

        def add(text: str) -> None:
            nonlocal boundary
            if text:
                here = stack[-1]
                pieces.append((unescape(text), here.out, boundary))
                boundary = False
                if not here.out:
                    n = len(text) - text.count(" ")
                    block.append((here, n, n if here.anchor else 0))

        def close_block() -> None:
            """Count the block's text for the container around it."""
            nonlocal boundary
            boundary = True
            if block:
                node = block[0][0]
                gain = sum(x[1] - x[2] for x in block)
                heading = gain > 0 and node.tag not in CONTAINER and node.titled
                if node.parent is not None and node.tag not in CONTAINER:
                    node = node.up
                node.own += gain
                node.heading = node.heading or heading
                block.clear()

        def pop_to(depth: int) -> None:
            """Close all elements from a place in the stack on."""
            while len(stack) > depth:
                node = stack.pop()
                places[node.tag].pop()
                if node.tag in BLOCK:
                    blocks.pop()
                    close_block()
                node.end = len(pieces)

        n = len(html)
        while at < n:
            k = html.find("<", at)
            if k < 0:
                add(html[at:])
                break
            sign = html[k + 1 : k + 3]
            if not (sign[:1].isascii() and sign[:1].isalpha() or sign[:1] in ("!", "?", "/") and sign):
                add(html[at : k + 1])
                at = k + 1
                continue
            if k > at:
                add(html[at:k])
            m = _TAG.match(html, k) if sign[0] not in "!?" else None
            if m is None:
                if sign[0] in "!?" or sign[0] == "/" and not (sign[1:].isascii() and sign[1:].isalpha()):
                    # a comment or declaration, to the page's end if it has none itself
                    mark = "-->" if html.startswith("<!--", k) else ">"
                    end = html.find(mark, k + 2)
                    at = end + len(mark) if end >= 0 else n
                    continue
                break  # an unfinished tag at the end is markup
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not places["p"]:
                    close_block()
                if (depth := last(tag)) and (tag in BLOCK or depth > blocks[-1]):
                    pop_to(depth)
                continue
            if tag == "br":
                add(" ")
                continue
            if tag in BLOCK:
                if stack[blocks[-1]].tag == "p":
                    pop_to(blocks[-1])
                close_block()
            if tag in _ENDS:
                same, stops = _ENDS[tag]
                if (depth := last(*same)) > last(*stops):
                    pop_to(depth)
            if tag in VOID:
                continue
            rest = m[3].strip()
            attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
            parent = stack[-1]
            own_header = tag == "header" and bool(places["article"])
            out = parent.out or not own_header and _left_out(tag, attributes, parent.inside or parent.tag in ("article", "main"))
            if tag in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                at = end.start() if end else n
                continue
            if rest.endswith("/") and tag not in BLOCK:
                continue
            node = Node(tag, _general(tag, attributes), out, parent, parent.anchor or tag == "a")
            node.start = len(pieces)
            if tag in ("td", "th"):
                add(" ")
            places[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            if tag in CONTAINER and not out:
                nodes.append(node)
        pop_to(1)
        close_block()
        self.top.end = len(pieces)
        for node in reversed(nodes):
            node.total += node.own
            node.up.total += node.total
        self.top.total += self.top.own

    def _has_own(self, node: Node) -> bool:
        """Whether text right in a container keeps it from being left for a part of it; a line right in the body does not."""
        return node.heading or node.own > ((1 - NEARLY) * node.total if node.tag in ("", "body") else 0)

    def best(self) -> Node:
        """The lowest container with nearly all text, the whole page if there is none."""
        inner: dict[int, list[Node]] = {}
        for x in self.nodes:
            inner.setdefault(id(x.up), []).append(x)
        outermost = [x for x in self.nodes if x.tag in ("article", "main") and not x.inside]
        node = self.top
        if len(outermost) == 1 and 2 * outermost[0].total > self.top.total:
            # the page's only article or main
            up = outermost[0]
            while up is not self.top and not self._has_own(up := up.up):
                pass
            if not self._has_own(up):
                node = outermost[0]
        while node.tag != "article" and not self._has_own(node):
            most = max(inner.get(id(node), ()), key=lambda x: x.total, default=None)
            if most is None or most.total == 0 or most.total < NEARLY * node.total:
                break
            node = most
        return node

    def at(self, path: str) -> list[Node]:
        """All containers at a path in page order, or the one around them while it adds little but text of its own."""
        key = _path_key(path)
        found = [x for x in self.nodes if x.key == key]
        while found:
            ups = {id(x.up): x.up for x in found}
            wider = [up for up in ups.values() if up.tag not in ("", "body")]
            if len(wider) < len(ups) or not any(self._has_own(up) for up in wider) or sum(x.total for x in found) < NEARLY * sum(up.total for up in wider):
                break
            found = wider
        return found

    def text(self, node: Node) -> str:
        pieces = self.pieces[node.start : node.end]
        blocks: list[list[str]] = [[]]
        for text, out, boundary in pieces:
            if boundary:
                blocks.append([])
            if not out:
                blocks[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def extract(html: str | None, path: str | None = None) -> str:
    page = Page(html or "")
    chosen = page.at(path) if path else []
    total = sum(x.total for x in chosen)
    if not chosen or total < LEAST_SHARE * (page.top.total - total):
        chosen = [page.best()]
    return "\n".join(filter(None, map(page.text, chosen)))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path and votes of all pages' best containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(x or "").best() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.path or None for x in found], pa.string())], names=["host", "path"])

    voted = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(trimmed(run), "host string, path string")
    return voted.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, its number of votes and the path with most of them, of equals the smaller one."""
    return votes(pages).groupBy("host").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("n"), "path"))["path"].alias("path"))


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    bounded(pages.sparkSession)
    paths = cut(host_paths(pages))
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    joined = join_named(plain, paths, "host", "n", BROADCAST_ROWS).select("page_id", "url", "html", "path")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(trimmed(run), f"page_id {kind}, url string, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
