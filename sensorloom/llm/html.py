"""Main-text extraction by consensus host paths.

First pass: each page's containers are scored by the text that they hold in
paragraphs, less links, and the best ones vote for their generalised path
(tags and classes, numbers and hashes taken out).  The votes of a host are
added up in Spark.  Second pass: each page is extracted from the containers on
its host's winning path, or from its own best container where it has none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

#: A table of winning paths of at most this many hosts is broadcast; beyond it, it is joined by host.
BROADCAST_HOSTS = 100_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a start tag up to its end.  A quote opens a value only right after an equals sign, and nothing is tried twice.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(\S*+)))?+")
_LONG_REFERENCE = re.compile(r"&#(?:0*+(\d+)|[xX]0*+([0-9a-fA-F]+));?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object", "select", "button", "canvas")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CONTAINERS = set("article body div main section td".split())
#: Elements that are never part of a main text; a form may be one that holds the whole page.
_BOILER_TAGS = set("nav header footer aside script style head dialog menu fieldset noscript template textarea title svg math iframe object select button canvas".split())
_BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of classes and ids that mark what surrounds a main text.
_BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead "
    "topbar footer foot colophon sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus replies respond reply share sharing social related recommended recommendations recirc trending popular pagination pager toolbar search form copyright legal disclaimer skip".split()
)
_COMMENT_WORDS = set("comment comments commentlist disqus replies respond reply".split())
_KEEP_WORDS = set("article content main post entry story body text page wrapper".split())
#: In a class like has-sidebar or ad-free, these say that its other words tell of the page, not of what the element holds.
_ABOUT_WORDS = set("has with without no not free is show hide enabled disabled open closed allow".split())
#: How an element may be boilerplate by its name: not at all, unless it holds most of the page, or as readers' comments.
_PLAIN, _SURROUNDS, _COMMENTS = 0, 1, 2
_NUMBER = re.compile(r"[0-9a-f]*\d[0-9a-f]*$|\d+")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    """An open or closed element: its path's number, whether it is boilerplate for sure, by its name, or in a link, the
    block that it is in, and where on the stack the nearest open elements are that a start tag may close."""

    __slots__ = ("at", "tag", "path", "boiler", "named", "linked", "links", "block", "near", "inline")

    def __init__(self, at: int, tag: str, path: int, boiler: bool, linked: bool, near: tuple[int, ...]):
        self.at, self.tag, self.path, self.boiler, self.linked, self.near = at, tag, path, boiler, linked, near
        self.links = 0
        self.named = _PLAIN
        self.block = self
        self.inline: dict[str, int] | None = None  # of a block: its open inline elements


def _words(value: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(value) if w]


def _label(tag: str, attributes: str) -> tuple[str, bool, int]:
    """An element's generalised name (numbers and hashes taken out of its classes), whether it is boilerplate by itself,
    and whether it may be by the words of its class and id."""
    boiler = tag in _BOILER_TAGS
    named = _SURROUNDS if tag == "form" else _PLAIN
    if not attributes or attributes.isspace():
        return tag, boiler, named
    got: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = got.get("class", "").split()
    label = tag + "".join(f".{c}" for c in sorted({_NUMBER.sub("", x.lower()).replace(">", "") for x in names}) if c)
    for x in (*names, got.get("id", "")):
        words = set(_words(x))
        if words & _ABOUT_WORDS:
            continue
        if tag in ("main", "article"):  # readers' comments are often articles inside articles
            named = max(named, _COMMENTS if words & {"comment", "comments", "reply"} else _PLAIN)
        elif words & _BOILER_WORDS and not words & _KEEP_WORDS:
            named = max(named, _COMMENTS if words & _COMMENT_WORDS else _SURROUNDS)
    role = got.get("role", "").lower()
    if tag not in ("main", "article"):
        boiler = boiler or role in _BOILER_ROLES and role != "form"
        named = max(named, _SURROUNDS if role == "form" else _PLAIN)
    return label, boiler or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(got.get("style", ""))), named


def _unescape(text: str) -> str:
    """Decodes character references; numbers of more digits than any character has stand for none."""

    def short(m: re.Match) -> str:
        digits = m[1] or m[2]
        return m[0] if len(m[0]) < 12 else "\ufffd" if len(digits) > 7 else f"&#{digits};" if m[1] else f"&#x{digits};"

    return unescape(_LONG_REFERENCE.sub(short, text)) if "&" in text else text


#: A start tag closes the nearest open element of its group, unless an element of the scope stands between.
_SCOPE = set("article aside blockquote body button caption dd div fieldset figure footer form header html li main nav section table td th".split())
_GROUPS = [({"p"}, _SCOPE), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"})]
_GROUP_OF = {tag: k for k, (tags, _) in enumerate(_GROUPS) for tag in tags}
#: By tag: the group that it belongs to, or -1, and the groups whose open elements it hides.
_PLACES = {tag: (_GROUP_OF.get(tag, -1), tuple(k for k, (tags, scope) in enumerate(_GROUPS) if tag in scope and tag not in tags)) for tag in set().union(*(tags | scope for tags, scope in _GROUPS))}


class Page:
    """A parsed page: its blocks of text, each with the element that it is in.

    Reading takes time and memory in proportion to the page, however deep its
    elements nest and however many of its tags are never closed: each element
    knows its parent, its block and the open elements above it by number.  A
    tag that the page ends in is markup.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[_Node, str]] = []
        self.nodes: list[_Node] = []
        self.up: list[int] = []
        self.paths: dict[tuple[int, str], int] = {(-1, "body"): 0}
        self._parse(html)
        self._prune()

    def _open(self, stack: list[_Node], tag: str, attributes: str) -> _Node:
        inline = tag in _INLINE
        up = stack[-1] if stack else None
        label, boiler, named = _label(tag, attributes)
        if up is None:
            path, near = 0, (-1,) * len(_GROUPS)
        elif inline:
            path, near = up.path, up.near
            boiler = up.boiler or (boiler or named > _PLAIN) and tag != "a"
        else:
            path = self.paths.setdefault((up.path, label), len(self.paths))
            boiler = boiler or up.boiler
            near = up.near
            own, shut = _PLACES.get(tag, (-1, ()))
            if own >= 0 or any(near[k] >= 0 for k in shut):
                near = tuple(len(stack) if k == own else -1 if k in shut else old for k, old in enumerate(near))
        node = _Node(len(self.nodes), tag, path, boiler, tag == "a" or up is not None and up.linked, near)
        if not inline:
            node.named = named
        if inline and up is not None:
            node.block = up.block
            if node.block.inline is None:
                node.block.inline = {}
            node.block.inline[tag] = node.block.inline.get(tag, 0) + 1
        self.nodes.append(node)
        self.up.append(up.at if up is not None else -1)
        stack.append(node)
        return node

    def _parse(self, html: str) -> None:
        stack: list[_Node] = []
        self._open(stack, "body", "")  # also of a fragment
        opened: dict[str, int] = {}
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = _SPACE.sub(" ", _unescape("".join(text))).strip()
                text.clear()
                if joined:
                    self.blocks.append((stack[-1].block, joined))

        def add(piece: str) -> None:
            top = stack[-1]
            if piece and not top.boiler:
                text.append(piece)
                if top.linked:
                    top.block.links += len(piece)

        def close(k: int) -> None:
            while len(stack) > k:
                gone = stack.pop()
                opened[gone.tag] -= 1
                if gone.tag in _INLINE:
                    gone.block.inline[gone.tag] -= 1

        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                add(html[at:])
                break
            mark = html[lt + 1 : lt + 2]
            if not (mark in ("!", "?", "/") or mark.isascii() and mark.isalpha()):
                add(html[at : lt + 1])  # just a sign
                at = lt + 1
                continue
            add(html[at:lt])
            if mark in ("!", "?"):
                if html.startswith("<!--", lt):
                    stop = html.find("-->", lt + 2)
                    at = stop + 3 if stop >= 0 else end
                elif html.startswith("<![CDATA[", lt):
                    stop = html.find("]]>", lt)
                    add(html[lt + 9 : stop if stop >= 0 else end])
                    at = stop + 3 if stop >= 0 else end
                else:
                    stop = html.find(">", lt)
                    at = stop + 1 if stop >= 0 else end
                continue
            name = _NAME.match(html, lt + 1 + (mark == "/"))
            if mark == "/":
                stop = html.find(">", lt)
                at = stop + 1 if stop >= 0 else end
                if name:
                    self._end(name[0].lower(), stack, opened, text, flush, close)
                continue
            rest = _REST.match(html, name.end())
            if rest.end() >= end:
                break  # the page ends in this tag
            at = rest.end() + 1
            tag = name[0].lower()
            if tag in _VOID:
                if tag == "br":
                    text.append(" ")
                elif tag == "hr":
                    flush()
            elif tag in _RAW_END:
                stop = _RAW_END[tag].search(html, at)
                at = stop.end() if stop else end
            elif tag == "body":  # ends the head, whether that was closed or not
                if opened.get("head"):
                    flush()
                    close(next(k for k, x in enumerate(stack) if x.tag == "head"))
            elif tag != "html":
                if tag not in _INLINE:
                    flush()
                    k = stack[-1].near[_GROUP_OF.get(tag, 0)]
                    if k > 0:
                        close(k)
                self._open(stack, tag, rest[0])
                opened[tag] = opened.get(tag, 0) + 1
        if not stack[-1].boiler:
            flush()

    def _end(self, tag: str, stack: list[_Node], opened: dict[str, int], text: list[str], flush: Callable[[], None], close: Callable[[int], None]) -> None:
        if tag == "br":
            text.append(" ")
        elif tag in _INLINE:
            if (stack[-1].block.inline or {}).get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
        elif tag == "p":
            if stack[-1].near[0] > 0:
                flush()
                close(stack[-1].near[0])
        elif opened.get(tag):
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            flush()
            close(k)

    def _prune(self) -> None:
        """Drops the text of elements that are boilerplate by their names.

        A class word alone doesn't tell a sidebar from the layout around it.
        An element so named stays if it holds a `main` element or all the
        page's text that isn't links; and, unless it is named for comments, if
        it holds half of that text or more and a heading, `article` or the like.
        """
        if not any(node.named for node in self.nodes):
            return
        many = len(self.nodes)
        inside, main, heading = [0] * many, [False] * many, [False] * many
        for node, joined in self.blocks:
            inside[node.at] += len(joined)
        for node in self.nodes:
            if not node.boiler:
                inside[node.at] = max(0, inside[node.at] - node.links)
                main[node.at] = node.tag == "main"
                heading[node.at] = node.tag in ("h1", "main") or node.tag == "article" and node.named < _COMMENTS
        for at in range(many - 1, 0, -1):  # each after all that stand in it
            up = self.up[at]
            inside[up] += inside[at]
            main[up] |= main[at]
            heading[up] |= heading[at]
        gone = [False] * many
        for node in self.nodes:  # each before all that stand in it
            at, up = node.at, self.up[node.at]
            stays = node.named == _PLAIN or main[at] or 0 < inside[at] == inside[0] or node.named == _SURROUNDS and heading[at] and 2 * inside[at] >= inside[0]
            gone[at] = not stays or up >= 0 and gone[up]
        self.blocks = [(node, joined) for node, joined in self.blocks if not gone[node.at]]

    def scores(self) -> dict[int, float]:
        """By number of a container's path, the score of the text below it.

        Text counts fully for the nearest container, and fades by distance, so
        that the innermost element that holds nearly all paragraphs wins.
        """
        carry = [0.0] * len(self.nodes)
        for node, joined in self.blocks:
            size = max(0.0, len(joined) - 3.0 * node.links)
            carry[node.at] += size * 2 if node.tag in ("p", "pre", "blockquote") or len(joined) > 140 else size
        found: dict[int, float] = {}
        for node in reversed(self.nodes):  # each after all that stand in it
            share = carry[node.at]
            if share and node.tag in _CONTAINERS:
                found[node.path] = found.get(node.path, 0.0) + share * (1.3 if node.tag in ("article", "main") else 1.0)
                share *= 0.75
            if self.up[node.at] >= 0:
                carry[self.up[node.at]] += share
        return found

    def name(self, path: int) -> str:
        """A path's tags and classes, from the body."""
        if not hasattr(self, "_names"):
            self._names = {number: parent for parent, number in self.paths.items()}
        out = []
        while path >= 0:
            path, label = self._names[path]
            out.append(label)
        return ">".join(reversed(out))

    def number(self, name: str) -> int | None:
        """The number of a path in this page, if it is there."""
        at: int | None = -1
        for label in name.split(">"):
            at = self.paths.get((at, label))
            if at is None:
                return None
        return at

    def under(self, path: int | None) -> list[str]:
        if path is None:
            return []
        within = [False] * len(self.nodes)
        for node in self.nodes:  # each before all that stand in it
            within[node.at] = node.path == path or self.up[node.at] >= 0 and within[self.up[node.at]]
        return [joined for node, joined in self.blocks if within[node.at]]

    def text(self, path: str | None) -> str:
        """The blocks on a path, one per line; where there are none, those of the page's own best container, or all."""
        out = self.under(self.number(path)) if path else []
        if not out:
            own = self.scores()
            top = max(own.values(), default=0.0)
            best = max((k for k, v in own.items() if v == top), key=self.name, default=None)
            out = self.under(best) if best is not None else [joined for _, joined in self.blocks]
        return "\n".join(out)


VOTE = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("votes", T.DoubleType())])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page has one vote to share out over its containers, by their scores next to the best one's; a task's pages
    of a host are added up before they leave it."""
    tally: dict[tuple[str, str], float] = {}

    def out() -> pa.RecordBatch:
        got = sorted(tally.items())
        return pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k, _ in got], pa.string()), "path": pa.array([k[1] for k, _ in got], pa.string()), "votes": pa.array([v for _, v in got], pa.float64())})

    for batch in common.rows(batches, "html"):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            own = page.scores()
            top = max(own.values(), default=0.0)
            if top <= 0:
                continue
            for path, score in own.items():
                if score >= 0.5 * top:
                    key = (host, page.name(path))
                    tally[key] = tally.get(key, 0.0) + round((score / top) ** 4, 6)
        if len(tally) > 50_000:
            yield out()
            tally = {}
    if tally:
        yield out()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "html"):
        texts = [Page(html or "").text(path) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


TEXT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def host_of(url):
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; ties go to the later path by text.  Pages without a host are one host."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, VOTE)
    added = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 3).alias("votes"))
    return added.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars (its code points).

    A null page is empty; rows that repeat an id are extracted each; an empty
    table gives no rows; other columns are not read.
    """
    paths = common.cut(winning_paths(pages), "paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_extract, TEXT)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts the main text of all pages."""
    return extract(common.table(spark, sf_dir, "pages"))
