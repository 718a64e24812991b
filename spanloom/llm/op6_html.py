"""Operator 6, main-text extraction with consensus paths per host.

A page is read into elements and text blocks.  Containers are scored by the text they hold, less what they hold of
links and of parts that are boilerplate by tag or by class; each page votes for the generalised tag-class path of its best
container (digits in classes and ids become ``#``).  Spark counts the votes per host and joins them to the paths that each
page has text on.  Each page is then read again: the text of all elements on its most voted path is taken; a page without
any voted path uses its own best container.

A page's only ``main``, or the only ``article`` in it, is its best container, whatever else the page holds.  Otherwise plain
containers come first.  One named like a layout part (``widget``, ``overlay``) counts only if it holds more than ten times
the text of any plain one, one named like other content (``related``, ``share``) only if nothing else holds text, and one
named as comments, adverts or menus never.

Inside the chosen container, parts that are boilerplate by tag or role, or containers by class word, are left out, and so
is text named as an advert.  Anything less sure is in doubt: a single text element or an inline one in running text with
another such name, and a header inside the article.  What is in doubt is left out only if the host shows it to be a
fixture: if at most half of the texts that its pages have on that path are different.

Blocks are decoded (character references), white space inside a block becomes one space, blocks are joined by a space.
Inline elements never end a block.

Cases: a null or empty page and one without text give the empty string.  A page cut off in a tag loses that tag only;
elements left open end with the page.  A page of any length is read whole.  A null or malformed URL votes under the empty
host.  Repeated rows vote each; ties between paths go to the smaller one, between containers to the deeper one.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_of, materialize, pieces

#: End mark, name and attributes of a tag; a tag cut off by the end of the page counts as one.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""")
#: What holds no text, whichever begins first; a tag as such, as its attributes may hold the like.
_SKIPPED = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1(?=[\s/>]|\Z)[^>]*(?:>|\Z)|\Z)|(?P<tag></?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>)""", re.S | re.I)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CONTAINERS = frozenset("article body center content div main section table tbody td".split())
_BOILER_TAGS = frozenset("nav footer aside form button select menu dialog svg head object audio video canvas".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
#: Class and id words of adverts and the like, which are never the article, not even single words of it.
_ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement adsense consent cookie cookies disqus gdpr newsletter popup promo promotion promoted sponsor sponsored".split())
#: Those of parts that are not the article; an inline element or a paragraph named so may be.
_SURE_WORDS = _ADVERT_WORDS | frozenset("banner breadcrumb breadcrumbs comment commentlist comments menu menus nav navbar navigation pagination sidebar sidenav".split())
#: Layout parts that may be around an article.
_LAYOUT_WORDS = frozenset("dialog form header masthead modal overlay widget widgets".split())
_BOILER_WORDS = _SURE_WORDS | _LAYOUT_WORDS | frozenset("disclaimer discussion footer login notice notices notification pager reactions recommended related replies respond search share sharing signup skip social subscribe toolbar topbar".split())
#: Class words of an article's own parts: a header named so is the article's.
_ARTICLE_WORDS = frozenset("article content entry main post story".split())
#: Whole classes of articles that are not the page's own.
_OTHER_ARTICLES = frozenset("ad advert advertisement comment comments promo recommended related reply sponsored".split())
#: Elements that hold one text each, and those among them that are running text.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption address summary".split())
_RUNNING = _TEXTS - frozenset("li dd dt td th".split())
_WORD = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
#: Elements that a start tag of the key ends when open in the same parent.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table select article section div body".split())
#: Marks the path of what is in doubt.
DOUBT = "?"


class Page:
    """Elements but inline ones (parents before children), and text blocks of one page.

    ``boiler``: 0 for none; by class words ``LAYOUT``, ``OTHER`` or ``SURE``; ``FIXED`` by tag or role.  ``doubt``: whether an
    element is one that its host decides about.  ``parts``: blocks with inline text in doubt, as texts and their labels.
    """

    LAYOUT, OTHER, SURE, FIXED = 1, 2, 3, 4

    def __init__(self, source: str):
        self.tag, self.parent, self.label, self.boiler, self.doubt = ["html"], [-1], ["html"], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it inside links
        self.parts: dict[int, list[tuple[str, str]]] = {}
        self._stack = [0]
        self._read(source)
        self._weigh()

    @staticmethod
    def _names(attributes: str) -> tuple[set[str], str, str]:
        """Class and id words, role, and the generalised class or id."""
        names = {k.lower(): v.strip("\"'") for k, v in _NAMES.findall(attributes)}
        words = {w.lower() for k in ("class", "id") for x in _WORD.findall(names.get(k, "")) for w in (*_CAMEL.split(x), x)}
        classes = ".".join(sorted({_DIGITS.sub("#", c.lower()) for c in names.get("class", "").split()}))
        return words, names.get("role", "").lower(), "." + classes if classes else "#" + _DIGITS.sub("#", names["id"].lower()) if names.get("id") else ""

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if ends := _CLOSES.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in ends:
                    del stack[k:]
                    break
                if self.tag[stack[k]] in _SCOPES:
                    break
        inside = any(self.tag[n] in ("article", "main") for n in stack)
        own = self.FIXED if tag in _BOILER_TAGS or tag == "header" and not inside else 0
        label, doubt = tag, False
        if attributes:
            words, role, name = self._names(attributes)
            label += name
            met = words & _BOILER_WORDS
            if tag in ("body", "article", "main"):
                own = self.SURE if tag == "article" and not _OTHER_ARTICLES.isdisjoint(name[1:].split(".")) else 0
            elif role in _BOILER_ROLES and not (tag == "header" and inside):
                own = self.FIXED
            elif met and not own:
                if tag in _RUNNING:
                    doubt = not met & (_ADVERT_WORDS if inside else _SURE_WORDS)
                elif tag in _TEXTS:
                    doubt = not met & _SURE_WORDS
                else:
                    doubt = met == {"header"} and (inside or bool(words & _ARTICLE_WORDS))
                own = 0 if doubt else self.SURE if met & _SURE_WORDS else self.LAYOUT if met <= _LAYOUT_WORDS else self.OTHER
        self.parent.append(stack[-1])
        stack.append(len(self.tag))
        self.tag.append(tag)
        self.label.append(label)
        self.boiler.append(own)
        self.doubt.append(doubt)

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == tag:
                del self._stack[k:]
                return

    def _read(self, source: str) -> None:
        parts = _TAG.split(_SKIPPED.sub(lambda m: m["tag"] or "", source))
        stack, tags, held, link, linked = self._stack, self.tag, [], False, 0
        left_out: list[str] = []  # open inline elements from one named as an advert on
        named: list[str] = []  # the same from one in doubt on, whose label is kept
        label = ""
        parts += ["/", "html", ""]
        for k in range(0, len(parts) - 3, 4):
            text, end, tag, attributes = parts[k : k + 4]
            if text and not left_out:
                if "&" in text:
                    text = entities.unescape(text)
                held.append((text, label))
                if link:
                    linked += len(text)
            if not tag:
                continue
            tag = tag.lower()
            if tag in _INLINE:
                if tag == "a":
                    link = not end
                if end:
                    for names in (left_out, named):
                        if tag in names:
                            while names.pop() != tag:
                                pass
                    label = label if named else ""
                elif tag not in _VOID:
                    words, role, name = self._names(attributes) if attributes else ((), "", "")
                    if left_out or role in _BOILER_ROLES or not _ADVERT_WORDS.isdisjoint(words):
                        left_out.append(tag)
                    if named or not _BOILER_WORDS.isdisjoint(words):
                        label = label or tag + name
                        named.append(tag)
                continue
            left_out.clear()
            named.clear()
            label = ""
            if held:
                self._flush(held, linked)
                held, linked = [], 0
            if tags[stack[-1]] == "p":
                stack.pop()
            if end:
                link = False
                if tags[stack[-1]] != tag:
                    self._close(tag)
                elif len(stack) > 1:
                    stack.pop()
            elif tag not in _VOID and tag != "html" and not (tag == "body" and "body" in tags):
                self._open(tag, attributes)

    def _flush(self, held: list[tuple[str, str]], linked: int) -> None:
        """A block; text in doubt with nothing beside it is no running text and is left out."""
        if any(label for _, label in held):
            if not any(text.strip() for text, label in held if not label):
                return
            self.parts[len(self.blocks)] = held
        text = " ".join("".join(text for text, _ in held).split())
        if text:
            self.blocks.append((self._stack[-1], text, min(linked, len(text))))

    def path(self, node: int) -> str:
        parts = []
        while node > 0:
            parts.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(parts)) or "html"

    def _weigh(self) -> None:
        """``good``: characters of an element outside links and boilerplate; ``bad``: the others."""
        good, bad = [0.0] * len(self.tag), [0.0] * len(self.tag)
        for node, text, linked in self.blocks:
            good[node] += len(text) - linked
            bad[node] += linked
        for node in range(len(self.tag) - 1, 0, -1):
            up = self.parent[node]
            if self.boiler[node]:
                bad[up] += good[node] + bad[node]
            else:
                good[up] += good[node]
                bad[up] += bad[node]
        self.good, self.bad = good, bad

    def containers(self) -> list[int]:
        """Elements that may be the main one: plain ones, and those named as layout or other parts where these hold too little."""
        open_below, found = [True] * len(self.tag), {0: [], self.LAYOUT: [], self.OTHER: []}
        for node, tag in enumerate(self.tag):
            free = node == 0 or open_below[self.parent[node]]
            open_below[node] = free and not self.boiler[node]
            if free and self.boiler[node] in found and (tag in _CONTAINERS or node == 0):
                found[self.boiler[node]].append(node)
        most = max(self.good[n] for n in found[0])
        out = found[0] + [n for n in found[self.LAYOUT] if self.good[n] > 10 * most]
        if not any(self.good[n] for n in out):
            out += found[self.OTHER]
        return sorted(out)

    def best(self) -> int | None:
        """The only main or article, else the container with the highest score, the deepest among equals; None without text."""
        held = [n for n in self.containers() if self.good[n]]
        most = max((self.good[n] for n in held), default=0)
        own = None
        for tag in ("main", "article"):
            named = [n for n in held if self.tag[n] == tag]
            if len(named) == 1 and self.good[named[0]] >= (most / 100 if own is None else self.good[own] / 5):
                own = named[0]
        if own is not None:
            return own
        top, found = 0.0, None
        for node in held:
            score = (self.good[node] - 0.5 * self.bad[node]) * (1.25 if self.tag[node] in ("article", "main") else 1.0)
            if found is None or score >= top:
                top, found = score, node
        return found

    def text_of(self, roots: set[int], drop: frozenset[str] = frozenset()) -> str:
        """The text inside ``roots`` but for boilerplate and what is in doubt on the paths of ``drop``."""
        inside = [0 in roots] + [False] * (len(self.tag) - 1)
        for node in range(1, len(self.tag)):
            inside[node] = node in roots or inside[self.parent[node]] and not self.boiler[node] and not (self.doubt[node] and drop and self.path(node) in drop)
        texts = []
        for k, (node, text, _) in enumerate(self.blocks):
            if inside[node]:
                if drop and k in self.parts:
                    text = " ".join("".join(t for t, label in self.parts[k] if not label or f"{self.path(node)}>{label}" not in drop).split())
                texts.append(text)
        return " ".join(texts)

    def offered(self) -> list[str]:
        """The paths of containers that hold text, and those of what is in doubt, marked."""
        live = [False] * len(self.tag)
        for node, _, _ in self.blocks:
            live[node] = True
        for node in range(len(self.tag) - 1, 0, -1):
            if live[node] and not self.boiler[node]:
                live[self.parent[node]] = True
        return sorted({self.path(n) for n in self.containers() if live[n]} | {DOUBT + path for path, _ in self.doubted()})

    def doubted(self) -> set[tuple[str, str]]:
        """Paths and texts of what is in doubt."""
        over = [-1] * len(self.tag)  # the outermost element in doubt that an element is in
        for node in range(1, len(self.tag)):
            up = over[self.parent[node]]
            over[node] = up if up >= 0 else node if self.doubt[node] else -1
        held: dict[int, list[str]] = {}
        out = set()
        for k, (node, text, _) in enumerate(self.blocks):
            if over[node] >= 0:
                held.setdefault(over[node], []).append(text)
            out.update((f"{self.path(node)}>{label}", " ".join(t.split())) for t, label in self.parts.get(k, ()) if label)
        return out | {(self.path(node), " ".join(texts)) for node, texts in held.items()}

    def extract(self, paths: list[str]) -> str:
        """The text on the first of ``paths`` that the page has text on, else that of its own best container; marked paths are fixtures."""
        drop = frozenset(p.removeprefix(DOUBT) for p in paths if p.startswith(DOUBT))
        held: dict[str, set[int]] = {}
        for node in self.containers():
            held.setdefault(self.path(node), set()).add(node)
        for path in paths:
            if path in held and (text := self.text_of(held[path], drop)):
                return text
        own = self.best()
        return "" if own is None else self.text_of({own}, drop)


def host_of(url: str) -> Column:
    """Lower-case host; empty for a null or malformed URL."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))


def votes(pages: DataFrame, html: str, url: str) -> DataFrame:
    """host, path, text: the path of each page's best container; for what is in doubt also a hash of what it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            out: list[list] = [[], [], []]
            for host, x in zip(batch.column(0).to_pylist(), texts, strict=True):
                page = Page(x) if x else None
                node = page.best() if page else None
                rows = [(host, page.path(node), None)] if node is not None else []
                for row in rows + [(host, DOUBT + p, hashlib.sha256(t.encode("utf-8", "replace")).digest()) for p, t in (sorted(page.doubted()) if page else ())]:
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["host", "path", "text"])

    return pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, text binary")


def offers(pages: DataFrame) -> DataFrame:
    """host, digest, path: the paths that each page has text on.  ``pages``: host, digest, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            held = pa.array([Page(x).offered() if x else [] for x in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([ids_of(batch, "host"), ids_of(batch, "digest"), held], names=["host", "digest", "held"])

    return pages.mapInArrow(run, "host string, digest binary, held array<string>").select("host", "digest", F.explode("held").alias("path"))


def winners(found: DataFrame, offered: DataFrame) -> DataFrame:
    """host, digest, paths: the most voted of all paths that a page has, the smaller one among equals, and its fixtures."""
    counted = found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("_texts"))
    marked = F.col("path").startswith(DOUBT)
    counted = counted.where(~marked | ((F.col("n") > 1) & (2 * F.col("_texts") <= F.col("n")))).select("host", "path", "n")
    met = offered.distinct().join(counted, ["host", "path"])
    best = F.min(F.when(~marked, F.struct((-F.col("n")).alias("n"), "path")))["path"]
    return met.groupBy("host", "digest").agg(F.concat(F.when(best.isNull(), F.array().cast("array<string>")).otherwise(F.array(best)), F.collect_set(F.when(marked, F.col("path")))).alias("paths"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"), F.unhex(F.sha2(F.col(html).cast("binary"), 256)).alias("digest"))
    best = materialize(winners(votes(pages, html, url), offers(rows.select("host", "digest", "html"))), "html-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            paths = batch.column(batch.schema.get_field_index("paths")).to_pylist()
            found = [Page(x).extract(p or []) if x else "" for x, p in zip(texts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([ids_of(batch, "page_id"), ids_of(batch, "url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return rows.join(best, ["host", "digest"], "left").select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string")
