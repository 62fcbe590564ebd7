"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element is known by the path of its names (tag and classes)
from the root. Its presentation importance is the entropy of the layouts of its children over the host's pages. Its
content importance is one minus the mean entropy with which its texts spread over pages, lowered where pages fill it
alike: a place that every page fills with a few words of its own (a menu, a notice, an advert) is a template even if the
words are ever new, a place filled now with a line and now with a chapter is content. What HTML or a class, id or role
declares (navigation, footers, forms, adverts, comments and the like, or an article) is no verdict but weighs the
importance of what lies below it, and stands in for it as far as a host has too few pages to tell. A branch of which
neither the root nor anything below reaches a threshold is cut from each page.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Importance below which a branch is cut, pages that an element's declaration weighs as much as, share of the presentation for each layout.
THRESHOLD, SMOOTHING, DAMPING = 0.2, 2.0, 0.9
#: Content importance of ever-new texts that fill a place alike, and kinds of fillings from which a place is as varied as can be.
ALIKE, FILLINGS = 0.5, 16
#: Cut branches (16 bytes each) that are broadcast; with more, pages are joined to their host's list.
BROADCAST_BRANCHES = 500_000

#: What the nearest declaration above a text says: no article by tag or role, no article by a name, beside a declared article, nothing, an article.
BY_TAG, BY_NAME, BESIDE, PLAIN, ARTICLE = range(5)
#: Importance that a declaration stands for, and its weight.
ASSUMED, WEIGHT = (0.0, 0.0, 0.0, 0.6, 1.0), (0.3, 0.3, 0.3, 1.0, 3.0)

#: A comment, a declaration, or a tag; quotes only enclose values.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=>/"'][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
NAME_PART = re.compile(r"[a-z]+")
#: Elements without an end, elements whose text is no markup, elements that don't end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may stand within a block without ending it.
PHRASING = INLINE | frozenset("script style template noscript iframe button select option textarea svg canvas object embed audio video".split())
#: Elements whose content is no text of the page.
NO_TEXT = RAW | frozenset("head button select option input svg canvas object embed audio video".split())
#: Elements and roles that declare no article; a form may hold a whole page, so it counts as a name.
OTHER_TAGS = frozenset("nav footer aside dialog menu".split())
OTHER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class, id or label that say the same, unless the name begins or ends with one of the others.
OTHER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal overlay sidebar menu navbar nav navigation breadcrumb breadcrumbs footer comment comments disqus replies share sharing social related recommended newsletter subscribe subscription signup login search toolbar pagination widget complementary contentinfo".split())
NEUTRAL_FIRST, NEUTRAL_LAST = frozenset("with without has no".split()), frozenset("wrapper layout results page body".split())
#: What makes an article element none: reader comments are often marked up as articles.
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
MAIN_WORDS = frozenset(("main", "article"))
#: A start tag closes an open element of these kinds, looked for up to the nearest of the second kinds.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


def child_path(parent: int, name: str) -> int:
    """Path hash of a named child."""
    return xxhash.xxh64_intdigest(name, seed=parent & ((1 << 64) - 1)) - (1 << 63)


class Element:
    """An open element: tag, path, whether it holds no text, its declaration, the nearest element that is a block, names of its children."""

    __slots__ = ("block", "children", "hint", "mute", "path", "tag")

    def __init__(self, tag: str, path: int, mute: bool, hint: int, block: Element | None) -> None:
        self.tag, self.path, self.mute, self.hint, self.block, self.children = tag, path, mute, hint, block or self, []


def names_other(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id has one of the words."""
    parts = NAME_PART.findall(name)
    return not words.isdisjoint(parts) and parts[0] not in NEUTRAL_FIRST and parts[-1] not in NEUTRAL_LAST


def declared(tag: str, attributes: str, above: int) -> tuple[str, int]:
    """(classes for the path, what the element declares, or else what was declared above it)."""
    given: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        given.setdefault(name.lower(), "".join(values).lower())
    classes = ".".join(NAME_PART.findall(given.get("class", "")))
    names = [*given.get("class", "").split(), *given.get("id", "").split(), given.get("aria-label", "").replace(" ", "-")]
    role = given.get("role", "").strip()
    if tag in MAIN_WORDS or role in MAIN_WORDS or given.get("itemprop") == "articlebody":
        return classes, BY_NAME if any(names_other(n, COMMENT_WORDS) for n in names) else ARTICLE
    if tag in ("html", "body"):
        return classes, above
    if tag in OTHER_TAGS or role in OTHER_ROLES or (tag == "header" and above != ARTICLE):
        return classes, BY_TAG
    if tag == "form" or "hidden" in given or any(names_other(n, OTHER_WORDS) for n in names):
        return classes, min(above, BY_NAME)
    return classes, above


class Page:
    """The blocks of a page, each with its element's path and declaration, and the layouts of its elements; linear in the page."""

    def __init__(self, html: str | None) -> None:
        self.blocks: list[tuple[str, int, int]] = []
        self.layouts: list[tuple[int, int, int]] = []
        self.parents: dict[int, int] = {}
        self.pieces: list[str] = []
        self.stack = [Element("", 0, False, PLAIN, None)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.parse(html or "")
        self.has_article = any(hint == ARTICLE for _, _, hint in self.blocks)
        if self.has_article:
            self.blocks = [(t, p, BESIDE if h == PLAIN else h) for t, p, h in self.blocks]

    def flush(self) -> None:
        """End a block of text."""
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                block = self.stack[-1].block
                self.blocks.append((text, block.path, block.hint))
            self.pieces.clear()

    def close(self) -> None:
        """Pop the innermost element and note the layout of its children."""
        e = self.stack.pop()
        self.places[e.tag].pop()
        if not e.mute and e.tag not in INLINE:
            names = [n for i, n in enumerate(e.children) if i == 0 or n != e.children[i - 1]]
            self.layouts.append((e.path, xxhash.xxh64_intdigest(" ".join(names)) - (1 << 63), e.hint))

    def close_to(self, depth: int) -> None:
        """Close all elements from a depth on."""
        while len(self.stack) > depth:
            self.close()

    def end(self, tag: str) -> None:
        """An end tag closes up to its element, if that is open."""
        if at := self.places.get(tag):
            self.close_to(at[-1])

    def innermost(self, tags: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these kinds, 0 if none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def start(self, tag: str, attributes: str) -> None:
        """Open an element."""
        stack = self.stack
        if tag not in PHRASING and tag not in VOID:
            if tag not in RAW:
                self.end("head")
            if self.innermost(("p",)) >= max(1, len(stack) - 4):
                self.end("p")
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            if (depth := self.innermost(closed)) > self.innermost(stop):
                self.close_to(depth)
        parent = stack[-1]
        classes, hint = declared(tag, attributes, parent.hint)
        name = f"{tag}.{classes}" if classes else tag
        if tag not in INLINE:
            parent.children.append(name)
        if tag in VOID:
            return
        mute = parent.mute or tag in NO_TEXT
        path = parent.path if tag in INLINE else child_path(parent.path, name)
        if tag not in INLINE and not mute:
            self.parents[path] = parent.path
        self.places[tag].append(len(stack))
        stack.append(Element(tag, path, mute, hint, parent.block if tag in PHRASING and len(stack) > 1 else None))

    def parse(self, html: str) -> None:
        """Read the whole page."""
        at, end, last = 0, len(html), html.rfind(">")
        while at < end:
            m = TOKEN.search(html, at) if at <= last else None
            text = html[at : m.start()] if m else html[at:]
            if text and not self.stack[-1].mute:
                self.pieces.append(text)
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag == "br":
                self.pieces.append(" ")
                continue
            if tag not in PHRASING and (tag not in VOID or tag == "hr"):
                self.flush()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:  # its text ends at its own end tag only
                stop = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(html, at)
                at = stop.start() if stop else end
            elif m[3].endswith("/") and tag not in VOID and self.places["svg"]:
                self.close()
        self.flush()
        self.close_to(1)

    def text(self, low: frozenset[int] | set[int] | None = None) -> str:
        """The blocks outside the branches in ``low``; without a tree, those that nothing declares to be no article.

        If no block is left of a page without a declared article, names were misleading: those cut by name are kept.
        """
        kept = [b for b in self.blocks if (b[2] >= PLAIN if low is None else b[1] not in low)]
        if not kept and not self.has_article:
            kept = [b for b in self.blocks if b[2] == BY_NAME]
        return "\n\n".join(b[0] for b in kept)

    def features(self) -> set[tuple[int, int, int, int, int]]:
        """(path, parent, kind, feature, declaration): the layouts of elements (0), their texts (1), and how much text fills each (2), in octaves of characters."""
        found = {(p, self.parents[p], 0, f, BESIDE if self.has_article and h == PLAIN else h) for p, f, h in self.layouts if p in self.parents}
        size: dict[tuple[int, int], int] = defaultdict(int)
        for text, path, hint in self.blocks:
            if path in self.parents:
                found.add((path, self.parents[path], 1, xxhash.xxh64_intdigest(text) - (1 << 63), hint))
                size[path, hint] += len(text)
        return found | {(p, self.parents[p], 2, n.bit_length(), h) for (p, h), n in size.items()}


def host_of(url: str | None) -> str | None:
    """Lower-case host of a URL, None if there is none."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, parent, kind, feature, n, hint): pages of the host on which an element has a feature, summed by task, and its most favourable declaration."""
    names = ["host", "path", "parent", "kind", "feature", "hint", "n"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        found: dict[tuple, int] = defaultdict(int)

        def out():
            columns = list(zip(*((*k, n) for k, n in found.items()), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for piece in slices(batches):
            for url, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                host = host_of(url)
                if host is None or not html:
                    continue
                for k in Page(html).features():
                    found[host, *k] += 1
                if len(found) > 200_000:
                    yield out()
                    found.clear()
        yield out()

    counted = pages.select("url", "html").mapInArrow(run, "host string, path bigint, parent bigint, kind int, feature bigint, hint int, n bigint")
    return counted.groupBy(*names[:5]).agg(F.sum("n").alias("n"), F.max("hint").alias("hint"))


def importance(m: int, layouts: int, layout: float, spread: float, filling: float, hint: int) -> float:
    """Weighted importance of an element.

    m: pages on which it has text of its own (0: it is presentation only); layouts: its kinds of layouts; layout and
    filling: entropies (in nats) of its layouts and fillings; spread: mean logarithm of the pages with each text.
    """
    share = DAMPING ** max(1, layouts)
    varied = lambda h, n: min(1.0, h / math.log(min(n, FILLINGS))) if n > 1 else 0.0
    shown = (1 - share) * varied(layout, FILLINGS)
    if not m:
        return WEIGHT[hint] * shown
    content = max(0.0, 1 - spread / math.log(m)) * (ALIKE + (1 - ALIKE) * varied(filling, m)) if m > 1 else ASSUMED[hint]
    return WEIGHT[hint] * (m * (shown + share * content) + SMOOTHING * ASSUMED[hint]) / (m + SMOOTHING)


def low_branches(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, path) of the elements with text that are cut: neither they nor anything below reaches ``threshold``.

    An element's statistics are summed by Spark, so a host's task gets a row for each path, however many pages it has.
    """
    kinds = {"layout": 0, "text": 1, "filling": 2}
    only = lambda kind, x: F.when(F.col("kind") == kinds[kind], x)
    sums = [f(only(kind, x)).alias(f"{kind}_{name}") for kind in kinds for name, f, x in (("n", F.sum, F.col("n")), ("k", F.count, F.lit(1)), ("nlogn", F.sum, F.col("n") * F.log("n")), ("spread", F.avg, F.log("n")))]
    node = counts.groupBy("host", "path", "parent").agg(F.max("hint").alias("hint"), *sums)
    entropy = lambda kind: F.coalesce(F.log(f"{kind}_n") - F.col(f"{kind}_nlogn") / F.col(f"{kind}_n"), F.lit(0.0)).alias(kind)
    node = node.select("host", "path", "parent", "hint", F.coalesce("filling_n", F.lit(0)).alias("m"), F.col("layout_k").alias("k"), entropy("layout"), entropy("filling"), F.coalesce("text_spread", F.lit(0.0)).alias("spread"))

    def host_tree(table: pa.Table) -> pa.Table:
        rows = {r["path"]: r for r in table.to_pylist()}
        children: dict[int, list[int]] = defaultdict(list)
        for r in rows.values():
            children[r["parent"]].append(r["path"])
        order, todo = [], [p for p, r in rows.items() if r["parent"] not in rows]
        while todo:
            order.append(p := todo.pop())
            todo += children[p]
        value: dict[int, float] = {}
        for p in reversed(order):
            r = rows[p]
            value[p] = max(importance(r["m"], r["k"], r["layout"], r["spread"], r["filling"], r["hint"]), *(value[c] for c in children[p]), 0.0)
        low = [p for p in order if rows[p]["m"] and value[p] < threshold]
        return pa.table([pa.array([table.column("host")[0].as_py()] * len(low), pa.string()), pa.array(low, pa.int64())], names=["host", "path"])

    return node.groupBy("host").applyInArrow(host_tree, "host string, path bigint")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, broadcast_branches: int = BROADCAST_BRANCHES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null or empty page has an empty text; a page without a host (also with a null URL) is cut by what its own markup
    declares; markup may be broken and nested anywhere; nothing is shortened. Repeated rows give repeated results; an
    empty table gives no rows; other columns are never read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    low = materialize(low_branches(style_counts(rows), threshold))
    schema = "page_id bigint, url string, text string, n_chars bigint"
    names = ["page_id", "url", "text", "n_chars"]

    def result(piece, texts):
        return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    def text(url, html, paths):
        return Page(html).text(None if host_of(url) is None else paths)

    if low.count() <= broadcast_branches:
        by_host: dict[str, set[int]] = defaultdict(set)
        for r in low.collect():
            by_host[r[0]].add(r[1])
        cut = spark.sparkContext.broadcast(dict(by_host))

        def run(batches):
            for piece in slices(batches):
                yield result(piece, [text(u, h, cut.value.get(host_of(u), frozenset())) for u, h in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True)])

        return rows.mapInArrow(run, schema)

    # written, so that the rows of a host of many pages can be split in the join
    lists = materialize(low.groupBy("host").agg(F.collect_list("path").alias("paths")))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    wide = rows.withColumn("host", host).join(lists, "host", "left").select("page_id", "url", "html", "paths")

    def run_joined(batches):
        for piece in slices(batches):
            yield result(piece, [text(u, h, set(p or ())) for u, h, p in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)])

    return wide.mapInArrow(run_joined, schema)
