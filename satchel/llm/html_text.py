"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same path of tags and classes form one style
node.  A presentation node's importance is the entropy of the child sequences that pages show
there, a content node's the entropy of its texts, both relative to the most they could be; what
looks and reads alike on every page carries nothing.  Equal pages of a host count once.  Where a
host has few pages its tree is mixed with the tree of all hosts, and that with full importance,
each with the weight of ``SMOOTH`` pages.  From each page the branches of low importance go, as do elements whose tag, role or class says that
they are menus, adverts, notices, forms, comments and the like.  Inside the article only plain
words of classes, or a whole id, say so.  Text that stands directly in an element marked as the article
is not judged by repetition.  Text outside goes where such elements hold at least half of what the
page has left; otherwise (cards beside an article in plain elements) the marks decide nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.textops import slices
from satchel.plans.staging import BROADCAST_BYTES, stage

LEAST_IMPORTANCE = 0.2  #: style nodes under it are noise
SMOOTH = 4.0  #: pages that the tree of all hosts counts for in a host's tree, and full importance in that
FADE = 0.9  #: weight of a node's content against its presentation

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag ends open elements of these kinds, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "blockquote", "td", "th", "nav", "aside", "header", "footer", "form"}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "audio", "video", "canvas", "fieldset"} | RAW
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
DROPPED_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "paywall",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "toolbar", "footer", "foot", "bottom", "copyright", "legal", "disclaimer", "sidebar", "aside", "widget", "widgets", "rail", "related", "recommended", "recommendations", "trending", "popular", "share", "sharing", "social", "follow",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "login", "signin", "signup", "register", "search", "pagination", "pager", "hidden",
}
#: Words that an article's own parts are named by as well: they drop nothing inside the article.
AMBIGUOUS_WORDS = {
    "notice", "notices", "notification", "alert", "header", "masthead", "foot", "bottom", "copyright", "legal", "disclaimer", "rail", "related", "recommended", "recommendations", "trending", "popular", "share", "sharing", "social", "follow",
    "cookie", "cookies", "consent", "menu", "navigation", "promotion", "subscription", "reply", "replies", "respond", "login", "register", "search", "hidden",
}


class Block:
    """A block's text pieces, the style path on which it stands, and whether it is in an article
    (``main``) and directly in its root element."""

    __slots__ = ("parts", "path", "dropped", "main", "root", "words")

    def __init__(self, path: str, dropped: bool, main: bool, root: bool = False) -> None:
        self.parts, self.path, self.dropped, self.main, self.root, self.words = [], path, dropped, main, root, ""


def judge(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool, str]:
    """Whether an element is dropped, whether it is the article, and its name in a path."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    name = " ".join(sorted(found.get("class", "").split()))
    words = {w.lower() for w in PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    role = found.get("role", "").lower()
    drop = tag in DROPPED_TAGS or role in DROPPED_ROLES or (tag == "header" and not inside_main)
    drop = drop or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if inside_main:  # of ids only whole ones, since headings have slugs of their text
        named = ({w.lower() for w in PART.findall(found.get("class", ""))} | {found.get("id", "").lower()}) & DROPPED_WORDS - AMBIGUOUS_WORDS
    else:
        named = words & DROPPED_WORDS
    drop = drop or bool(named and not (tag in ("article", "main", "body", "html") and not words & {"comment", "comments"}))
    main = not drop and (tag in ("article", "main") or role in ("main", "article") or (tag in ("div", "section") and bool(words & {"article", "entry", "story"})))
    return drop, main, f"{tag}.{name}" if name else tag


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """The blocks of a page and the child sequence of each path: the page's style tree."""
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]  # tag, path, dropped, in an article: 1 its root, 2 below
    current: Block | None = None
    at, n = 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if text.isspace():
                return
            owner = next(x for x in reversed(stack) if x[0] not in INLINE)
            current = Block(owner[1], stack[-1][2], owner[3] > 0, owner[3] == 1)
            blocks.append(current)
            children.setdefault(owner[1], []).append("#")
        current.parts.append(text)

    def close(kinds: set[str], fence: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in kinds:
                del stack[k:]
                return
            if stack[k][0] in fence:
                return

    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        slash, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            current = None
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if not attributes.endswith("/") else None
            if end:
                at = end.end()
            elif not attributes.endswith("/"):
                at = n
            continue
        if attributes.endswith("/") and tag not in INLINE and tag not in HOLDS:
            continue
        if tag not in INLINE:
            close({"p"}, HOLDS)
            if tag in ENDS:
                close(ENDS[tag], {"ul", "ol", "dl", "table", "select"} - ENDS[tag])
        _, path, dropped, main = stack[-1]
        drop, is_main, name = judge(tag, attributes, main > 0)
        if tag not in INLINE:
            children.setdefault(path, []).append(name)
        stack.append((tag, path if tag in INLINE else f"{path}>{name}", dropped or drop, 1 if is_main else 2 if main else 0))
    for block in blocks:
        block.words = " ".join(entities.unescape("".join(block.parts)).split())
    return [b for b in blocks if b.words], children


def hashed(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, object), categorize=False).view(np.int64) if values else np.zeros(0, np.int64)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each style node and page: its texts (kind 0), and its child sequence (kind 1)."""
    for batch in slices(batches, "html"):
        hosts, paths, kinds, values, pages = [], [], [], [], []
        for host, page, digest in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "digest")), strict=True):
            blocks, children = parse(page or "")
            texts: dict[str, list[str]] = {}
            for b in blocks:
                texts.setdefault(b.path, []).append(b.words)
            for path, own in texts.items():
                for kind, value in ((0, "\n".join(own)), (1, " ".join(children[path]))):
                    hosts.append(host), paths.append(path), kinds.append(kind), values.append(value), pages.append(digest)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashed(paths)), pa.array(kinds, pa.int32()), pa.array(hashed(values)), pa.array(pages, pa.int64())], ["host", "path", "kind", "value", "page"])


HOST = r"^[a-zA-Z][-+.a-zA-Z0-9]*://([^/?#]*)"


def host() -> Column:
    """The host of the url column; "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, n, importance): path is a hash of a style path, n the different pages of the
    host that have text there."""
    keyed = pages.select(host().alias("host"), "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("digest"))
    seen = keyed.mapInArrow(_observe, "host string, path long, kind int, value long, page long").distinct()
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    counts = stage(counts, "observed")
    n, h = F.sum("c"), F.sum(F.col("c") * F.log("c"))
    weight = F.when(F.col("kind") == 0, FADE).otherwise(1 - FADE)

    def tree(counts: DataFrame, *keys: str) -> DataFrame:
        level = counts.groupBy(*keys, "kind").agg(n.alias("n"), ((F.log(n) - h / n) / F.log(F.greatest(n, F.lit(2)))).alias("entropy"))
        return level.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(weight * F.col("entropy")).alias("own"))

    every = tree(counts.groupBy("path", "kind", "value").agg(F.sum("c").alias("c")), "path")
    mixed = lambda own, other: (F.col("n") * F.col(own) + SMOOTH * other) / (F.col("n") + SMOOTH)
    every = every.select("path", mixed("own", F.lit(1.0)).alias("common"))
    return tree(counts, "host", "path").join(every, "path").select("host", "path", "n", mixed("own", F.col("common")).alias("importance"))


def noise(pages: DataFrame) -> DataFrame:
    """Staged (host, noise): hashes of the style paths of a host that carry too little."""
    low = importances(pages).where(F.col("importance") < LEAST_IMPORTANCE)
    return stage(low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("noise")), "noise")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url and text, blocks joined by \\n.

    Null and empty html give an empty text; a null or odd url has the host "".  Unclosed and
    stray tags are tolerated, and so are very long and very deep pages.  Repeated rows are
    extracted alike, an empty table gives no rows, and other columns are ignored.
    """
    low = noise(pages)
    n, paths = low.agg(F.count("*"), F.sum(F.size("noise"))).first()
    if 8 * (paths or 0) + 128 * n <= BROADCAST_BYTES:
        low = F.broadcast(low)
    keyed = pages.select("page_id", "url", "html", host().alias("host")).join(low, "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for page, noisy in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist(), strict=True):
                blocks = [b for b in parse(page or "")[0] if not b.dropped]
                if noisy and blocks:
                    bad = set(noisy)
                    blocks = [b for b, path in zip(blocks, hashed([b.path for b in blocks]).tolist(), strict=True) if b.root or path not in bad]
                inside = sum(len(b.words) for b in blocks if b.main)
                if inside and 2 * inside >= sum(len(b.words) for b in blocks):
                    blocks = [b for b in blocks if b.main]
                out.append("\n".join(b.words for b in blocks))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return keyed.select("page_id", "url", "html", "noise").mapInArrow(work, f"page_id {kind}, url string, text string")
