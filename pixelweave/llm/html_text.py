"""Operator 5, HTML extraction with site template removal.

Each page is read once into text blocks. A block knows the subtrees (container elements) around
it; a subtree's hash covers its tags and text. Spark counts each hash per host, in pages of distinct
article text (so copies of a page count once), and the
subtrees that recur across many pages of the host are the site's template: blocks inside them go.
Paragraphs, headings, list items and a marked article itself are no containers, so an article
that a site prints twice stays whole.

A check of what is left follows, since furniture may be new on each page: blocks in menus, page
headers, footers, sidebars, notices, adverts, forms and comments go by tag, role, class or id (by
whole names, or by a telling part of one; one around the marked article drops nothing if all of the
article would go), and where a page marks its article (``article``, ``main``), so do blocks outside
it. Within the article names count as a whole, and only those of comments, notices and adverts.

Character references are decoded, white space in a block becomes one space, blocks are joined in
page order by an empty line.

Cases: a null or blank page gives an empty text; unclosed tags, comments and scripts end where the
page does; a null url is a host of its own; repeated rows and pages of equal article text count
once; extra columns pass through, one named
as a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, column, stage, without

# fixed values: element names of HTML
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title form button select option textarea input dialog".split())
FURNITURE = frozenset("nav footer aside menu".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead pre blockquote figcaption caption article main body html".split())
SIGNS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal sidebar "
    "comment comments commentlist respond replies disqus nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related recommended widget toolbar pagination pager copyright login search "
    # whole names, since a part alone (has-sidebar, search-methods) says little
    "site-nav main-nav nav-menu nav-bar main-menu site-menu site-footer page-footer main-footer cookie-banner cookie-notice cookie-consent cookie-bar ad-slot ad-banner ad-container ad-wrapper "
    "social-share share-buttons social-links related-posts related-articles comment-list comments-area side-bar site-sidebar newsletter-signup".split()
)
HEADERS = frozenset("header site-header page-header".split())
#: Names that tell furniture within an article: comments, notices and adverts. Others (search, related) may be part of its text.
INSIDE = frozenset(
    "comments commentlist comment-list comments-area comments-section comment-section post-comments respond disqus disqus-thread notice notices cookie-notice cookie-banner cookie-consent cookie-bar "
    "ad ads adsense advert adverts advertisement advertising ad-slot ad-banner ad-container ad-wrapper sponsor sponsored newsletter-signup".split()
)
#: Parts of a hyphened name that tell furniture outside an article, unless others of its parts speak of the page's layout.
STRONG = frozenset("comment comments nav navbar navigation menu sidebar footer masthead advert adverts advertisement ads banner cookie cookies newsletter breadcrumb breadcrumbs pagination disqus sponsor sponsored".split())
LAYOUT = frozenset("has no with without is allow show hide wrap wrapper content body layout enabled disabled open closed left-of right-of page main container row grid col article post entry text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# end of fixed values

# a tag's attributes as HTML parts them: a quote opens a value only after an equals sign, and an unquoted value may hold quotes
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
TAG = re.compile(rf"<!--(.*?)(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+{VALUE}?+)?+|=)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(rf"([^\s=/>]+)(?:\s*=\s*({VALUE}))?")
UNNAMED = frozenset("html body article main".split())
PARTS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
CLOSES_P = BLOCKS - {"html", "body"}
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Node:
    """An element: which of the page's it is in order, which is around it, and whether it is dropped by itself."""

    __slots__ = ("above", "dropped", "hash", "holds", "main", "named", "number", "tag")

    def __init__(self, tag: str, number: int, above: Node | None, dropped: bool, named: bool, main: bool) -> None:
        self.tag, self.number, self.above, self.dropped, self.named, self.main, self.holds, self.hash = tag, number, above, dropped, named, main, False, xxhash.xxh64(tag)


def names(attributes: str) -> set[str]:
    """Class names and the id, in lower case, with hyphens for underscores."""
    return {w for name, value in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in value.strip("\"'").lower().replace("_", "-").split()}


def furniture(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is page furniture by its tag, or an article within the article that is a comment."""
    if tag == "article" and in_main and attributes:
        return any("comment" in w or "comments" in w for w in (n.split("-") for n in names(attributes)))
    return tag in FURNITURE or (tag == "header" and not in_main)


def sign(word: str) -> bool:
    """Whether a class name or id tells furniture, as a whole or by one of its parts."""
    if word in SIGNS:
        return True
    parts = word.split("-")
    return len(parts) > 1 and not STRONG.isdisjoint(parts) and LAYOUT.isdisjoint(parts[:-1] if parts[-1] in ("left", "right", "container", "wrapper", "wrap", "content") and parts[0] in STRONG else [p for p in parts if p not in ("post", "page", "main")])


def named(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is page furniture by its role, class or id, or isn't shown. Within an article only names of comments, notices and adverts decide."""
    if not attributes or tag in UNNAMED:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and "".join(value.split()).find("display:none") >= 0) or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if name in ("class", "role") or (name == "id" and not (in_main and tag in PARTS)):
            words = value.replace("_", "-").split()
            if not INSIDE.isdisjoint(words) if in_main else (not HEADERS.isdisjoint(words) or any(map(sign, words))):
                return True
    return False


@dataclass
class Page:
    """Blocks of text in order, of each the number of the container around it (0: none) and whether it passes the check by tag and name; of each container the one around it and its hash."""

    blocks: list[str]
    within: list[int]
    passes: list[bool]
    above: list[int]
    hashes: list[int]


def parsed(page: str) -> Page:
    """Every step takes time in proportion to the page, however deep its elements lie in each other."""
    stack = [Node("#", 0, None, False, False, False)]
    nodes = [stack[0]]
    open_ = Counter()
    blocks: list[tuple[str, Node]] = []
    text: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            s = " ".join(unescape("".join(text)).split())
            text.clear()
            if s:
                stack[-1].hash.update(s)  # those around get it with the digest of what they hold
                blocks.append((s, stack[-1]))

    def close(to: int) -> None:
        flush()
        while len(stack) > to:
            x = stack.pop()
            open_[x.tag] -= 1
            if stack:
                stack[-1].hash.update(x.hash.digest())

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in BLOCKS or tag in SKIPPED:
                if not open_[tag]:
                    flush()
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in FOREIGN and m[4].endswith("/"):  # these may close themselves
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in BLOCKS and tag not in SKIPPED:
            continue
        flush()
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in SIBLINGS:
            own, limits = SIBLINGS[tag]
            if any(open_[t] for t in own.split()):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in limits:
                        break
                    if stack[i].tag in own.split():
                        close(i)
                        break
        above = stack[-1]
        main = above.main or tag in ("article", "main")
        dropped = tag in SKIPPED or furniture(tag, m[4], above.main)
        own_ = Node(tag, len(nodes), above, dropped, not dropped and named(tag, m[4], above.main), main)
        nodes.append(own_)
        stack.append(own_)
        open_[tag] += 1
        if tag in ("article", "main") and not dropped:
            x = own_
            while x and not x.holds:
                x.holds, x = True, x.above
    close(0)
    gone = _gone(nodes)
    stays = [not gone[x.number] for _, x in blocks]
    marked = any(s and x.main for s, (_, x) in zip(stays, blocks))
    if not marked and any(x.main for _, x in blocks):  # the marked article is within an element of such a name: that is none
        about = {x.number for _, x in blocks}
        for x in reversed(nodes):
            if x.number in about and x.above:
                about.add(x.above.number)
        for x in nodes:
            if x.number in about and x.named and x.holds:
                x.named = False
        gone = _gone(nodes)
        stays = [not gone[x.number] for _, x in blocks]
        marked = any(s and x.main for s, (_, x) in zip(stays, blocks))
    full = {x.number for _, x in blocks}
    for x in reversed(nodes):
        if x.number in full and x.above:
            full.add(x.above.number)
    place, above_, hashes = {0: 0}, [], []
    for x in nodes[1:]:
        if x.tag in TEXTUAL or x.number not in full:
            place[x.number] = place[x.above.number]
        else:
            above_.append(place[x.above.number])
            hashes.append(x.hash.intdigest() - (1 << 63))
            place[x.number] = len(hashes)
    return Page([s for s, _ in blocks], [place[x.number] for _, x in blocks], [s and (x.main or not marked) for s, (_, x) in zip(stays, blocks)], above_, hashes)


def _gone(nodes: list[Node]) -> list[bool]:
    """Of each element whether it or one around it is dropped."""
    out: list[bool] = []
    for x in nodes:
        out.append(x.dropped or x.named or (x.above is not None and out[x.above.number]))
    return out


def kept(blocks: list[str], within: list[int], above: list[int], hashes: list[int], template: set[int]) -> list[str]:
    """The blocks that no subtree of the template holds."""
    gone = [False]
    for up, h in zip(above, hashes):
        gone.append(gone[up] or h in template)
    return [b for b, i in zip(blocks, within) if not gone[i]]


PARTS_OF = [T.StructField("blocks", T.ArrayType(T.StringType())), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("within", "above")), T.StructField("hashes", T.ArrayType(T.LongType()))]


def extract(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", min_pages: int = 5) -> DataFrame:
    """Each page, without its html, with ``text``, its main text.

    A subtree is template if it is in ``min_pages`` pages of the host at least, however large the host.
    Pages are read twice, for the counts and for the result, so that only what may stay is shuffled:
    blocks, and of the containers their hashes and which is around which.
    """
    base = without(pages, ["text"])
    kept_ = [c for c in base.columns if c != html]
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(column(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    page = F.xxhash64(host, column(page_id), column(html))

    def subtrees():
        def run(part: pa.RecordBatch) -> list:
            hashes, articles = [], []
            for h in part.column(0).to_pylist():
                p = parsed(h or "")
                hashes.append(sorted({*p.hashes}))
                articles.append(xxhash.xxh64_intdigest("\n\n".join(b for b, ok in zip(p.blocks, p.passes) if ok)) - (1 << 63))
            return [hashes, articles]

        return run

    def contents():
        def run(part: pa.RecordBatch) -> list:
            out = []
            for h in part.column("html").to_pylist():
                p = parsed(h or "")
                out.append(([b for b, ok in zip(p.blocks, p.passes) if ok], [i for i, ok in zip(p.within, p.passes) if ok], p.above, p.hashes))
            return [list(x) for x in zip(*out)] if out else [[], [], [], []]

        return run

    own = attach(pages.select(column(html).alias("html"), host.alias("host"), page.alias("page")), [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("article", T.LongType())], subtrees, "html")
    own = stage(own.select("host", "page", "hashes", "article"), "pages-subtrees")
    held = own.select("host", "page", F.explode("hashes").alias("hash")).distinct()
    seen = own.select("host", "article", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("seen"))
    template = seen.filter(F.col("seen") >= min_pages).select("host", "hash")
    found = held.join(template, ["host", "hash"], "left_semi").groupBy("page").agg(F.collect_set("hash").alias("gone"))
    rows = base.select(F.struct(*map(column, kept_)).alias("row"), column(html).alias("html"), page.alias("page"))
    read = attach(rows, PARTS_OF, contents, "html").drop("html").join(found, "page", "left").drop("page")

    @F.pandas_udf("string")
    def text(blocks: pd.Series, within: pd.Series, above: pd.Series, hashes: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(kept(b, i, a, h, {*(g if g is not None else ())})) for b, i, a, h, g in zip(blocks, within, above, hashes, gone)], dtype=object)

    return read.select(*[F.col("row").getField(c).alias(c) for c in kept_], text("blocks", "within", "above", "hashes", "gone").alias("text"))
