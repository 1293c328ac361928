"""Main-text extraction by composite text density.

The page becomes a tree of its block elements. A node's composite density is its characters per tag,
adjusted by how much of its text and tags are links and by the page's own share of link text; the
node whose children's densities have the largest sum holds the article. The threshold is the least
density on the path from that node to the body: siblings that reach it belong to the article too, and
containers below it that are mostly links don't.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded

SCHEMA = "page_id long, url string, text string, n_chars long"
# Every alternative keeps what it has matched and ends at the page's end at the latest, so that a page is read in one pass whatever its markup.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|iframe|select|annotation|annotation-xml)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup header footer nav aside form fieldset dialog menu center hr noscript".split())
DROPPED = frozenset("nav footer aside dialog menu button input select option label fieldset title head object embed canvas audio video".split())
VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
ENDS_P = BLOCKS - {"html", "body"}
PHRASE_DROPPED = frozenset("button label option".split())
# A name is boilerplate if it is made of these words alone, apart from neutral ones: "share-buttons" and "related-posts" are, "related-work" and "search-algorithms" are not.
NAMED = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar side ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommend recommended recommendation recommendations comment comments commentlist disqus respond replies pagination pager skip toolbar masthead widget copyright legal".split()
)
NEUTRAL = frozenset("area articles bar block body box button buttons center column container content div entry footer form global group header holder icons inner item items js left link links list lower main media module outer page panel post posts primary region right row secondary section site slot stories thread top bottom unit upper wrap wrapper".split())
SITE_HEADER = frozenset("header siteheader globalheader topheader topbar".split())
WORDS = re.compile(r"[^\s_-]+")
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr caption blockquote pre figcaption address summary".split())  # never judged by name
ATTRS = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar".split())
INNER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr"}, "th": {"tr"}}


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total", "kids")

    def __init__(self, tag: str, parent: Node | None, drop: bool) -> None:
        self.tag, self.parent, self.drop = tag, parent, drop
        self.doubtful = False  # boilerplate by its name or as a form, unless it holds the page's main mass
        self.items: list = []  # text pieces and nodes, in page order
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def attributes(raw: str) -> list[tuple[str, str]]:
    """(name, value) of the attributes that say what an element is."""
    found = ((n.lower(), v.strip("\"'")) for n, v in ATTRS.findall(raw))
    return [x for x in found if x[0] in ("class", "id", "role", "hidden", "style")]


def boilerplate(tag: str, attrs: list[tuple[str, str]], in_article: bool) -> bool:
    """Whether the element goes whatever it holds: by its tag or role, or because it isn't shown."""
    if tag in DROPPED or (tag in ("header", "noscript") and not in_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "role" and value.lower() in ROLES or name == "hidden":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def named(value: str, in_article: bool) -> bool:
    """Whether a class or an id is a name of boilerplate."""
    for name in value.lower().split():
        words = [w.rstrip("0123456789") for w in WORDS.findall(name)]
        if any(w in NAMED for w in words) and all(w in NAMED or w in NEUTRAL or not w for w in words):
            return True
        if not in_article and "".join(words) in SITE_HEADER:
            return True
    return False


def doubtful(tag: str, attrs: list[tuple[str, str]], in_article: bool) -> bool:
    """Whether the element is a container named like boilerplate, or a form or search: so may be a wrapper around the page. Headings, paragraphs and the like are never judged by name."""
    if tag == "form":
        return True
    if tag in ("html", "body", "article", "main") or tag in TEXT_TAGS:
        return False
    return any(n in ("class", "id") and named(v, in_article) or n == "role" and v.lower() in ("search", "form") for n, v in attrs)


def settle(root: Node) -> None:
    """Drops the doubtful elements that don't hold the main mass: the largest article or main, or over half of the text outside links of that (of the page, if there is none)."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            order.append(x)
            stack.extend(reversed(x.kids))
    if not any(x.doubtful for x in order):
        return
    mass = {x: x.chars - x.link_chars for x in order}
    for x in reversed(order):
        if x.parent is not None:
            mass[x.parent] += mass[x]
    base = max((x for x in order if x.tag in ("article", "main")), key=mass.get, default=root)
    around, x = set(), base
    while x is not None:
        around.add(x)
        x = x.parent
    inside = set()
    for x in order:
        if x is base or x.parent in inside:
            inside.add(x)
        if x.doubtful and x not in around:
            x.drop = not (x in inside and 2 * mass[x] > mass[base])


def parse(page: str) -> Node:
    """The tree of block elements; scripts, styles and comments are gone, other inline elements count as tags only."""
    root = Node("body", None, False)
    at, link, pos = root, 0, 0
    opened: Counter[str] = Counter()  # tags of the nodes from the root to `at`, so that a stray end tag needs no search

    def leave(upto: Node) -> None:
        """Closes all nodes below `upto`."""
        nonlocal at, link
        while at is not upto:
            opened[at.tag] -= 1
            at = at.parent
        link = 0

    def text(piece: str) -> None:
        if piece:
            at.items.append(piece)
            if not at.drop:
                n = len(piece.strip())
                at.chars += n
                if link:
                    at.link_chars += n

    for m in TOKEN.finditer(page):
        if m.start() > pos:
            text(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[4]
        if tag in ("html", "body"):
            continue
        if m[2]:
            if tag == "a":
                link = max(0, link - 1)
            if opened[tag] > 0:
                x = at
                while x.tag != tag:
                    if x.tag in ("td", "th", "table", "article", "main") and tag in ("p", "li"):
                        x = root
                        break
                    x = x.parent
                if x is not root:
                    leave(x.parent)
            continue
        if tag == "br":
            text(" ")
        at.tags += not at.drop
        if tag == "a" and not attrs.endswith("/"):
            link = 1
            at.link_tags += not at.drop
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCKS or tag in DROPPED:
            if tag in ENDS_P and opened["p"] > 0:
                x = at
                while x is not root and x.tag not in ("p", "td", "th", "li", "div", "article", "section", "main"):
                    x = x.parent
                if x.tag == "p":
                    leave(x.parent)
            if tag in INNER:
                x = at
                while x is not root and x.tag not in INNER[tag] and x.tag != tag and not (tag in ("td", "th") and x.tag in ("td", "th")) and not (tag in ("dt", "dd") and x.tag in ("dt", "dd")):
                    x = x.parent
                if x is not root and x.tag not in INNER[tag]:
                    leave(x.parent)
            if tag == "hr":
                at.items.append(Node("hr", at, at.drop))
                continue
            said, in_article = attributes(attrs) if attrs else [], opened["article"] + opened["main"] > 0
            node = Node(tag, at, at.drop or boilerplate(tag, said, in_article))
            node.doubtful = doubtful(tag, said, in_article)
            at.items.append(node)
            at.kids.append(node)
            if attrs.endswith("/") and tag not in BLOCKS:
                continue
            at = node
            opened[tag] += 1
    if pos < len(page):
        text(entities.unescape(page[pos:]))
    return root


def weigh(root: Node) -> list[Node]:
    """Sums chars and tags up the tree and sets the densities; returns the kept nodes in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            order.append(x)
            stack.extend(reversed(x.kids))
    for x in reversed(order):
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
    share = root.link_chars / max(1, root.chars)
    for x in order:
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        if c:
            base = math.log(c / max(1, c - x.link_chars) * x.link_chars + share * c + math.e)
            x.density = c / t * math.log(max(1.0 + 1e-9, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t * math.log(max(1.0 + 1e-9, c / lc * t / lt))
    for x in order:
        x.total = sum(k.density for k in x.kids if not k.drop) or x.density * 0.5
    return order


def blocks(top: list[Node]) -> list[str]:
    """Texts of the blocks under the given nodes, white space inside a block being one space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        t = " ".join("".join(held).split())
        held.clear()
        if t:
            out.append(t)

    for node in top:
        stack = [iter(node.items)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                flush()
            elif isinstance(x, str):
                held.append(x)
            else:
                flush()
                if not x.drop:
                    stack.append(iter(x.items))
    return out


def extract(page: str | None) -> str:
    if not isinstance(page, str) or not page:
        return ""
    root = parse(page)
    settle(root)
    order = weigh(root)
    best = max(order, key=lambda x: x.total)
    box, x = None, best
    while x is not None:
        if x.tag in ("article", "main"):
            box = x
        x = x.parent
    if box is None:
        inside = [x for x in order if x.tag in ("article", "main")]
        if inside and best.tag in ("body", "div", "section"):
            held = max(inside, key=lambda x: x.chars)
            y = held
            while y is not None and y is not best:
                y = y.parent
            box = held if y is best else None
    if box is not None:
        return "\n".join(blocks([box]))
    threshold, x = best.density, best
    while x is not None:
        threshold = min(threshold, x.density)
        x = x.parent
    for x in order:  # menus among the paragraphs: containers below the threshold whose text is mostly links
        if x.tag not in TEXT_TAGS and x.link_tags > 1 and 2 * x.link_chars > x.chars and x.density < threshold:
            x.drop = True
    top, stack = [], [root]
    path = set()
    x = best.parent
    while x is not None:
        path.add(x)
        x = x.parent
    while stack:
        x = stack.pop()
        if isinstance(x, str):  # text that stands directly in a node of the path
            if not top or top[-1].tag != "#text":
                top.append(Node("#text", None, False))
            top[-1].items.append(x)
        elif x is best or x not in path:
            if not x.drop and (x is best or x.density >= threshold):
                top.append(x)
        else:
            stack.extend(reversed(x.items))
    return "\n".join(blocks(top))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page's main text.

    Null, empty or text-free html: empty text. Broken markup (unclosed or stray tags, a page that
    ends early, also inside a tag, which then goes) is read as browsers do, roughly, in time that is linear in its length. Repeated rows give repeated results; an empty table
    gives an empty table; other columns are ignored. Nothing of the article is capped.
    """

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in x], dtype=object)

    out = bounded(pages).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), run(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
