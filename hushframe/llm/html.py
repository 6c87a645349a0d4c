"""Main text of web pages by tree scoring.

A page becomes a tree; parts that are never text (scripts, styles, forms) go. So do parts that name themselves as menus, headers,
footers, sidebars, notices, adverts or comments, but not one that wraps most of the page's text (``WRAPS``), and if less than ``LEFT`` of the text
outside links is left, names only lower scores, unless a part is mostly links or a few words. Every paragraph gives points for its length and its commas to its
ancestors, fewer with each level; an element's points are discounted by the share of its text that stands in links. The element with
most points is the container. Siblings that have many points as well, headings and plain text beside it are kept.
All text in what is kept stays, in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Never text of the article.
GONE = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas dialog menu audio video map title".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
#: Opening tag -> open tags of its kind that it ends, up to the nearest of the last ones.
ENDS_SAME = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or an id by which parts say that they are not the article.
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar sidebars side rail comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar subscribe subscription newsletter popup modal overlay paywall pagination pager widget widgets login signup search form skip skyscraper outbrain taboola metadata byline tags toc".split()
)
KEEP = frozenset("html body article main".split())
LEVELS = 5
#: A name of several words ("content-with-sidebar") or of one ("sidebar") does not remove a part with more than this share of the text.
WRAPS = (0.5, 0.9)
#: With less of the text left, names of several words remove nothing more; with less than the second, no names do.
LEFT = (0.75, 0.1)
LOWER = 0.25

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Elements that an opening tag of a list, table or select may end, or that stop it.
PARTS = frozenset().union(*(same | stop for same, stop in ENDS_SAME.values()))


class Node:
    """An element. ``block`` and ``part``: the nearest element from itself upwards that is a block, or one of ``PARTS``."""

    __slots__ = ("tag", "parent", "children", "block", "part", "gone", "named", "low", "headed", "score", "text_len", "link_len", "commas")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.part = self if tag in PARTS else parent.part if parent is not None else None
        self.named, self.low, self.headed = 0, False, False
        self.gone, self.score, self.text_len, self.link_len, self.commas = False, 0.0, 0, 0, 0


def _boilerplate(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is never text, and whether it is named as none: 2 by a class or id of one word, 1 by a word among others, or 0."""
    if tag in GONE or (tag == "header" and not in_article):
        return True, 0
    if not attrs or tag in KEEP:
        return False, 0
    named = 0
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if not (in_article and tag in HEADINGS):
                for x in value.split():
                    words = _WORDS.findall(x)
                    if any(w.lower() in NAMES for w in words):
                        named = max(named, 2 if len(words) == 1 else 1)
        elif (name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, 0
    return False, named


def tree(html: str) -> Node:
    """The page as a tree of elements and text pieces, whatever its mistakes: unknown end tags are ignored, open ones end with their parent.

    The time is linear in the page: each character is looked at a few times, an end tag walks up only over what it closes, and an
    opening tag only over the list, table and select parts around it."""
    root = Node("html", None)
    at, node, n = 0, root, len(html)
    last = html.rfind(">")  # no tag begins behind it
    opened: Counter[str] = Counter()
    body = False

    def close(upto: Node) -> Node:
        """Ends all open elements up to the given one; its parent."""
        x = node
        while x is not upto:
            opened[x.tag] -= 1
            x = x.parent
        opened[x.tag] -= 1
        return x.parent

    while at < n:
        m = _TAG.search(html, at, last + 1) if at <= last else None
        if m is None:
            node.children.append(unescape(html[at:].partition("<!--")[0]))
            break
        if m.start() > at:
            node.children.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>"))
            elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that nothing closes
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if opened[tag]:
                x = node
                while x.tag != tag:
                    x = x.parent
                node = close(x)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not body:
                if node is not root:  # an open head ends here
                    x = node
                    while x.parent is not root:
                        x = x.parent
                    node = close(x)
                node, body = Node("body", root), True
                root.children.append(node)
                opened["body"] += 1
            continue
        if tag in ENDS_P and node.block.tag == "p":
            node = close(node.block)
        if tag in ENDS_SAME:
            same, stop = ENDS_SAME[tag]
            x, outer = node.part, None
            while x is not None and x.tag not in stop:
                if x.tag in same:
                    outer = x
                x = x.parent.part
            if outer is not None and x is not None:
                node = close(outer)
        new = Node(tag, node)
        new.gone, new.named = _boilerplate(tag, attrs, opened["article"] > 0)
        new.gone = new.gone or node.gone
        node.children.append(new)
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            if end is None:
                break
            at = html.find(">", end.end()) + 1 or n
        elif tag not in VOID and not attrs.endswith("/"):
            node = new
            opened[tag] += 1
    return root


def _measure(root: Node) -> list[Node]:
    """Elements that stay, parents first, with their lengths of text and of text in links."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        in_link = in_link or node.tag == "a"
        order.append(node)
        for c in node.children:
            if isinstance(c, str):
                size = len(" ".join(c.split()))
                node.text_len += size
                node.commas += c.count(",") + c.count("，") + c.count("、")
                if in_link:
                    node.link_len += size
        for c in reversed(node.children):
            if isinstance(c, Node) and not c.gone:
                stack.append((c, in_link))
    for node in reversed(order):
        node.headed = node.headed or node.tag in HEADINGS
        if node.parent is not None:
            node.parent.headed = node.parent.headed or node.headed
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
            node.parent.commas += node.commas
    return order


def _drop_named(root: Node, order: list[Node]) -> None:
    """Mark what goes by its name, and what has its scores lowered. Lengths are of the tree with all named parts."""
    total = root.text_len - root.link_len
    plain = lambda x: x.text_len - x.link_len
    for least in (1, 2, 3):  # names of several words or of one; of one; none
        gone, low, left, stack = [], [], total, [(root, False)]
        while stack:
            x, lowered = stack.pop()
            if x.named and plain(x) <= WRAPS[x.named - 1] * total:
                few = x.link_len >= 0.5 * x.text_len or (x.text_len < 25 and not x.headed)
                if few or x.named >= least:
                    gone.append(x)
                    left -= plain(x)
                    continue
                lowered = True
            if lowered:
                low.append(x)
            stack.extend((c, lowered) for c in x.children if isinstance(c, Node) and not c.gone)
        if least == 3 or left >= LEFT[least - 1] * total:
            break
    for x in low:
        x.low = True
    for x in gone:
        stack = [x]
        while stack:
            y = stack.pop()
            y.gone = True
            stack.extend(c for c in y.children if isinstance(c, Node))
    if gone:
        for x in order:
            x.text_len = x.link_len = x.commas = 0


def blocks(kept: list[Node | str]) -> list[str]:
    """The blocks' texts of the kept elements: white space becomes one space; empty blocks are none."""
    out, now = [], []

    def end() -> None:
        if now:
            text = " ".join("".join(now).split())
            if text:
                out.append(text)
            now.clear()

    for top in kept:
        stack: list = [top]
        end()
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif not x.gone:
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.children))
        end()
    return out


def main_text(html: str | None) -> str:
    """The article's text; empty if there is none."""
    if not html:
        return ""
    root = tree(html)
    order = _measure(root)
    _drop_named(root, order)
    if any(x.gone for x in order):
        order = _measure(root)
    scored = []
    for node in order:
        if node.tag in PARAGRAPHS or (node.tag in ("div", "section", "article", "main", "center") and not any(isinstance(c, Node) and c.tag in BLOCK and c.tag != "br" and not c.gone for c in node.children)):
            if not node.text_len or node.link_len >= 0.5 * node.text_len:
                continue
            points = 1 + node.commas + min(node.text_len / 100, 3)
            if node.text_len < 25:
                points *= node.text_len / 25
            if node.low:
                points *= LOWER
            up, level = node.parent, 1
            while up is not None and level <= LEVELS:
                if not up.score:
                    scored.append(up)
                up.score += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                up, level = up.parent, level + 1
            if node.parent is None:
                scored.append(node)
    if not scored:
        return " ".join(blocks([root]))
    final = {id(x): x.score * (1 - x.link_len / max(1, x.text_len)) for x in scored}
    best = max(scored, key=lambda x: final[id(x)])  # of equals the first in the page
    # an enclosing article or main that holds little else is the container
    up = best.parent
    while up is not None and up.tag not in ("html", "body"):
        if up.tag in ("article", "main") or up.text_len - up.link_len <= 1.2 * (best.text_len - best.link_len):
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("html", "body"):
        return " ".join(blocks([best]))
    need, kept = max(10.0, 0.2 * final.get(id(best), 0.0)), []
    alone = best.tag in ("article", "main")
    for c in best.parent.children:
        if isinstance(c, str):
            if not alone and c.strip():
                kept.append(c)
            continue
        if c.gone:
            continue
        density = c.link_len / max(1, c.text_len)
        if c is best or final.get(id(c), 0.0) >= need or (c.tag in HEADINGS and not alone) or (c.tag in PARAGRAPHS and density < 0.25 and (c.text_len > 80 or not alone)) or (not alone and (not c.low or best.named) and c.tag not in HEADINGS and density < 0.25 and (c.tag not in BLOCK or id(c) in final)):
            kept.append(c)
    return " ".join(blocks(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row. A null, empty or wordless page has an empty text; repeated rows and null ids are rows
    as others; other columns are ignored."""
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = given.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                text = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
