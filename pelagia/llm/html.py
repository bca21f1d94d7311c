"""Main text of web pages by composite text density.

A page becomes a tree. For every node the characters, tags, characters in links and link tags of its subtree give its
composite text density: characters per tag, damped where much of the text is link text. A node's density sum adds the
densities of its children. The node with the largest sum holds the article; the smallest density on the path from the
body to it is the threshold: the article is widened to neighbours that reach it, and lists of links in the article that
do not reach it are left out, but for those in an `article` element. What the markup itself names as furniture (menus,
footers, forms, adverts, notices, comments) is taken out before the densities are summed; a form that holds most of the
page's other text is the page itself, as some systems make them, and stays. Markup is read in time proportional to the page's length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pelagia.llm.common import table

#: Fixed values of HTML: elements without content, with raw content, that start a block, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table body html article section div td th".split())
CLOSES_P = BLOCK - frozenset("body html li dt dd td th tr tbody thead tfoot option legend summary figcaption".split())

#: Elements, roles and words of class or id that name what is not the article.
FURNITURE = frozenset("nav footer aside form button select input label dialog menu svg canvas object audio video script style noscript template iframe textarea head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice
    notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer foot
    masthead topbar header toolbar pagination pager share sharing social related recommended recommendations comment comments commentlist disqus replies respond widget
    widgets login search skip copyright legal disclaimer""".split()
)
#: Words that beside one of NAMES still name furniture; any other word makes a name of the page's own.
BESIDE = frozenset("site page main top bottom left right primary secondary global mobile box bar list links link icons buttons block section container wrapper wrap inner outer area items item form text message posts post".split())

MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
SPACE = re.compile(r"\s+")


def names_furniture(names: str) -> bool:
    """Whether one of a class attribute's names or an id says that the element is not the article."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        own_title = "post" in parts and "header" in parts
        if any(p in NAMES for p in parts) and all(p in NAMES or p in BESIDE for p in parts) and not own_title:
            return True
    return False


@dataclass
class Node:
    """An element; children hold nodes and decoded strings in page order."""

    tag: str
    parent: Node | None = None
    names: str = ""
    drop: bool = False
    form: bool = False
    children: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


class Tags:
    """The marks of a page in order; remembers what the rest of the page does not hold, so that nothing is searched twice."""

    def __init__(self, page: str):
        self.page, self.lenient = page, False

    def end(self, at: int) -> int:
        """The place after the `>` that ends the tag whose name ends at `at`; -1 if none does. Quoted values may hold one."""
        page, pos = self.page, at
        while not self.lenient:
            m = QUOTE_OR_END.search(page, pos)
            if m is None:
                self.lenient = True
            elif m[0] == ">":
                return m.end()
            elif page[:m.start()].endswith("=") or page[max(at, m.start() - 20) : m.start()].rstrip().endswith("="):
                close = page.find(m[0], m.end())
                if close < 0:
                    self.lenient = True
                pos = close + 1
            else:
                pos = m.end()
        return page.find(">", at) + 1 or -1


def parse(page: str) -> Node:
    """A tree of any markup: unknown end tags are ignored, open elements end with the page."""
    root = Node("html")
    at, pos, tags, open_ = root, 0, Tags(page), Counter()
    no_cdata_end = False

    def close(tag: str, within: frozenset[str] = frozenset()) -> None:
        nonlocal at
        if not open_[tag]:
            return
        node, passed = at, []
        while node is not root and node.tag != tag:
            if node.tag in within:
                return
            passed.append(node.tag)
            node = node.parent
        if node is not root:
            open_.subtract([*passed, tag])
            at = node.parent

    def text(raw: str) -> None:
        if raw:
            at.children.append(entities.unescape(raw) if "&" in raw else raw)

    while True:
        m = MARK.search(page, pos)
        text(page[pos : m.start() if m else len(page)])
        if m is None:
            return root
        pos = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", pos)
                pos = end + 3 if end >= 0 else len(page)
            elif m[0] == "<![CDATA[" and not no_cdata_end and (end := page.find("]]>", pos)) >= 0:
                at.children.append(page[pos:end])
                pos = end + 3
            else:
                no_cdata_end |= m[0] == "<![CDATA["
                end = page.find(">", pos)
                pos = end + 1 if end >= 0 else len(page)
            continue
        end = tags.end(pos)
        if end < 0:  # no tag ends any more: the rest is text
            text(page[m.start() :])
            return root
        inside, pos, tag = page[pos : end - 1], end, m[2].lower()
        if m[1]:
            if tag not in VOID:
                close(tag)
            elif tag == "br":
                at.children.append(Node("br", at))
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            close("p", SCOPES | frozenset(["button"]))
        for other in CLOSED_BY.get(tag, ()):
            close(other, frozenset("ul ol dl table select".split()))
        found = _attributes(inside) if inside.strip(" /") else {}
        node = Node(tag, at, f"{found.get('class', '')} {found.get('id', '')}".strip())
        node.form = tag == "form"
        node.drop = tag in FURNITURE and not node.form or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        node.drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE))
        at.children.append(node)
        if tag in VOID or inside.endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        if tag in RAW:
            node.drop = True
            raw_end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, pos)
            pos = raw_end.end() if raw_end else len(page)
            continue
        at = node
        open_[tag] += 1


def _furniture(node: Node, in_article: bool) -> bool:
    if node.drop or node.tag == "header" and not in_article:
        return True
    return bool(node.names) and node.tag not in ("html", "body", "article", "main") and names_furniture(node.names)


def drop_small_forms(root: Node) -> None:
    """Mark the forms that hold half of the page's text or less, furniture not counted, as furniture."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside |= node.tag in ("article", "main")
        order.append(node)
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and not _furniture(c, inside)]
    if any(node.form for node in order):
        for node in reversed(order):
            node.chars += sum(len(SPACE.sub("", c)) for c in node.children if isinstance(c, str))
            if node.parent is not None:
                node.parent.chars += node.chars
        for node in order:
            node.drop |= node.form and node.chars * 2 <= root.chars


def measure(root: Node) -> None:
    """Take furniture out, then fill in the counts and densities of every node, children before parents."""
    drop_small_forms(root)
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside |= node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _furniture(c, inside)]
        order.append(node)
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(SPACE.sub("", c))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    whole, linked = max(1, root.chars), root.link_chars
    for node in reversed(order):
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, linked / whole)
        node.density_sum = sum(c.density for c in node.children if isinstance(c, Node))
        if any(isinstance(c, str) and c.strip() for c in node.children):  # text of its own counts as one more child
            own = sum(len(SPACE.sub("", c)) for c in node.children if isinstance(c, str))
            node.density_sum += composite_density(own, 0, 0, 0, linked / whole)


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    """Characters per tag, times a logarithm that falls as links take more of the text and of the tags."""
    if not chars:
        return 0.0
    per_tag = chars / max(1, tags)
    plain = max(1, chars - link_chars)
    base = math.log(chars * max(1, link_chars) / plain + link_share * chars + math.e)
    value = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return per_tag * max(0.0, math.log(max(1.0, value)) / base)


def _nodes(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack += [c for c in reversed(here.children) if isinstance(c, Node)]


def _is_link_list(node: Node, threshold: float) -> bool:
    """Whether a block below the threshold holds several links and little else."""
    return node.tag in BLOCK and node.density < threshold and node.link_tags >= 3 and node.link_chars * 4 >= node.chars * 3


def blocks(node: Node, threshold: float = 0.0) -> list[str]:
    """The texts of the blocks below a node in page order, white space as one space; `br` ends a block as well.

    Lists of links whose density is below the threshold are no blocks of the article."""
    out: list[str] = []
    text: list[str] = []

    def end() -> None:
        if line := SPACE.sub(" ", "".join(text)).strip():
            out.append(line)
        text.clear()

    stack: list = [node]
    while stack:
        here = stack.pop()
        if here is None:
            end()
        elif isinstance(here, str):
            text.append(here)
        elif here.tag in ("br", "hr"):
            end()
        elif here is node or not _is_link_list(here, threshold):
            if here.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(here.children)
    end()
    return out


def main_node(root: Node) -> tuple[Node | None, float]:
    """The node whose subtree is the article, and the path's threshold: the largest density sum, widened while the threshold allows.

    An `article` or `main` element that holds the winner is taken as a whole, as what the page itself marks."""
    body = next((n for n in _nodes(root) if n.tag == "body"), root)
    best = max(_nodes(body), key=lambda n: n.density_sum, default=None)
    if best is None or not best.chars:
        return (body if body.chars else None), 0.0
    marked, node, threshold = None, best, best.density
    while node is not None and node is not body.parent:
        threshold = min(threshold, node.density)
        if node.tag in ("article", "main"):
            marked = node
        node = node.parent
    if marked is not None:
        return marked, 0.0 if marked.tag == "article" else threshold
    node = best
    while node is not body and node.parent is not None:
        rest = [c for c in node.parent.children if isinstance(c, Node) and c is not node and c.chars]
        if not rest or all(c.density < threshold or c.link_chars * 2 > c.chars for c in rest):
            break
        node = node.parent
    return node, threshold


def extract(page: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    node, threshold = main_node(root)
    return " ".join(blocks(node, threshold)) if node is not None else ""


def main_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without html_col and with a column `text`, the main text of the page; a column `text` of df is replaced.

    Null, empty and text-free pages give an empty text; any other bytes are read as leniently as a browser would.
    Repeated rows and equal pages are answered row by row; null values in other columns and columns of any names are
    carried along; an empty table gives an empty result. Equal density sums go to the node that comes first."""
    names = [c for c in df.columns if c not in (html_col, "text")]

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[names].assign(text=[extract(p) for p in b[html_col]])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "text string"])
    return df.select(*names, html_col).mapInPandas(extracted, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    from pyspark.sql import functions as F

    made = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
