"""Main text of HTML pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, a container's points are discounted by its link density, and the best container
is kept together with the siblings that read like it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video map head title nav header footer aside form button select textarea datalist dialog menu".split())
BLOCKS = frozenset("html body article main section div p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption address details summary hr br center hgroup".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
ENDS_P = BLOCKS - {"br"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist disqus reply replies respond discussion footer header masthead toolbar pagination pager tags tagcloud skip hidden".split())

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)                                                      # comments
      | <(?P<raw>script|style|textarea|title|noscript|iframe|xmp|svg|template)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)   # elements without text of the page
      | <[!?][^>]*>
      | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>
      | </?[a-zA-Z][^>]*>                                                        # a tag with an odd quote""",
    re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LONG_PARAGRAPH = 80
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("chars", "commas", "kids", "links", "name", "parent", "points", "side", "worded")

    def __init__(self, name: str, parent: Node | None, side: bool, worded: bool = False):
        self.name, self.parent, self.side, self.worded = name, parent, side, worded
        self.kids: list[Node | str] = []
        self.chars = self.commas = self.links = 0
        self.points = 0.0


def _is_side(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is not part of the main text by its name or attributes, and whether a whole word of its class or id says so."""
    if name in NEVER:
        return True, False
    if not rest or name in ("html", "body", "main"):
        return False, False
    worded = False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN_STYLE.search(value):
            return True, False
        worded = worded or key in ("class", "id") and not SIDE_WORDS.isdisjoint(value.split())
    return False, worded


def parse(page: str) -> Node:
    """A tree of elements and text pieces; wrongly nested tags are closed at the nearest open match."""
    root = Node("html", None, False)
    at, last = root, 0

    def text(piece: str) -> None:
        if piece:
            at.kids.append(html.unescape(piece))

    for m in TOKEN.finditer(page):
        text(page[last: m.start()])
        last = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            up = at
            while up is not root and up.name != name:
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        if name in ("html", "body") and at is root:
            continue
        if name in ENDS_P:
            up = at
            while up is not root and up.name not in ("p", "td", "th", "li", "div", "article", "section", "main"):
                up = up.parent
            if up.name == "p":
                at = up.parent
        if name in CLOSED_BY and at.name in CLOSED_BY[name]:
            at = at.parent
        side, worded = _is_side(name, m["rest"])
        node = Node(name, at, at.side or side, worded)
        at.kids.append(node)
        if name not in VOID and not m["rest"].endswith("/"):
            at = node
    text(page[last:])
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element before and after its content."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        yield node, done
        if not done:
            stack.append((node, True))
            stack.extend((k, False) for k in reversed(node.kids) if isinstance(k, Node))


def _measure(root: Node) -> None:
    """Characters, commas and linked characters of every element, then the points that paragraphs pass upwards."""
    for node, done in _walk(root):
        if not done or node.side:
            continue
        for k in node.kids:
            if isinstance(k, str):
                squeezed = " ".join(k.split())
                node.chars += len(squeezed)
                node.commas += squeezed.count(",")
            elif not k.side:
                node.chars, node.commas, node.links = node.chars + k.chars, node.commas + k.commas, node.links + k.links
        if node.name == "a":
            node.links = node.chars
    for node, done in _walk(root):
        if done or node.side:
            continue
        own = node.name in PARAGRAPHS
        loose = 0 if own else sum(len(k.strip()) for k in node.kids if isinstance(k, str)) if node.name in CONTAINERS else 0
        if not (own and node.chars) and not loose:
            continue
        chars, commas = (node.chars, node.commas) if own else (loose, sum(k.count(",") for k in node.kids if isinstance(k, str)))
        points = (1 + commas + min(chars / 100, 10)) * (1 - (node.links / node.chars if node.chars else 0))
        up, share = node.parent if own else node, 1.0
        while up is not None:
            if up.name in CONTAINERS or up.parent is None:
                up.points += points * share
                share *= 0.5
            up = up.parent


def _leave_worded(root: Node) -> None:
    """Marks what class words tell to leave out, but no element that holds the page's only article or main element, or, on a page without one outside, most of its text."""
    _measure(root)
    under: set[int] = set()  # elements below or at one with such a word
    articles: list[Node] = []
    for node, done in _walk(root):
        if done or node.side:
            continue
        if node.worded or node.parent is not None and id(node.parent) in under:
            under.add(id(node))
        if node.name in ("article", "main") and not node.worded and node.chars:
            articles.append(node)
    outside = any(id(a) not in under for a in articles)
    holds: set[int] = set()
    for up in articles:
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.parent
    total = root.chars - root.links
    for node, done in _walk(root):
        if not done:
            needed = not outside and (id(node) in holds or 2 * (node.chars - node.links) > total)
            node.side = node.side or node.parent is not None and node.parent.side or node.worded and not needed
    for node, done in _walk(root):
        if done:
            node.chars = node.commas = node.links = 0
            node.points = 0.0


def _density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def _score(node: Node) -> float:
    return node.points * (1 - _density(node))


def _chosen(root: Node) -> list[Node]:
    best = root
    for node, done in _walk(root):
        if not done and not node.side and node.name in CONTAINERS and node.chars and (best is root or _score(node) > _score(best)):
            best = node
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None and not up.side:
        best = up
    if best.parent is None:
        return [best]
    floor = SIBLING_SHARE * _score(best)
    kept = []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif isinstance(k, Node) and not k.side and k.chars:
            reads = k.name in CONTAINERS and k.points > 0 and _score(k) >= max(floor, 2)
            says = k.name in PARAGRAPHS and _density(k) < 0.25 and (best.name not in ("article", "main") or k.chars >= LONG_PARAGRAPH or k.name in ("h1", "h2"))
            if reads or says:
                kept.append(k)
    return kept


def _is_link_list(node: Node) -> bool:
    return node.name in ("ul", "ol", "table", "div", "section") and _density(node) > 0.7 and sum(isinstance(k, Node) for k in node.kids) >= 2


def _read(page: str, words: bool) -> tuple[str, bool]:
    """The text, and whether it is that of an article or main element."""
    root = parse(page)
    if words:
        _leave_worded(root)
    _measure(root)
    parts: list[str] = []
    chosen = _chosen(root)
    for top in chosen:
        of_page = top.parent is None or top.name == "body"  # the links of a whole page are menus, those of an article its sources
        stack: list[Node | str] = [top]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                parts.append(k)
            elif not k.side and not (of_page and k is not top and _is_link_list(k)):
                edge = k.name in BLOCKS
                if edge:
                    stack.append(" ")
                stack.extend(reversed(k.kids))
                if edge:
                    stack.append(" ")
    return " ".join("".join(parts).split()), any(k.name in ("article", "main") for k in chosen)


def main_text(page: str) -> str:
    """The main text of one page: blocks in page order, white space squeezed, joined by one space.

    If the words of classes leave no text, or less than a paragraph that is no article, they are not heeded.
    """
    text, article = _read(page, True)
    if not text or len(text) < LONG_PARAGRAPH and not article:
        more, _ = _read(page, False)
        return more if len(more) > len(text) else text
    return text


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) for every row of ``pages``.

    Null or empty html, or a page without main text, gives an empty text and 0.  Repeated rows give repeated rows, and every other
    column of the input is ignored.
    """
    kept = pages.select(*keep, whole(html_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return kept.mapInArrow(run, kept.schema).withColumn("n_chars", F.char_length("text").cast("long"))
