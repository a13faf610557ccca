"""Main text of web pages by scoring the element tree.

A lenient reader builds the tree: void elements, raw text of scripts, implied ends of paragraphs, list items and cells,
unclosed inline elements. Subtrees that are no content by their kind (menus, forms, scripts) or by the words of
their class, id or role (advert, cookie, sidebar, comments) are left out. Every paragraph passes points for its length
and its commas to its ancestors: all to the parent, half to the next, then a sixth, an eighth and so on. An
element's points are discounted by the share of its text that is link text. The element with most points is the best
container; siblings that score well beside it are kept with it. All blocks of what is kept come out, long or short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at the element's own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open paragraph ends where one of these starts.
ENDS_PARAGRAPH = BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot".split()) | {"dd", "dt", "li"}
#: Opening one of these ends the open one of the second column, up to the border of the third.
CELLS = frozenset(("td", "th"))
ROWS = frozenset(("tbody", "thead", "tfoot"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (CELLS, frozenset(("table",))),
    "th": (CELLS, frozenset(("table",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "tbody": (ROWS, frozenset(("table",))),
    "thead": (ROWS, frozenset(("table",))),
    "tfoot": (ROWS, frozenset(("table",))),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of a main text. Headings inside an article's own header stay.
NO_CONTENT = frozenset(
    "head script style noscript template iframe object embed nav aside footer form button select textarea input datalist dialog menu search "
    "noembed noframes canvas audio video svg math map xmp title".split()
)
#: Words in class or id that mark no content, and words that mark content.
MARKS_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "footer header masthead toolbar comment comments disqus respond reply replies related recommended recommendations share sharing social follow "
    "newsletter subscribe subscription signup login search tags tagcloud toc skip print hidden copyright disclaimer legal paywall teaser outbrain taboola".split()
)
#: Beside these a noise word says what the element holds among others ("content with-sidebar").
MARKS_LAYOUT = frozenset("with has without no".split())
MARKS_CONTENT = frozenset("article body content entry main page post story text blog".split())
NO_CONTENT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
#: Prior points of an element by its kind, and of one whose class or id has a word of either list.
PRIOR = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0} | dict.fromkeys(
    "address ol ul dl dd dt li".split(), -3.0) | dict.fromkeys([*HEADINGS, "th"], -5.0)
CLASS_POINTS = 25.0
#: Elements whose own text is a paragraph that passes points on.
PARAGRAPHS = frozenset("p pre td blockquote li dd".split()) | HEADINGS
#: Ancestors that a paragraph passes points to; beyond, they would be below a ninetieth.
LEVELS = 32
#: A sibling stays from this share of the best container's points, five at least, or as a long paragraph with few links.
SIBLING_SHARE = 0.2
SIBLING_LEAST = 5.0
SIBLING_CHARS = 80
SIBLING_LINKS = 0.25
#: Kinds that hold a whole article; beside them only their own kind and long paragraphs stay.
WHOLE = frozenset(("article", "main"))
#: A list is a menu if links make up more of its text than this and it has two or more of them.
MENU_LINKS = 0.7

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)", re.S)  # fmt: skip
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its name, parent, children (elements and texts in order) and what its attributes say."""

    __slots__ = ("name", "parent", "children", "noise", "bonus", "points", "chars", "linked", "links")

    def __init__(self, name: str, parent: Node | None, noise: bool = False, bonus: float = 0.0):
        self.name, self.parent, self.noise, self.bonus = name, parent, noise, bonus
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0


def judged(name: str, attributes: str) -> tuple[bool, float]:
    """(whether kind or attributes mark no content, prior points) of an element."""
    noise, points = name in NO_CONTENT, PRIOR.get(name, 0.0)
    if not attributes or attributes.isspace() or attributes == "/":
        return noise, points
    words: set[str] = set()
    for match in _ATTRIBUTE.finditer(attributes):
        key = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if key in ("class", "id"):
            words.update(x.lower() for x in _NAME_PARTS.findall(unescape(value)))
        elif key == "role":
            noise |= value.strip().lower() in NO_CONTENT_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            noise = True
    if words and name not in ("html", "body"):
        content = bool(words & MARKS_CONTENT)
        noise |= bool(words & MARKS_NOISE) and not words & MARKS_LAYOUT and not (content and name in WHOLE)
        points += CLASS_POINTS * content
    return noise, points


def parse(html: str) -> Node:
    """The tree of a page, whatever its mistakes. Only the stack of open elements is searched, never the whole tree."""
    root = node = Node("#root", None)
    count: Counter[str] = Counter()
    at, size = 0, len(html)

    def pop_to(target: Node) -> Node:
        nonlocal node
        while True:
            count[node.name] -= 1
            if node is target:
                node = node.parent
                return node
            node = node.parent

    def nearest(names: frozenset[str], border: frozenset[str]) -> Node | None:
        if not any(count[x] for x in names):
            return None
        found = node
        while found is not root:
            if found.name in names:
                return found
            if found.name in border:
                return None
            found = found.parent
        return None

    cell_border = CELLS | {"table", "caption", "button", "object"}
    while at < size:
        match = _TOKEN.search(html, at)
        if match is None:
            node.children.append(unescape(html[at:]))
            break
        if match.start() > at:
            node.children.append(unescape(html[at : match.start()]))
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                node.children.append(match[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if match[1]:
            if name in HEADINGS:
                found = nearest(HEADINGS, cell_border)
            else:
                # An inline end tag does not reach beyond the block it stands in.
                found = nearest(frozenset((name,)), cell_border - {name} if name in BLOCK and name not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot")
                                else frozenset() if name in BLOCK else BLOCK)
            if found is not None:
                pop_to(found)
            elif name == "br":
                node.children.append(Node("br", node))
            continue
        if name in ("html", "body") and count[name]:
            continue
        if name in ENDS_PARAGRAPH and (found := nearest(frozenset(("p",)), cell_border)) is not None:
            pop_to(found)
        if name in IMPLIED and (found := nearest(*IMPLIED[name])) is not None:
            pop_to(found)
        if name in ("tr", "tbody", "thead", "tfoot") and (found := nearest(frozenset(("tr",)), frozenset(("table",)))) is not None:
            pop_to(found)
        if name in HEADINGS and node.name in HEADINGS:
            pop_to(node)
        if name == "body" and (found := nearest(frozenset(("head",)), frozenset())) is not None:
            pop_to(found)
        if name == "a" and (found := nearest(frozenset(("a",)), cell_border)) is not None:
            pop_to(found)
        child = Node(name, node, *judged(name, match[3]))
        node.children.append(child)
        if name in VOID or (match[3].endswith("/") and name in ("svg", "math", "path")):
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            if name in ("textarea", "title"):
                child.children.append(unescape(html[at : end.start() if end else size]))
            at = end.end() if end else size
            continue
        node = child
        count[name] += 1
    return root


def elements(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element of the tree that is not left out, before its children (False) and again after them (True)."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        yield node, done
        if not done:
            stack.append((node, True))
            stack.extend((x, False) for x in reversed(node.children) if isinstance(x, Node) and not x.noise)


def spare_headers(root: Node) -> None:
    """Page headers go; of a header inside an article or main element its headings stay."""
    for node, done in elements(root):
        if done or node.name != "header":
            continue
        above = node.parent
        while above is not None and above.name not in ("article", "main"):
            above = above.parent
        if above is None:
            node.noise = True
        else:
            for child in node.children:
                if isinstance(child, Node) and child.name not in HEADINGS and child.name != "hgroup":
                    child.noise = True


def link_density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def score(root: Node) -> list[Node]:
    """Give every kept element its characters, link characters and points; the list has those that can be containers."""
    found = []
    for node, done in elements(root):
        if not done:
            continue
        node.chars = sum(len("".join(x.split())) + x.count(" ") if isinstance(x, str) else 0 if x.noise else x.chars for x in node.children)
        inner = [x for x in node.children if isinstance(x, Node) and not x.noise]
        node.linked = node.chars if node.name == "a" else sum(x.linked for x in inner)
        node.links = sum(x.links for x in inner) + (node.name == "a")
        if node.name in ("ul", "ol", "dl") and node.links > 1 and link_density(node) > MENU_LINKS:
            node.noise = True
            continue
        if node.name in BLOCK and node.name not in HEADINGS and node.name not in ("p", "html", "hr", "tr", "tbody", "thead", "tfoot"):
            found.append(node)
    kept = set()
    for node, done in elements(root):
        if done:
            continue
        kept.add(id(node))
        own = [x for x in node.children if isinstance(x, str)]
        inline = [x for x in node.children if isinstance(x, Node) and not x.noise and x.name not in BLOCK]
        if node.name not in PARAGRAPHS and not (node.name in BLOCK and any(not x.isspace() for x in own)):
            continue
        text = "".join(own) + "".join(_inline_text(x) for x in inline)
        length = len(" ".join(text.split()))
        if not length:
            continue
        commas = sum(map(text.count, ",،、，"))
        points = (1.0 if length >= 25 else 0.0) + commas + min(length / 100, 3.0)
        points *= 1 - min(1.0, sum(x.linked for x in inline) / max(length, 1))
        # A paragraph passes all to its parent; free text of a container is the container's own.
        above, level = (node.parent if node.name in PARAGRAPHS else node), 0
        while above is not None and level < LEVELS:
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1
    found = [x for x in found if id(x) in kept and x.chars]
    for node in found:
        # The discount takes points away, so it leaves a prior below nought as it is.
        total = node.points + node.bonus
        node.points = total * (1 - link_density(node)) if total > 0 else total
    return found


def _inline_text(node: Node) -> str:
    """Text of an inline element up to the blocks in it."""
    parts, stack = [], [node]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            parts.append(top)
        elif top.name == "br":
            parts.append(" ")
        elif not top.noise and top.name not in BLOCK:
            stack.extend(reversed(top.children))
    return "".join(parts)


def kept_parts(root: Node) -> list[Node]:
    """The best container and the siblings that are kept with it, in page order; empty if the page has no text."""
    spare_headers(root)
    places = score(root)
    if not places:
        return [root]
    best = places[0]
    for node in places[1:]:
        # Of equal points the inner one, which comes first, since it leaves out less of nothing.
        if node.points > best.points:
            best = node
    if best.parent is None:
        return [best]
    limit = max(SIBLING_LEAST, SIBLING_SHARE * best.points)
    scored = {id(x) for x in places}
    found = []
    for node in best.parent.children:
        if node is best:
            found.append(best)
        elif isinstance(node, Node) and not node.noise and node.name not in HEADINGS:
            well = id(node) in scored and node.points >= limit and (best.name not in WHOLE or node.name == best.name)
            long = node.name == "p" and node.chars > SIBLING_CHARS and link_density(node) < SIBLING_LINKS
            if well or long:
                found.append(node)
    return found


def blocks(parts: list[Node]) -> list[str]:
    """Texts of the blocks in page order: white space as one space, trimmed, empty ones left out."""
    found: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            found.append(text)

    for part in parts:
        stack: list[Node | str | None] = [part]
        while stack:
            top = stack.pop()
            if top is None:
                close()
            elif isinstance(top, str):
                run.append(top)
            elif top.name == "br":
                run.append(" ")
            elif not top.noise:
                if top.name in BLOCK:
                    close()
                    stack.append(None)
                stack.extend(reversed(top.children))
        close()
    return found


def main_text(html: str | None) -> str:
    """Main text of a page, its blocks joined by line ends; empty for NULL, an empty page or one without text."""
    return "\n".join(blocks(kept_parts(parse(html)))) if html else ""


def text_column(html: str = "html") -> Column:
    """Main text of each row's page; NULL counts as an empty page."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return extract(F.col(html))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, repeated rows included.

    Whole pages, row by row; nothing is shuffled. NULL or empty pages have an empty text, NULL ids and urls stay NULL, extra
    columns play no part, and no rows give no rows.
    """
    found = pages.select("page_id", "url", text_column().alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
