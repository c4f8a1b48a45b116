"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each paragraph passes points to its parent (whole),
grandparent (half) and further ancestors (a third, a quarter, ...): one, one for each comma and
one for each hundred characters up to ``MOST_LENGTH_POINTS``. A container's points are discounted by its
link density. The article or main element around the best container is kept, if the page has one; else
the container (or its article), and beside it and its ancestors all that is not mostly links. Boilerplate elements (navigation, headers, footers,
sidebars, notices, adverts, forms, comments), scripts and styles are parsed, so that the same tags end them, but their text is left out.

Names are weak evidence: an element left out for its class, id or role, or as a form, is taken back in where nearly all of the
page's text outside links lies in it (a page in one form, a layout named after its sidebar).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

MOST_LENGTH_POINTS = 3
MOST_LINKS = 0.5
#: An element is taken back in if it holds over so many times the text that is kept without it, and over so many characters; nested ones so often.
TAKE_BACK = 20
LEAST_TAKEN_BACK = 100
MOST_TAKEN_BACK = 16
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style textarea title iframe".split())
_SKIP = frozenset("nav header footer aside form button select head menu dialog fieldset noscript template svg object canvas".split()) | _RAW
#: Elements that are always left out.
_STRONG = _SKIP - {"form", "fieldset"}
_SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Parts of class names and ids that tell of something other than the article.
_SKIP_WORD = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs"
    " header masthead footer sidebar side rail widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup share sharing social related recommended comment comments commentlist disqus replies reply respond copyright legal"
    " pagination pager skip hidden toolbar".split()
)
#: Ways to write such a word together with others.
_COMPOUND = re.compile(
    r"(?:site|page|main|top|left|right|bottom|global|mobile)(?:header|footer|menu|nav|navbar|navigation|sidebar|banner)|(?:top|bottom)bar|sub(?:menu|nav)"
    r"|(?:cookies?|consent|gdpr|newsletter|ads?|adverts?|promo|sponsor|share|sharing|social|comments?|nav|menu|search|login|header|footer)"
    r"(?:bar|box|banner|popup|notice|widget|modal|overlay|wrap|wrapper|panel|list|form|area|section|block|unit|slot|links|buttons|feed)"
)
#: Names that say of a layout what it has or how it stands, not what it is; the latter only beside a name of a layout.
_MODIFIER = re.compile(r"(?:with|without|has|no|hide|show|is)[-_].+|.+[-_](?:open|opened|closed|enabled|disabled|on|off|active|visible|collapsed|expanded)", re.I)
_PLACED = re.compile(r"(?:left|right|two|double|both)[-_]?\w+|\w+[-_](?:left|right)", re.I)
_LAYOUT = re.compile(r"(?:\w+[-_])?(?:layout|container|wrapper|wrap|page|grid|row|columns?|site)|(?:post|page|entry|article)-\d+|hentry", re.I)
#: Names of what is never the article, however long.
_NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup"
    " share sharing social related recommended comment comments commentlist disqus replies reply respond copyright legal breadcrumb breadcrumbs pagination pager".split()
)
#: A whole class name or id that names the article's body.
_BODY_NAME = re.compile(r"(?:(?:main|page|site|post|entry|story|article|news|blog|body)[-_]*)?(?:article|main|content|body|post|entry|story|text)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PARAGRAPH = frozenset("p pre blockquote li td dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
_SPECIAL = _BLOCK | _SKIP
#: What the start tag of an element ends, up to the innermost list or table.
_CLOSED_BY: dict[str, frozenset[str]] = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    **dict.fromkeys(["tbody", "thead", "tfoot"], frozenset(["tr", "td", "th", "tbody", "thead", "tfoot"])),
}
_LISTS = frozenset("ul ol dl table".split())
_TABLES = frozenset("table template object svg".split())
_CELLS = frozenset("td th caption table".split())
_OF_TABLE = frozenset("table caption td th tr tbody thead tfoot".split())
#: What the end tag of a block does not lead out of, within skipped elements; others: ``_CELLS``.
_LIMITS: dict[str, frozenset[str]] = {
    "body": frozenset(), "html": frozenset(), "li": _CELLS | {"ul", "ol"}, "p": _CELLS | {"button"}, **dict.fromkeys(_OF_TABLE, frozenset(["table"])),
}
_OF_HEAD = frozenset("head title base link meta style script noscript template".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(\s*>)?", re.S)
#: A name and a value in a start tag; a quote that nothing closes is part of an unquoted value.
_ATTR = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "dropped", "special", "items", "points", "chars", "link_chars", "place")

    def __init__(self, tag: str, parent: Node | None, skipped: bool = False):
        self.tag, self.parent = tag, parent
        #: The outermost skipped element that this one is or lies in.
        self.dropped: Node | None = parent and parent.dropped or (self if skipped else None)
        #: The innermost element that is not an inline one: this one or one around it.
        self.special: Node = self if parent is None or tag in _SPECIAL else parent.special
        self.items: list[Node | str] = []
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        #: Where the start tag ends, of an element that may be taken back in.
        self.place = 0


def _named_otherwise(value: str) -> bool:
    """Whether a class or id names something other than the article: a name does that has one of the words among its
    parts, unless another one of the names is a name of the article's body."""
    names = [n for n in value.split() if not _MODIFIER.fullmatch(n)]
    if any(_LAYOUT.fullmatch(n) for n in names):
        names = [n for n in names if not _PLACED.fullmatch(n)]
    parts = [{x.lower() for x in _PART.findall(n)} for n in names]
    odd = [n for n, p in zip(names, parts, strict=True) if p & _SKIP_WORD or any(map(_COMPOUND.fullmatch, p))]
    return bool(odd) and (any(n.lower() in _SKIP_WORD for n in odd) or not any(_BODY_NAME.fullmatch(n) for n in names))


def _skipped(tag: str, attributes: list[tuple[str, str]]) -> bool:
    if tag in _SKIP:
        return True
    for name, value in attributes:
        if name == "hidden":
            return True
        if tag in ("html", "body", "article", "main"):
            continue
        if name in ("class", "id") and _named_otherwise(value):
            return True
        if name == "role" and value.lower() in _SKIP_ROLE or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(k == "hidden" or k == "style" and _HIDDEN.search(v) or k == "aria-hidden" and v.lower() == "true" for k, v in attributes)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Names and values from behind a tag's name, whether it closes itself, and where it ends (without an end: the page)."""
    found: list[tuple[str, str]] = []
    while at < len(page):
        part = _ATTR.match(page, at)
        name, double, single, plain = part.groups()
        if name:
            found.append((name.lower(), html.unescape(double or single or plain or "")))
        at = part.end()
        if page[at : at + 1] == ">":
            return found, page[at - 1] == "/" and not plain, at + 1
        if part.end() == part.start():
            at += 1
    return found, False, at


class _Tree:
    """The tree as it grows. ``open`` counts the open elements by tag, so that an end tag without one costs no search."""

    def __init__(self):
        self.root = self.node = Node("html", None)
        self.open: Counter[str] = Counter()
        #: Characters outside links that are kept, and the elements that were left out for a name or as a form.
        self.kept = 0
        self.weak: list[Node] = []

    def count(self, text: str) -> None:
        if self.open["a"]:
            return
        top = self.node.dropped
        if top is None:
            self.kept += len(text) - text.count(" ") // 2 if not text.isspace() else 0
        elif top.place and not any(self.open[x] for x in _STRONG):
            top.chars += len(text) - text.count(" ") // 2 if not text.isspace() else 0

    def leave(self, to: Node) -> None:
        """Close what lies within ``to``."""
        while self.node is not to:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent

    def enter(self, child: Node) -> None:
        self.open[child.tag] += 1
        self.node = child

    def end(self, tag: str) -> None:
        """An end tag ends what is open within its element, and is ignored where none is open.

        Out of a skipped element it leads by the rules of HTML: inline end tags end no block, those of blocks no cell
        around them, that of an item no list.
        """
        node = self.node
        if not self.open[tag]:
            if node.dropped and tag == "body":
                self.leave(node.dropped.parent)
            return
        limits = _LIMITS.get(tag, _CELLS) if tag in _SPECIAL else _SPECIAL
        up = node
        while up.tag != tag or up.parent is None:
            if up.dropped and up.tag in limits:
                return
            up = up.parent
        self.leave(up.parent)

    def begin(self, tag: str) -> None:
        """Before an element opens: what its start tag ends."""
        top = self.node.dropped
        if top and (tag == "body" or top.tag == "head" and (tag in ("article", "main") or self.node is top and tag not in _OF_HEAD)):
            self.leave(top.parent)
        if tag not in _BLOCK:
            return
        if self.node.special.tag == "p" and self.node.special.parent is not None:  # with the inline elements left open in it
            self.leave(self.node.special.parent)
        closes = _CLOSED_BY.get(tag, frozenset())
        if not any(self.open[x] for x in closes):
            return
        stops = _TABLES if tag in _OF_TABLE else _LISTS
        up, to = self.node, self.node
        while up.parent is not None and up.tag not in stops:
            if up.tag in closes:
                to = up.parent
            elif up.dropped and tag not in _OF_TABLE and up.tag in _SPECIAL and up.tag not in ("address", "div", "p"):
                break
            up = up.parent
        self.leave(to)


def parse(page: str) -> Node:
    """The tree of a page; tags may be unclosed or crossed. Skipped elements are parsed like others, so that
    the same tags end them, but hang in no list of items, unless nearly all text lies in one of them."""
    taken_back: set[int] = set()
    while True:
        tree = _parsed(page, taken_back)
        largest = max(tree.weak, key=lambda n: n.chars, default=None)
        if largest is None or largest.chars <= max(LEAST_TAKEN_BACK, TAKE_BACK * tree.kept) or len(taken_back) == MOST_TAKEN_BACK:
            return tree.root
        taken_back.add(largest.place)


def _parsed(page: str, taken_back: set[int]) -> _Tree:
    tree = _Tree()
    at, end = 0, len(page)
    raw: str | None = None
    while at < end:
        if raw:  # up to the end tag, whatever stands between
            close = re.compile(rf"</{raw}\b", re.I).search(page, at)
            if not close:
                break
            at, raw = close.start(), None
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            tree.count(page[at:stop])
            if not tree.node.dropped:
                tree.node.items.append(page[at:stop])
        if not token:
            break
        at = token.end()
        tag = token[2] and token[2].lower()
        if not tag:
            continue
        attributes, closed = [], False
        if not token[3]:
            attributes, closed, at = _attributes(page, at)
        if token[1]:
            tree.end(tag)
            continue
        if tag in _VOID:
            if tree.node.dropped:
                tree.begin(tag)
            if not tree.node.dropped:
                tree.node.items.append(" " if tag in ("br", "wbr", "img") else Node(tag, tree.node))
            continue
        tree.begin(tag)
        node = tree.node
        place = token.end()
        child = Node(tag, node, node.dropped is None and place not in taken_back and _skipped(tag, attributes))
        if child.dropped is child and tag not in _STRONG and not _hidden(attributes):
            if not any(_NEVER & {x.lower() for x in _PART.findall(v)} for k, v in attributes if k in ("class", "id")):
                child.place = place
                tree.weak.append(child)
        if not child.dropped:
            node.items.append(child)
        if not closed or tag in _BLOCK and not child.dropped:
            tree.enter(child)
            raw = tag if tag in _RAW else None
    return tree


def blocks(node: Node) -> list[str]:
    """Texts of a subtree, block by block: character references decoded, white space made one blank, trimmed."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _BLANK.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, i = stack.pop()
        block = at.tag in _BLOCK
        if i == 0 and block:
            flush()
        while i < len(at.items):
            item = at.items[i]
            i += 1
            if isinstance(item, str):
                run.append(item)
            else:
                stack.append((at, i))
                stack.append((item, 0))
                break
        else:
            if block:
                flush()
    flush()
    return out


def _walk(root: Node) -> list[Node]:
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [x for x in reversed(node.items) if not isinstance(x, str)]
    return nodes


def _score(nodes: list[Node]) -> None:
    """Points of all containers; ``chars`` and ``link_chars`` of all nodes."""
    commas: dict[int, int] = {}
    for node in reversed(nodes):  # children before parents
        own = "".join(x for x in node.items if isinstance(x, str))
        node.chars += len(own) - own.count(" ") // 2
        commas[id(node)] = commas.get(id(node), 0) + own.count(",") + own.count("、") + own.count("，")
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            if node.tag not in _BLOCK:
                commas[id(node.parent)] = commas.get(id(node.parent), 0) + commas[id(node)]
    for node in nodes:
        text = node.tag in _PARAGRAPH or node.tag in _BLOCK and any(isinstance(x, str) and len(x.strip()) > 25 for x in node.items)
        if not text or node.chars < 3:
            continue
        points = (1 + commas[id(node)] + min(node.chars / 100, MOST_LENGTH_POINTS)) * (1 - node.link_chars / max(1, node.chars))
        if node.tag not in _PARAGRAPH:
            node.points += points
        share, up = 1.0, node.parent
        for level in range(2, 7):
            if up is None:
                break
            if up.tag in _BLOCK:
                up.points += points * share
                share = 1 / level
            up = up.parent


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by a line feed; empty for null, empty or textless pages."""
    if not page:
        return ""
    root = parse(page)
    nodes = _walk(root)
    _score(nodes)
    final = lambda n: n.points * (1 - n.link_chars / max(1, n.chars)) + (25 if n.tag in ("article", "main") else 0)
    containers = [n for n in nodes if n.points > 0]
    if not containers:
        return "\n".join(blocks(root))
    best = max(containers, key=final)
    count = Counter(n.tag for n in nodes)
    around = [best]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    holders = [n for n in around if n.tag in ("article", "main")]
    if holders and count["article"] <= 1 and count[holders[-1].tag] == 1:
        return "\n".join(blocks(holders[-1]))
    inner = next((n for n in reversed(around) if n.tag == "article"), best)
    outer = next((n for n in around if n.tag == "main" and count["main"] == 1), root)
    before, behind = [], []
    node = inner
    while node is not outer and node.parent is not None:
        parent = node.parent
        at = next(i for i, x in enumerate(parent.items) if x is node)
        before.append(_beside(parent.items[:at]))
        behind.append(_beside(parent.items[at + 1 :]))
        node = parent
    return "\n".join(x for part in (*before[::-1], blocks(inner), *behind) for x in part)


def _beside(items: list[Node | str]) -> list[str]:
    """Blocks of the siblings that are not mostly links. Bare text and inline elements in a row are one sibling."""
    out: list[str] = []
    for block, group in groupby(items, key=lambda x: not isinstance(x, str) and x.tag in _BLOCK):
        part = list(group)
        for run in [[x] for x in part] if block else [part]:
            chars = sum(len(x) - x.count(" ") // 2 if isinstance(x, str) else x.chars for x in run)
            if sum(0 if isinstance(x, str) else x.link_chars for x in run) < MOST_LINKS * chars:
                whole = Node("div", None)
                whole.items = run
                out += blocks(whole)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; repeated rows repeat, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 8 << 20):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
