"""Main text of web pages by tree scoring.

A page is parsed into a tree. Every paragraph-like block gives points for its length
and commas to its parent and, halved, to its grandparent; a container's points are
discounted by its share of linked text and adjusted by the wording of its class and id.
The best container and the siblings that score or read like it are kept; blocks of
menus, headers, footers, sidebars, notices, adverts, forms and comments are left out
by tag, role and wording before and inside it, but wording alone removes no element that
holds an article or most of a page's text. Time is linear in a page's length and nesting.

Pages are independent: one pass without a shuffle.

Defined results: a null or empty page, or one without prose, gives ""; malformed mark-up
is read as browsers do in the plain cases (unclosed p, li, b; stray end tags; an open tag
or comment at the end); repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.shipping import ship

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp".split())
DROPPED = frozenset(
    "script style noscript template textarea iframe svg math object canvas nav footer aside form button "
    "select dialog menu head title input label fieldset audio video map".split()
)
BLOCK = frozenset(
    "p div section article main header footer aside nav ul ol li dl dt dd table tr td th thead tbody "
    "tfoot caption blockquote pre h1 h2 h3 h4 h5 h6 form fieldset figure figcaption address hr body html "
    "details summary center".split()
)
ENDS_P = BLOCK - frozenset(("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "body", "html"))
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "thead", "tbody", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
# Words in class, id or role that name what is not the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|breadcrumb\w*|combx|comment\w*|community|cookie\w*|consent\w*|"
    r"disqus|disclaimer|extra|foot|footer\w*|gdpr|header|hidden|legends|masthead|menu\w*|modal|nav\w*|newsletter\w*|notice\w*|"
    r"overlay|pager|pagination|popup\w*|promo\w*|related\w*|remark|replies|respond|rss|share\w*|shoutbox|"
    r"sidebar\w*|side|skyscraper|social\w*|sponsor\w*|subscribe\w*|tags|toolbar|topbar|widget\w*|banner|complementary|"
    r"contentinfo|navigation|search|alert|dialog)(?:$|[\s_-])",
    re.I,
)
# names of such a part as a whole, beside single words of the list above
WHOLE = re.compile(
    r"comments?[-_](?:list|area|section|thread|wrapper|container|body)|commentlist|site-footer|related[-_](?:posts|articles|stories)",
    re.I,
)
# wording such as "main-header content" or "entry-header" names the article's own parts
OWN = re.compile(
    r"\b(?:article|main|content|entry|post)[\w-]*(?:body|text|content)\b|"
    r"\b(?:article|content|entry|post|story|single)[-_]{1,2}(?:header|head)\b",
    re.I,
)
#: Share of a page's unlinked text above which wording alone does not remove an element, and
#: the share that must stand beside an element whose whole name says what it is.
MOST, LEAST = 0.3, 0.2
LIKELY = re.compile(r"article|body|content|entry|hentry|main|post|story|text|blog", re.I)

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END_OF = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "named", "parent", "inside", "score", "gone")

    def __init__(self, tag: str, parent: Node | None, named: str = "", gone: bool = False):
        self.tag, self.parent, self.named, self.gone = tag, parent, named, gone
        self.inside: list[Node | str] = []
        self.score = 0.0


class _Open:
    """The open elements from the root down; where each tag stands, so that no step walks up."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {root.tag: [0]}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)

    def last(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[-1] if places else -1

    def close(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def end(self, name: str) -> None:
        at = self.last(name)
        # an end tag inside a table does not reach beyond it
        if at > 0 and (at >= self.last("table") or name in ("body", "html")):
            self.close(at)

    def start(self, name: str) -> None:
        """Close what the start of such an element ends."""
        if name in ENDS_P and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if name in CLOSES:
            ended, within = CLOSES[name]
            scope = max(map(self.last, within))
            ends = []
            for tag in ended.split():
                places = self.where.get(tag, [])
                k = bisect_right(places, scope)
                if k < len(places):
                    ends.append(places[k])
            if ends:
                self.close(min(ends))


def parse(page: str) -> Node:
    """The tree of a page; what scripts, styles and comments hold is skipped."""
    root = Node("html", None)
    open_ = _Open(root)
    at, end = 0, len(page)
    while at < end:
        node = open_.stack[-1]
        m = _TAG.search(page, at)
        if m is None:
            node.inside.append(page[at:])
            break
        if m.start() > at:
            node.inside.append(page[at : m.start()])
        at = m.end()
        slash, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if slash:
            open_.end(name)
            continue
        if name in ("html", "body") and node is root:
            continue
        open_.start(name)
        node = open_.stack[-1]
        named, gone = "", name in DROPPED
        if rest and not rest.isspace():
            for key, value in _NAMED.findall(rest):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    named += " " + value
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    gone = True
                elif key == "style" and _HIDES.search(value):
                    gone = True
        new = Node(name, node, named, gone)
        node.inside.append(new)
        if name in RAW:
            stop = _END_OF[name].search(page, at)
            if stop is None:
                # an unclosed script hides the rest, as in browsers
                at = end
            else:
                close = page.find(">", stop.end())
                at = end if close < 0 else close + 1
        elif name not in VOID and (name in BLOCK or not rest.endswith("/")):
            open_.push(new)
    return root


def _keep(node: Node, wanted: Callable[[Node, Node], bool]) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.inside = [c for c in n.inside if isinstance(c, str) or wanted(n, c)]
        stack.extend(c for c in n.inside if not isinstance(c, str))


def _prune(root: Node) -> None:
    """Leave out what tags, styles and wording name as no part of the article.

    Wording alone decides only about parts: what holds an article or a large share of the
    page's unlinked text is a wrapper whatever it is called, unless its whole name is that of
    a comment section, menu or the like and enough text stands beside it.
    """
    _keep(root, lambda _n, c: not c.gone)
    size = _measure(root)
    free = {k: chars - linked for k, (chars, linked, _) in size.items()}
    holds = {id(n) for n in _walk(root) if n.tag in ("article", "main") and free[id(n)]}
    marked = bool(holds)  # the page says where its article is
    for n in _walk(root):
        if id(n) in holds and n.parent is not None:
            holds.add(id(n.parent))
    page = max(free[id(root)], 1)
    inside: set[int] = set()  # nodes inside an article's own elements or wording

    def wanted(parent: Node, node: Node) -> bool:
        within = id(parent) in inside
        if within or node.tag in ("article", "main", "section") or node.named and LIKELY.search(node.named):
            inside.add(id(node))
        if node.tag in ("article", "main", "html", "body"):
            return True
        share = free[id(node)] / page
        if node.tag == "header":
            # a page's header, not an article's, unless it holds the article
            return within or id(node) in holds or share > MOST and not marked
        if not node.named or not UNLIKELY.search(node.named) or OWN.search(node.named):
            return True
        if id(node) in holds:
            return True
        if share <= MOST or marked and not within:
            return False
        return share > 1 - LEAST or not any(WHOLE.fullmatch(w) or UNLIKELY.fullmatch(w) for w in node.named.split())

    _keep(root, wanted)


def _walk(node: Node) -> Iterator[Node]:
    """Children before parents."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.inside if not isinstance(c, str))
    return reversed(order)


def _measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """For each node: characters, characters inside links, commas of all its text."""
    found: dict[int, tuple[int, int, int]] = {}
    for n in _walk(root):
        chars = linked = commas = 0
        for c in n.inside:
            if isinstance(c, str):
                chars += len(c.strip())
                commas += c.count(",") + c.count("，") + c.count("、")
            else:
                a, b, k = found[id(c)]
                chars, linked, commas = chars + a, linked + b, commas + k
        found[id(n)] = (chars, chars if n.tag == "a" else linked, commas)
    return found


def _own_text(node: Node, size: dict) -> tuple[int, int]:
    """Characters and commas of a block's own text: its strings and inline children."""
    chars = commas = 0
    for c in node.inside:
        if isinstance(c, str):
            chars += len(c.strip())
            commas += c.count(",")
        elif c.tag not in BLOCK:
            chars += size[id(c)][0]
            commas += size[id(c)][2]
    return chars, commas


def best_nodes(root: Node) -> list[Node]:
    """The container with the most points and those of its siblings that belong to it."""
    size = _measure(root)
    scored: dict[int, Node] = {}
    for n in _walk(root):
        if n.tag not in BLOCK and n is not root:
            continue
        chars, commas = _own_text(n, size)
        if chars < 25:
            continue
        points = 1 + commas + min(chars // 100, 3)
        # text that lies in a container itself counts for it like a paragraph of its own
        to = n.parent if n.tag in ("p", "li", "pre", "blockquote", "td", "dd", "h1", "h2", "h3") and n.parent else n
        for share in (1.0, 0.5):
            if to is None:
                break
            to.score += points * share
            scored[id(to)] = to
            to = to.parent
    if not scored:
        return [root] if size[id(root)][0] else []
    for n in scored.values():
        chars, linked, _ = size[id(n)]
        if n.tag == "article" or n.tag == "main":
            n.score += 25
        elif n.tag == "div":
            n.score += 5
        if n.named and LIKELY.search(n.named):
            n.score += 25
        n.score *= 1 - linked / max(chars, 1)
    top = max(scored.values(), key=lambda n: n.score)
    # one of several equal parts of an article: its container holds the text
    while top.parent is not None and top.tag not in ("article", "main", "body", "html"):
        twins = [c for c in top.parent.inside if not isinstance(c, str) and c.score >= 0.75 * top.score]
        if len(twins) >= 3 or top.parent.tag in ("article", "main"):
            top = top.parent
        else:
            break
    if top.parent is None:
        return [top]
    least = max(10.0, 0.2 * top.score)
    kept = []
    for c in top.parent.inside:
        if isinstance(c, str):
            continue
        chars, linked, commas = size[id(c)]
        density = linked / max(chars, 1)
        if c is top or c.score >= least and c.tag not in ("ul", "ol"):
            kept.append(c)
        elif c.tag in ("h1", "h2") and kept == [] and chars and density < 0.33:
            kept.append(c)
        elif c.tag == "p" and (chars > 80 and density < 0.25 or chars and density == 0 and commas):
            kept.append(c)
    return kept


def _blocks(nodes: list[Node]) -> list[str]:
    """Text of the nodes' blocks in page order, white space made one space."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = _WHITE.sub(" ", _html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            n = stack.pop()
            if n is None:
                close()
            elif isinstance(n, str):
                now.append(n)
            elif n.tag == "br":
                now.append(" ")
            else:
                block = n.tag in BLOCK
                if block:
                    close()
                    stack.append(None)
                stack.extend(reversed(n.inside))
        close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by new lines."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    return "\n".join(_blocks(best_nodes(root)))


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)

    @lean
    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                [id_col, url_col, "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(
        run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint"
    )
