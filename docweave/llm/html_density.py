"""Main text of web pages by composite text density (operator 3).

For every node of the page's tree: C characters and T tags below it, LC characters and LT
tags inside links. Composite text density is

    C / T * log(C / T * C / LC * T / LT) / log(log-base),   base = ln(C / NLC * LC + LC_b / C_b * C + e)

(counts of 0 in a denominator are 1, NLC = C - LC, _b: of the body), so link-rich subtrees
score low. Densities of a node's children add up to its density sum. The node with the
largest density sum is found; the least density on its path to the body is the threshold;
subtrees at or above it give as main text their largest-density-sum part and, beside it,
what else in them is at or above the threshold.

Parts that a page marks as not being text of the article (navigation, footers, asides,
forms, scripts, adverts, cookie notices, comments and so on, by tag, role or class) are
left out before densities are taken. A class or id alone does not leave out a subtree that
holds the article (``_unskip``), and words on layout (has-sidebar, comments-open) mark none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu head".split()) | RAW
SOFT_TAGS = frozenset("nav aside form dialog".split())  # boilerplate unless they wrap the page's article
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
_BOILERPLATE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|site-header|page-header|widget|related|recommend\w*|share|sharing|"
    r"social|comments?|comment-list|disqus|replies|reply|login|signup|search)(?:$|[\s_-])", re.I)
_REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|comment-list|disqus|replies|reply)(?:$|[\s_-])", re.I)
_COMMENTS = re.compile(r"(?:^|[\s#_-])(?:comments|comment-list|disqus|replies)(?:$|[\s_-])", re.I)
RUNNING_TEXT = 80  # characters outside links of a section of running text, at least
# words on the state or layout of a page, not on what the element holds: has-sidebar, comments-open, search-page
_LAYOUT_WORD = re.compile(
    r"(?<!\S)(?:(?:has|no|with|without|js)[_-]\S*|\S*[_-](?:open|closed|enabled|disabled|ready|page|layout))(?!\S)", re.I)
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()) | BOILERPLATE_TAGS
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# a start tag of the first kind ends open elements of the second (their end tags are optional)
_CLOSES_P = BLOCK - {"body", "html", "head"} - RAW - {"button"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "body": {"head"}}
_SCOPE = frozenset("table ul ol dl div article section main body html td th blockquote aside nav footer header form".split())
_NO_SCOPE = {tag: _SCOPE - tags if tag != "body" else frozenset() for tag, tags in _CLOSES.items()}
_BLOCKS = BLOCK - {"p"}
_HARD_TAGS = BOILERPLATE_TAGS - SOFT_TAGS
_SPACE = re.compile(r"[\s]+")


class Node:
    __slots__ = ("tag", "children", "skip", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, skip: bool, named: str = "") -> None:
        self.tag, self.skip, self.named = tag, skip or bool(named), named  # named: skipped by its class or id alone
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    if tag in _HARD_TAGS or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and (value or "").lower() in BOILERPLATE_ROLES and tag not in SOFT_TAGS:
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _boilerplate_name(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> str:
    """What marks an element as boilerplate unless its content speaks for it: its soft tag, or its class and id words (behind
    a ``#`` where that is only the id of a section inside an article, which may be an anchor); empty if nothing does."""
    if tag in SOFT_TAGS:
        return f"<{tag}>"
    if tag in ("html", "body", "article", "main"):
        return ""
    found = {name: _LAYOUT_WORD.sub(" ", _CAMEL.sub("-", value)) for name, value in attrs if name in ("class", "id") and value}
    marked = [name for name, words in found.items() if _BOILERPLATE_NAME.search(words)]
    anchor = "#" if inside_article and tag == "section" and marked == ["id"] else ""
    return anchor + " ".join(found.values()) if marked else ""


class _Tree(HTMLParser):
    """A forgiving tree builder: optional end tags, unclosed and stray tags; depth needs no recursion. The places of open
    elements are kept by tag, so that no tag has to look through the open elements."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", False)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # of the open elements of a tag
        self.scopes: list[int] = []  # of the open elements that bound the closing of others
        self.blocks: list[int] = []
        self.articles = self.soft = 0
        self.named = self.softs = self.marked = False

    def _push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in _SCOPE:
            self.scopes.append(at)
        if node.tag in _BLOCKS:
            self.blocks.append(at)
        self.articles += node.tag in ("article", "main")
        self.soft += node.tag in SOFT_TAGS

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.places[node.tag].pop()
            self.articles -= node.tag in ("article", "main")
            self.soft -= node.tag in SOFT_TAGS
        del self.stack[depth:]
        for places in (self.scopes, self.blocks):
            while places and places[-1] >= depth:
                places.pop()

    def _place(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _close(self, tags, scope) -> None:
        at = max(map(self._place, tags))
        if not at:
            return
        for bound in reversed(self.scopes):
            if bound < at:
                break
            if self.stack[bound].tag in scope:
                return
        self._pop_to(at)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "html":
            return
        if tag in _CLOSES_P:
            self._close(("p",), _SCOPE)
        if tag in HEADINGS:
            self._close(HEADINGS, _SCOPE)
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _NO_SCOPE[tag])
        elif tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template", "head"):
            if len(self.stack) > 1 and self.stack[1].tag == "head":  # </head> is optional
                self._pop_to(1)
        hard = _is_boilerplate(tag, attrs, self.articles > 0)
        node = Node(tag, hard, "" if hard else _boilerplate_name(tag, attrs, self.articles > 0))
        if tag in ("article", "main"):
            self.marked = True
            self.named |= self.soft > 0
        elif node.named.startswith("<"):
            self.softs = True
        elif node.named:
            self.named = True
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._place(tag)
        # a stray inline end tag does not close blocks
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if data:
            self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    # an unclosed script or style would swallow the rest; feed() keeps such a tail back, close() hands it over as data of it
    tree.feed(html)
    tree.close()
    if tree.named or (tree.softs and not tree.marked):
        _unskip(_body(tree.root))
    return tree.root


def _unskip(body: Node) -> None:
    """What speaks against a mark. A class or id word does not skip a subtree that holds an article or main element at least
    half as long as the page's longest, nor one with most of the page's non-link characters; for a word on readers' comments
    it takes both. A soft tag does not skip such an article either, nor most of a page that marks none; a section's id inside
    an article does not skip running text."""
    order: list[tuple[Node, Node | None]] = []
    plain: dict[int, int] = {}
    linked: dict[int, int] = {}
    stack: list[tuple[Node, Node | None, bool]] = [(body, None, False)]
    while stack:
        node, parent, in_link = stack.pop()
        order.append((node, parent))
        link = in_link or node.tag == "a"
        own = sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        plain[id(node)], linked[id(node)] = (0, own) if link else (own, 0)
        stack.extend((c, node, link) for c in node.children if isinstance(c, Node) and (c.named or not c.skip))
    for node, parent in reversed(order):
        if parent is not None:
            plain[id(parent)] += plain[id(node)]
            linked[id(parent)] += linked[id(node)]
    marked = [plain[id(n)] for n, _ in order if n.tag in ("article", "main")]
    least = max(1, max(marked, default=0) / 2)
    holds: set[int] = set()
    for node, parent in reversed(order):
        if node.tag in ("article", "main") and plain[id(node)] >= least:
            holds.add(id(node))
        if parent is not None and id(node) in holds:
            holds.add(id(parent))
    for node, _ in order:
        if node.named:
            most = 2 * plain[id(node)] > plain[id(body)]
            article = id(node) in holds
            if node.named.startswith("<"):
                node.skip = not (article or most and not marked)
            elif node.named.startswith("#") and not _COMMENTS.search(node.named):
                node.skip = not (plain[id(node)] >= RUNNING_TEXT and plain[id(node)] > 4 * linked[id(node)])
            else:
                node.skip = not (article and most if _REPLIES.search(node.named.lstrip("#")) else article or most)


def _body(root: Node) -> Node:
    return next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)


def _measure(body: Node) -> list[tuple[Node, Node | None]]:
    """Fill the counts bottom-up; returns (node, parent) in page order without skipped subtrees."""
    order: list[tuple[Node, Node | None]] = []
    stack: list[tuple[Node, Node | None, bool]] = [(body, None, False)]
    while stack:
        node, parent, in_link = stack.pop()
        order.append((node, parent))
        link = in_link or node.tag == "a"
        for child in reversed(node.children):
            if isinstance(child, str):
                n = len(_SPACE.sub("", child))
                node.chars += n
                node.link_chars += n * link
            elif not child.skip:
                stack.append((child, node, link))
    for node, parent in reversed(order):
        if parent is not None:
            parent.chars += node.chars
            parent.link_chars += node.link_chars
            parent.tags += node.tags + 1
            parent.link_tags += node.link_tags + (node.tag == "a")
    return order


def _densities(order: list[tuple[Node, Node | None]]) -> None:
    body = order[0][0]
    ratio = body.link_chars / max(body.chars, 1)
    for node, _ in order:
        c, t = node.chars, max(node.tags, 1)
        if not c:
            continue
        lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
        node.density = c / t * math.log(max(c / t * c / lc * t / lt, 1.0)) / max(math.log(base), 1.0) if base > 1 else c / t
    for node, parent in reversed(order):
        if parent is not None:
            parent.total += node.density


def _text_blocks(node: Node) -> list[str]:
    """Blocks of a subtree in page order: white space inside a block is one space; empty blocks are dropped."""
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(piece)).strip()
        if text:
            blocks.append(text)
        piece.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            piece.append(item)
        elif item.tag == "br":
            piece.append(" ")
        elif not item.skip:
            block = item.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return blocks


def main_text(html: str) -> str:
    """The page's main text: blocks joined by one line break; empty for a page without text."""
    body = _body(parse(html))
    order = _measure(body)
    if not body.chars:
        return ""
    _densities(order)
    parent_of = {id(n): p for n, p in order}
    best = max((n for n, _ in order if n.chars), key=lambda n: n.total)
    if best is body:
        return "\n".join(_text_blocks(body))
    threshold, at = best.density, best
    while at is not body:  # the least density on the way to the body
        threshold = min(threshold, at.density)
        at = parent_of[id(at)]
    out: list[str] = []
    stack = [body]
    while stack:  # top-down: the first nodes at or above the threshold, each reduced to its dense parts
        node = stack.pop()
        if node is not body and node.density >= threshold:
            for part in _parts(node, threshold, parent_of):
                out.extend(_text_blocks(part))
            continue
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip and c.chars)
    return "\n".join(out)


def _parts(top: Node, threshold: float, parent_of: dict[int, Node | None]) -> list[Node]:
    """In page order: the part of ``top`` with the largest density sum, and what is left beside the way to it: nodes at
    or above the threshold, each reduced in the same way, and headings."""
    out: list[Node] = []
    stack: list[tuple[Node, bool]] = [(top, True)]
    while stack:
        node, reduce = stack.pop()
        if not reduce:
            out.append(node)
            continue
        if node is not top and node.density < threshold:
            stack.extend((c, True) for c in reversed(node.children) if isinstance(c, Node) and not c.skip and c.chars)
            continue
        part = _with_headings(_largest(node), node, parent_of)
        way, at = {id(part)}, part
        while at is not node:
            at = parent_of[id(at)]
            way.add(id(at))
            if (at.tag == "p" or at.tag not in BLOCK) and any(isinstance(c, str) and not c.isspace() for c in at.children):
                part = at  # words around inline elements stay with them
        pending, found, titles = [node], [], set()
        while pending:  # along the way from node to part
            n = pending.pop()
            if n is part:
                found.append((n, False))
            elif id(n) in way:
                below = [c for c in n.children if isinstance(c, Node) and not c.skip and c.chars]
                pending.extend(reversed(below))
                kept = False
                for c in reversed(below):  # a heading stays with what it stands over
                    if c.tag in HEADINGS:
                        if kept:
                            titles.add(id(c))
                    else:
                        kept = id(c) in way or c.density >= threshold
            else:
                found.append((n, id(n) not in titles))
        stack.extend(reversed(found))
    return out


def _largest(node: Node) -> Node:
    """The part of a subtree with the largest density sum (a subtree without inner tags is its own part)."""
    best, stack = node, [node]
    while stack:
        n = stack.pop()
        if n.total > best.total:
            best = n
        stack.extend(c for c in n.children if isinstance(c, Node) and not c.skip and c.chars)
    return best


def _with_headings(part: Node, top: Node, parent_of: dict[int, Node | None]) -> Node:
    """``part`` widened, up to ``top``: to the article or main element around it where the page marks one, and over
    parents that add nothing but headings."""
    node, marked = part, part
    while node is not top:
        node = parent_of[id(node)]
        if node.tag in ("article", "main"):
            marked = node
            break
    while marked is not top:
        parent = parent_of[id(marked)]
        others = [c for c in parent.children if c is not marked]
        if any(_SPACE.sub("", c) if isinstance(c, str) else not c.skip and c.chars and c.tag not in HEADINGS | {"header", "hgroup"}
               for c in others):
            break
        marked = parent
    return marked


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, *keep, text, n_chars) per row. Null or empty html, and pages without text, give an empty text.

    Row-local: no shuffle; whole pages whatever their length; repeated rows each give a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h.as_py() or "") for h in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*part.schema.names[:-1], "text", "n_chars"])

    names = [id_col, *keep]
    slim = spread(pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(html_col).alias("html")))
    schema = ", ".join(f"c{i} {slim.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    out = slim.mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "text", "n_chars")
