"""A small DOM for text extraction: blocks of text under the elements that hold them, and tree alignment."""

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
SKIPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu search title".split()
)
#: Words in class, id or role that mark an element as page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs masthead header footer comment comments disqus replies cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager contentinfo "
    "complementary search alert".split()
)
#: With one of these words, a header is that of the article.
ARTICLE_WORDS = frozenset("article entry post story content".split())
#: Articles are the content of a page if they hold this share of the text of its main element, which else is.
ARTICLE_SHARE = 0.5
#: An element of these opens: which open elements it ends, looking no further up than the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements nested deeper are read as if they stood at this depth; but for the outermost article and furniture there, which
#: are elements of their own at any depth.
DEPTH = 256
#: Elements that hold data of an article; there, a part of a class name alone does not make them furniture.
DATA = frozenset("table thead tbody tr td th pre blockquote".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Marked sections, which the parser takes for errors.
_MARKED = re.compile(r"<!\[[^>]*>?")


@dataclass(slots=True)
class Node:
    tag: str
    sign: str
    furniture: bool
    region: bool
    #: Furniture by a word in class, id or role alone, and whether that word is one of these names as a whole.
    by_word: bool = False
    by_name: bool = False
    parent: "Node | None" = None
    children: list["Node | str"] = field(default_factory=list)  # elements and blocks of text, in page order

    @property
    def path(self) -> str:
        out, node = [], self
        while node:
            out.append(node.sign)
            node = node.parent
        return "/".join(reversed(out))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "html", False, False)
        self.open = [self.root]
        self.holder = self.root  # block element that text now belongs to
        self.text: list[str] = []
        self.beyond: list[tuple[str, Node | None]] = []  # open elements below DEPTH, with the one or two that are in ``open``
        self.n_beyond: Counter[str] = Counter()

    def flush(self) -> None:
        block = " ".join("".join(self.text).split())
        self.text.clear()
        if block:
            self.holder.children.append(block)

    def pop_to(self, i: int) -> None:
        del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            elif tag == "hr":
                self.flush()
            return
        if tag in ("html", "body"):
            return
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}"
        words = {w.lower() for w in _TOKEN.findall(names)}
        region = tag in ("article", "main") or given.get("role") in ("main", "article")
        within = any(n.region for n in self.open)
        marks = words & FURNITURE
        if within or words & ARTICLE_WORDS:
            marks -= {"header"}  # of the article, not of the page
        by_tag = tag in SKIPPED or (tag == "header" and not within)
        by_name = any(name.lower() in marks for name in names.split())
        if within and tag in DATA and not by_name:
            marks = set()
        furniture = by_tag or bool(marks)
        breaks = tag in BLOCK or furniture or region
        if breaks:
            self.flush()
            if tag in BLOCK and not self.beyond:
                for i in range(len(self.open) - 1, 0, -1):  # a block ends an open paragraph
                    if self.open[i].tag == "p":
                        self.pop_to(i)
                        break
                    if self.open[i].tag in BLOCK:
                        break
            if tag in ENDS and not self.beyond:
                ended, limit = ENDS[tag]
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i].tag in ended:
                        self.pop_to(i)
                        break
                    if self.open[i].tag in limit:
                        break
        deep = len(self.open) > DEPTH
        kept = not deep or not any(n.furniture for n in self.open[DEPTH + 1 :]) and (furniture or region and not within)
        if not kept:
            self.beyond.append((tag, None))
            self.n_beyond[tag] += 1
            return
        # ids and numbers tell pages apart, not layouts
        kinds = {w.lower() for w in _TOKEN.findall(f"{given.get('class', '')} {given.get('role', '')}") if not w.isdigit()}
        sign = ".".join([tag, *sorted(kinds)])
        node = Node(tag, sign, furniture, region, furniture and not by_tag, by_name, self.holder if breaks else None)
        self.open.append(node)
        if deep:
            self.beyond.append((tag, node))
            self.n_beyond[tag] += 1
        if breaks:
            self.holder.children.append(node)
            self.holder = node
        self.settle()

    def settle(self) -> None:
        self.holder = next(n for n in reversed(self.open) if n is self.root or n.parent is not None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing on other elements

    def end_beyond(self, tag: str) -> None:
        """Ends the innermost element of this name below DEPTH, and what is open in it."""
        if tag in BLOCK or tag in SKIPPED:
            self.flush()
        last = None
        while last != tag:
            last, node = self.beyond.pop()
            self.n_beyond[last] -= 1
            if node:
                self.flush()
                self.pop_to(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i] is node))
        self.settle()

    def handle_endtag(self, tag: str) -> None:
        if self.n_beyond[tag]:
            self.end_beyond(tag)
            return
        if self.beyond and tag not in BLOCK and tag not in SKIPPED:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if any(n.parent is not None for n in self.open[i:]):
                    self.flush()
                self.beyond.clear()
                self.n_beyond.clear()
                self.pop_to(i)
                self.settle()
                return
            # inline elements do not end the blocks around them
            if self.open[i].parent is not None and tag not in BLOCK and tag not in SKIPPED:
                return
        if tag == "p" or tag in ("html", "body"):
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(_MARKED.sub("", html))
    builder.close()
    builder.flush()
    relieve(builder.root)
    return builder.root


def blocks(node: Node, furniture: bool = False) -> list[tuple[Node, str]]:
    """Blocks below a node with their holders, in page order; those in page furniture only if asked for."""
    out: list[tuple[Node, str]] = []
    stack: list[Node | tuple[Node, str]] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x)
        elif furniture or not x.furniture or x is node:
            stack += reversed([c if isinstance(c, Node) else (x, c) for c in x.children])
    return out


def places(region: Node) -> tuple[list[tuple[str, str]], list[tuple[int, str]]]:
    """Elements of a content region by address, as (address, path), and its blocks outside page furniture in page order, as
    (position of their element, text).

    A path has the signs from the region down. An address has with each the number of the run of neighbours of that sign
    among its siblings, so it follows the layout of a page and not its length: elements of one run share it."""
    at: dict[str, int] = {}
    elements: list[tuple[str, str]] = []
    texts: list[tuple[int, str]] = []
    stack: list[tuple] = [(region, region.sign, region.sign)]
    while stack:
        x = stack.pop()
        if len(x) == 2:
            texts.append(x)
            continue
        node, address, path = x
        i = at.setdefault(address, len(elements))
        if i == len(elements):
            elements.append((address, path))
        below: list[tuple] = []
        runs: dict[str, int] = {}
        last = None
        for c in node.children:
            if isinstance(c, str):
                below.append((i, c))
            elif not c.furniture:
                if c.sign != last:
                    last = c.sign
                    runs[last] = runs.get(last, 0) + 1
                below.append((c, f"{address}/{last}#{runs[last]}", f"{path}/{last}"))
        stack += reversed(below)
    return elements, texts


def relieve(root: Node) -> None:
    """Takes elements that are furniture by a word alone for content if they or articles in them hold most of the text of
    the page. Those named so as a whole (``comments`` but not ``has-comments`` is a name) stay furniture, and their text
    counts for nothing, unless there is no other text and they are articles or hold one."""
    for named in (False, True):
        elements, marked = [], set()  # in page order; those within furniture by a word
        stack = [(root, False)]
        while stack:
            node, within = stack.pop()
            if node.furniture and not (node.by_word and (named or not node.by_name)):
                continue
            within |= node.furniture
            elements.append(node)
            if within:
                marked.add(id(node))
            stack += [(c, within) for c in reversed(node.children) if isinstance(c, Node)]
        sizes: dict[int, int] = {}
        for node in reversed(elements):
            sizes[id(node)] = sum(len(c) if isinstance(c, str) else sizes.get(id(c), 0) for c in node.children)
        if sizes[id(root)]:
            break
    most = sizes[id(root)] / 2
    largest = max((n for n in elements if n.region and id(n) in marked), key=lambda n: sizes[id(n)], default=None)
    if largest is not None:
        twins = [c for c in largest.parent.children if isinstance(c, Node) and c.region and c.sign == largest.sign]
        if sum(sizes.get(id(c), 0) for c in twins) > most:
            node = largest.parent
            while node:
                node.furniture = False
                node = node.parent
            for node in twins:
                node.furniture = False
    for node in elements:
        if node.furniture and not node.by_name and sizes[id(node)] > most:
            node.furniture = False


def content_region(root: Node) -> Node:
    """The part of a page that is its content: the article with most text and its sibling articles, or the main element
    with most if that holds more; else the page."""
    articles: list[tuple[int, Node]] = []
    main: tuple[int, Node | None] = (0, None)
    stack = [root]
    while stack:
        node = stack.pop()
        if node.furniture:
            continue
        if node.region and (size := sum(len(t) for _, t in blocks(node))):
            if node.tag == "article":
                articles.append((size, node))
            elif size > main[0]:
                main = size, node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    if not articles:
        return main[1] or root
    best = max(articles, key=lambda a: a[0])[1]
    siblings = [(size, node) for size, node in articles if node.parent is best.parent]
    if sum(size for size, _ in siblings) < ARTICLE_SHARE * main[0]:
        return main[1]
    if len(siblings) == 1:
        return best
    above = best.parent  # as it is, but for what stands beside the articles
    return Node(above.tag, above.sign, False, above.region, parent=above.parent, children=[node for _, node in siblings])


@dataclass(slots=True)
class Slot:
    """A node of the element tree of a page, and what it holds."""

    sign: str
    texts: dict[str, int]
    children: list["Slot"]


def skeleton(node: Node) -> Slot:
    """The element tree; neighbouring elements of one sign become one, so that its size follows the layout of a page
    and not its length. Page furniture is left out, as it never becomes content."""
    texts = {c: 1 for c in node.children if isinstance(c, str)}
    merged: list[Slot] = []
    for c in node.children:
        if isinstance(c, str) or c.furniture:
            continue
        s = skeleton(c)
        if merged and merged[-1].sign == s.sign:
            merged[-1].texts |= s.texts
            join(merged[-1], s)
        else:
            merged.append(s)
    return Slot(node.sign, texts, merged)


def join(into: Slot, other: Slot) -> None:
    """Adds children of one occurrence of an element to those of another on the same page."""
    for c in other.children:
        same = next((x for x in into.children if x.sign == c.sign), None)
        if same is None:
            into.children.append(c)
        else:
            same.texts |= c.texts
            join(same, c)


def tree_match(a: Slot, b: Slot) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-preserving common part of two trees with equal roots, and the
    pairs of children on it."""
    if a.sign != b.sign:
        return 0, []
    n, m = len(a.children), len(b.children)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    gain = [[tree_match(x, y)[0] for y in b.children] for x in a.children]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[n][m], pairs[::-1]
