"""Main-text extraction with a tree-structured graphical model.

Each element of a page is a node with two states, boilerplate and content. A node has a potential from what
it looks like, and each parent and child share a potential. Sum-product messages go up the tree and down
again, which gives each node's exact marginal; both kinds of potential are trained from labelled pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_turn
from .html_pages import MARK, labelled_page

#: Generated pages that train the model.
TRAINING_PAGES = 400
#: The power of each look's likelihood.
OVERLAP = 0.4
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
NEVER = RAW | frozenset("head select button svg canvas audio video object math".split())
#: What hides an element from a reader.
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Characters of a block that is a paragraph and not a label.
LONG = 80
#: Potentials of looks that a worker remembers.
REMEMBERED = 100_000


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()  # of class, id and role
    hidden: bool = False
    marked: bool = False
    parts: list = field(default_factory=list)  # text, or the index of a child
    chars: int = 0
    link_chars: int = 0
    own_chars: int = 0  # its text and that of its inline children
    paragraphs: int = 0  # children of LONG characters or more, few of them in links
    depth: int = 0
    before: int = 0  # characters of the page before its own


def parse(page: str) -> list[Node]:
    """Elements in page order; the first is the page itself. Missing end tags are supplied."""
    nodes, stack = [Node("#page", -1)], [0]
    at, lowered = 0, page.lower()
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m[0] == "<":
                parts = nodes[stack[-1]].parts
                if parts and isinstance(parts[-1], str):  # a lone < stays in its text
                    parts[-1] += m[0]
                else:
                    parts.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(nodes[i].tag == "p" for i in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    del stack[depth:]
                    break
                if tag in INLINE and nodes[stack[depth]].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == "p":
                    del stack[depth:]
                    break
                if nodes[stack[depth]].tag not in INLINE:
                    break
        if tag in ITEMS:
            same, until = (x.split() for x in ITEMS[tag])
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in until:
                    break
                if nodes[stack[depth]].tag in same:
                    del stack[depth:]
                    break
        node = Node(tag, stack[-1])
        if m[3]:
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3])}
            node.marked = MARK in found
            node.words = tuple(sorted(set(WORDS.findall(f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()))))
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "").lower()))
        node.depth = nodes[stack[-1]].depth + 1
        nodes.append(node)
        nodes[stack[-1]].parts.append(len(nodes) - 1)
        if tag in VOID or m[0].endswith("/>"):
            continue
        if tag in RAW:
            end = lowered.find(f"</{tag}", at)
            node.parts.append(page[at : end if end >= 0 else len(page)])
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        stack.append(len(nodes) - 1)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if never(node):
            node.chars = node.link_chars = node.own_chars = 0
        else:
            text = sum(len(x) for x in node.parts if isinstance(x, str) and not x.isspace())
            node.chars += text
            node.own_chars += text
            if node.tag == "a":
                node.link_chars = node.chars
        if i:
            above = nodes[node.parent]
            above.chars += node.chars
            above.link_chars += node.link_chars
            if node.tag in INLINE:
                above.own_chars += node.own_chars
            above.paragraphs += long_text(node)
    total = 0
    todo: list = [0]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            total += not x.isspace() and len(x)
            continue
        nodes[x].before = total
        if not never(nodes[x]):
            todo += reversed(nodes[x].parts)
    return nodes


def never(node: Node) -> bool:
    """Whether a reader sees nothing of it as text."""
    return node.hidden or node.tag in NEVER


def long_text(node: Node) -> bool:
    """A block with a paragraph's text, most of it outside links."""
    return node.own_chars >= LONG and 2 * node.link_chars < node.chars


def looks(node: Node, page: Node) -> list[tuple[str, object]]:
    """What the unary potential sees of a node of a page: its tag, text, links, place and neighbours, and the words of its class,
    id and role, which mean what they meant on the training pages, or nothing."""
    share = node.link_chars / node.chars if node.chars else 0
    size = lambda n: 0 if not n else 1 if n < 25 else 2 if n < LONG else 3 if n < 250 else 4
    part = node.chars / max(page.chars, 1)
    seen = [
        ("tag", node.tag),
        ("links", 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3),
        ("size", size(node.chars)),
        ("text", (kind(node.tag), size(node.own_chars))),
        ("part", 0 if part < 0.05 else 1 if part < 0.3 else 2 if part < 0.6 else 3),
        ("paragraphs", min(3, node.paragraphs)),
        ("place", (min(2, int(3 * node.before / max(page.chars, 1))), size(node.own_chars) > 2)),
        ("depth", min(6, node.depth)),
    ]
    return seen + [("word", w) for w in node.words]


def kind(tag: str) -> str:
    """Tags that share a parent-child potential."""
    if tag in INLINE:
        return "inline"
    if tag in ("article", "main"):
        return "article"
    if tag in ("p", "li", "td"):
        return tag
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "heading"
    if tag in ("nav", "header", "footer", "aside", "form") or tag in NEVER:
        return "apart"
    return "group" if tag in ("div", "section", "body", "html", "#page", "table", "tbody", "tr", "ul", "ol") else "block"


def edge(node: Node, parent: Node) -> tuple[str, bool, bool]:
    """What a parent-child potential depends on."""
    return kind(node.tag), long_text(node), parent.tag in ("body", "html", "#page")


@dataclass(frozen=True)
class ContentModel:
    unary: dict[tuple, np.ndarray]  # what a node looks like -> (boilerplate, content)
    pair: dict[tuple[str, bool, bool], tuple]  # kind of child, whether it has a paragraph's text, whether it is in the body itself -> parent state x child state
    _own: dict = field(default_factory=dict, compare=False)

    def own(self, node: Node, page: Node) -> tuple[float, float]:
        """The unary potential of a node, kept away from 0 and 1."""
        if never(node):
            return (1 - 1e-9, 1e-9)
        seen = tuple(x for x in looks(node, page) if x in self.unary)
        if seen not in self._own:
            if len(self._own) >= REMEMBERED:
                self._own.clear()
            u = np.prod([self.unary[x] for x in seen], 0) if seen else np.ones(2)
            c = float(np.clip(u[1] / u.sum(), 1e-6, 1 - 1e-6))
            self._own[seen] = (1 - c, c)
        return self._own[seen]

    def between(self, node: Node, parent: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        return self.pair.get(edge(node, parent)) or ((0.9, 0.1), (0.1, 0.9))


def train(pages: Iterable[str]) -> ContentModel:
    """Count states and transitions of labelled pages; one count is added to each."""
    states, seen, moves = Counter(), defaultdict(lambda: np.ones(2)), defaultdict(lambda: np.ones((2, 2)))
    for page in pages:
        nodes = parse(page)
        for i, node in enumerate(nodes):
            y = int(node.marked)
            states[y] += 1
            if never(node):
                continue
            for look in looks(node, nodes[0]):
                seen[look][y] += 1
            if i:
                moves[edge(node, nodes[node.parent])][int(nodes[node.parent].marked), y] += 1
    total = np.array([states[0] + 1.0, states[1] + 1.0])
    # the looks of a node overlap, so each counts for less
    unary = {k: (v / total) ** OVERLAP for k, v in seen.items()}
    pair = {k: tuple(map(tuple, (v / v.sum(1, keepdims=True)).tolist())) for k, v in moves.items()}
    return ContentModel(unary, pair)


def marginals(nodes: list[Node], model: ContentModel) -> list[float]:
    """The probability that each node is content, by messages up and down the tree.

    All pairs are (boilerplate, content) and sum to 1. Children come after their parent.
    """
    n = len(nodes)
    below = [model.own(x, nodes[0]) for x in nodes]
    below[0] = (1 - 1e-6, 1e-6)
    pair = [model.between(x, nodes[x.parent]) for x in nodes]
    up = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        b, c = below[i]
        (bb, bc), (cb, cc) = pair[i]
        u, v = bb * b + bc * c, cb * b + cc * c
        up[i] = u, v = u / (u + v), v / (u + v)
        parent = nodes[i].parent
        x, y = below[parent][0] * u, below[parent][1] * v
        below[parent] = (x / (x + y), y / (x + y))
    out = [below[0][1]] * n
    for i in range(1, n):
        q = out[nodes[i].parent]
        u, v = (1 - q) / max(up[i][0], 1e-300), q / max(up[i][1], 1e-300)
        (bb, bc), (cb, cc) = pair[i]
        x, y = below[i][0] * (u * bb + v * cb), below[i][1] * (u * bc + v * cc)
        out[i] = y / (x + y)
    return out


def main_text(page: str | None, model: ContentModel, least: float = 0.5) -> str:
    """The text of the nodes whose marginal is ``least`` or more; blocks are joined by a line feed.

    Character references are decoded, white space in a block becomes one space. A header inside the article, which holds its
    headline, belongs to it; headers of the page do not. Hidden elements are left out. Where nothing reaches ``least``, but
    there is a paragraph, the bound is half the highest marginal of any, so a page does not lose its only text. A null page, and one
    without content, give an empty text.
    """
    if not page:
        return ""
    nodes = parse(page)
    p = marginals(nodes, model)
    if not any(q >= least and x.own_chars for x, q in zip(nodes, p, strict=True)):
        least = min(least, max((q for x, q in zip(nodes, p, strict=True) if long_text(x)), default=1.0) / 2)
    blocks: list[list[str]] = [[]]
    todo: list = [0]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            if x[0] == "text":
                blocks[-1].append(x[1])
            else:
                blocks.append([])
            continue
        node = nodes[x]
        if never(node):
            continue
        if node.tag == "br":
            blocks[-1].append(" ")
            continue
        inside = p[x] >= least
        block = node.tag not in INLINE
        inner = [(("text", entities.unescape(y)) if inside else None) if isinstance(y, str) else y for y in node.parts]
        inner = [y for y in inner if y is not None]
        todo += [*([("end",)] * block), *reversed(inner)]
        if block:
            blocks.append([])
    lines = (SPACE.sub(" ", "".join(b)).strip() for b in blocks if b)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), training_pages: int = TRAINING_PAGES) -> DataFrame:
    """``id_col``, the columns of ``keep``, and ``text`` of each whole page.

    Rows are independent: repeated rows and null ids need no special case, an empty table gives an empty
    result, and columns not named are dropped.
    """
    model = train(map(labelled_page, range(training_pages)))
    names = [id_col, *keep]
    rows = pages.select(*names, F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            texts = [main_text(t.as_py(), model) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")
