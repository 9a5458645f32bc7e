"""HTML extraction by composite text density (Sun, Song and Liao, 2011).

For every element of the body with C characters of text, T tags below it, LC characters and LT tags
within links, and LCb and Cb those of the body, the composite density is

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

where a zero divisor counts as one and a negative value as zero; in a page without links it is C / T.
An element's density sum is that of its children's densities.  The element of the body with the
greatest sum is taken, the threshold is the least density on its path to the body, and from the
body downwards every element that reaches the threshold marks the element of greatest sum below or
at it.  The text of the marked elements, outermost first and in the order of the page, is the
result.  Of equal sums the first in the page counts.

Defined cases: a null page gives a null text; one without text, or where no sum is positive, gives the
text of its whole body.  Broken markup is read leniently: end tags without a beginning are
ignored, open elements end with their parent, and comments, scripts, styles and the head don't count.
Every row is answered by itself, so repeated rows and null ids are kept.  Other columns, of
whatever name, are ignored.  Pages are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_BLANK = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe textarea select".split())
_BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: An element that begins ends the open elements of these names, up to the nearest of its bounds.
_ENDS = {
    **{n: ({"p"}, frozenset()) for n in _BLOCK - {"br", "body"}},
    "li": ({"p", "li"}, frozenset(("ul", "ol"))),
    "dt": ({"p", "dt", "dd"}, frozenset(("dl",))),
    "dd": ({"p", "dt", "dd"}, frozenset(("dl",))),
    "tr": ({"p", "td", "th", "tr"}, frozenset(("table",))),
    "td": ({"p", "td", "th"}, frozenset(("tr", "table"))),
    "th": ({"p", "td", "th"}, frozenset(("tr", "table"))),
    "option": ({"option"}, frozenset(("select",))),
}


@dataclass(slots=True)
class Node:
    name: str
    link: bool
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0
    parts: list = field(default_factory=list)  # texts and nodes


def parse(page: str) -> Node:
    """The body of a page as a tree, with counts."""
    root = Node("body", False)
    stack, at, low = [root], 0, None
    in_head = False

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            up = stack[-1]
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + node.link

    def text(raw: str) -> None:
        if in_head or not raw or raw.isspace():
            return
        raw = _BLANK.sub(" ", entities.unescape(raw) if "&" in raw else raw)
        n = len(raw.strip())
        if n:
            node = stack[-1]
            node.parts.append(raw)
            node.chars += n
            if node.link:
                node.link_chars += n

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        found = _NAME.match(m.group())
        if not found:
            continue
        name = found[1].lower()
        if m.group()[1] == "/":
            if name == "head":
                in_head = False
            elif name not in ("html", "body"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        close(depth)
                        break
            continue
        if name in _RAW or name == "title" and in_head:
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at)
            stop = low.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if name == "head":
            in_head = True
            continue
        if name in ("html", "body"):
            in_head = False
            continue
        if in_head:
            continue
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            depth = len(stack) - 1
            while depth > 0 and stack[depth].name not in bounds and (stack[depth].name in ends or stack[depth].name not in _BLOCK):
                if stack[depth].name in ends:
                    close(depth)
                depth -= 1
        up = stack[-1]
        node = Node(name, up.link or name == "a")
        up.parts.append(node)
        stack.append(node)
        if name in _VOID or m.group().endswith("/>"):
            close(len(stack) - 1)
    text(page[at:])
    close(1)
    return root


def density(node: Node, body: Node) -> float:
    if not node.chars:
        return 0.0
    plain = node.chars / max(node.tags, 1)
    if not body.link_chars:
        return plain
    base = math.log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + body.link_chars / max(body.chars, 1) * node.chars + math.e)
    ratio = node.chars / max(node.link_chars, 1) * (max(node.tags, 1) / max(node.link_tags, 1))
    return max(0.0, plain * math.log(ratio) / math.log(base)) if base > 1 else plain


def score(body: Node) -> list[tuple[Node, Node | None]]:
    """Sets densities and sums; all nodes with their parents, in the order of the page."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(body, None)]
    while todo:
        node, up = todo.pop()
        order.append((node, up))
        todo.extend((c, node) for c in reversed(node.parts) if isinstance(c, Node))
    for node, up in order:
        node.density, node.total = density(node, body), 0.0
    for node, up in order:
        if up is not None:
            up.total += node.density
    return order


def content(body: Node) -> tuple[list[Node], float]:
    """Marked nodes, outermost first, and the threshold."""
    order = score(body)
    best = max(order, key=lambda x: x[0].total)[0]
    if best.total <= 0:
        return [body], 0.0
    parents = {id(node): up for node, up in order}
    threshold, node = best.density, best
    while (node := parents[id(node)]) is not None:
        threshold = min(threshold, node.density)
    # the node of greatest sum in each subtree, children before parents
    top: dict[int, Node] = {}
    place = {id(node): i for i, (node, _) in enumerate(order)}
    for node, _ in reversed(order):
        pick = node
        for c in node.parts:
            if isinstance(c, Node):
                t = top[id(c)]
                if t.total > pick.total or t.total == pick.total and place[id(t)] < place[id(pick)]:
                    pick = t
        top[id(node)] = pick
    marked = {id(top[id(node)]) for node, _ in order if node.density >= threshold and top[id(node)].total > 0}
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        if id(node) in marked:
            out.append(node)
        else:
            todo.extend(c for c in reversed(node.parts) if isinstance(c, Node))
    return out, threshold


def text_of(nodes: list[Node]) -> str:
    """Text with one line per block."""
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name in _BLOCK:
            out.append("\n")
            todo.append("\n")
            todo.extend(reversed(x.parts))
        else:
            todo.extend(reversed(x.parts))
    lines = (_BLANK.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def extract(page: str) -> tuple[str, float, float]:
    """(text, greatest density sum, threshold) of a page."""
    body = parse(page)
    nodes, threshold = content(body)
    return text_of(nodes), max(n.total for n in nodes), threshold


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, density_sum, threshold) of every page."""

    def scan(batches):
        for batch in batches:
            found = [(None, None, None) if p is None else extract(p) for p in batch.column("html").to_pylist()]
            text = [f[0] for f in found]
            yield pa.record_batch(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([None if t is None else len(t) for t in text], pa.int64()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()),
                ],
                ["page_id", "url", "text", "n_chars", "density_sum", "threshold"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(scan, "page_id bigint, url string, text string, n_chars bigint, density_sum double, threshold double")
