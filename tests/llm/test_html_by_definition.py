"""Extraction against the definition, on random trees, by plain recursion."""

import math
import random
import re

import pytest

from emenda.llm import html


def tree(r, depth):
    """(name, parts): divs, spans and links with words between them."""
    name = r.choice(["div", "div", "section", "span", "a"]) if depth else "div"
    parts = []
    for _ in range(r.randrange(5)):
        if depth < 5 and r.random() < 0.6:
            parts.append(tree(r, depth + 1))
        else:
            parts.append(" ".join("w" * r.randrange(1, 9) for _ in range(r.choice([1, 2, 30]))))
    return name, parts


def page(node):
    return f"<{node[0]}>" + "".join(p if isinstance(p, str) else page(p) for p in node[1]) + f"</{node[0]}>"


def counts(node, link=False):
    """(chars, tags, link chars, link tags), each from the whole subtree."""
    link = link or node[0] == "a"
    c = [0, 0, 0, 0]
    for p in node[1]:
        if isinstance(p, str):
            c[0] += len(p)
            c[2] += len(p) * link
        else:
            inside = link or p[0] == "a"
            d = counts(p, link)
            c = [c[0] + d[0], c[1] + d[1] + 1, c[2] + d[2], c[3] + d[3] + inside]
    return c


def density(c, body):
    chars, tags, lc, lt = c
    if not chars:
        return 0
    if not body[2]:
        return chars / max(tags, 1)
    inner = math.log(chars / max(chars - lc, 1) * lc + body[2] / max(body[0], 1) * chars + math.e)
    return max(0, chars / max(tags, 1) * math.log(chars / max(lc, 1) * max(tags, 1) / max(lt, 1)) / math.log(inner)) if inner > 1 else chars / max(tags, 1)


def nodes(node, path=(), link=False):
    """(node, path of indices, whether in a link) in the order of the page."""
    yield node, path, link
    for i, p in enumerate(node[1]):
        if not isinstance(p, str):
            yield from nodes(p, (*path, i), link or node[0] == "a")


@pytest.mark.parametrize("seed", range(150))
def test_marked_text(seed):
    r = random.Random(seed)
    body = ("body", [tree(r, 0) for _ in range(r.randrange(1, 4))])
    every = list(nodes(body))
    whole = counts(body)
    dense = {path: density(counts(n, link), whole) for n, path, link in every}
    total = {path: sum(dense[(*path, i)] for i, p in enumerate(n[1]) if not isinstance(p, str)) for n, path, _ in every}
    best = max(total, key=lambda p: total[p])  # of equal sums the first in the page
    text, found, threshold = html.extract(f"<html><body>{''.join(p if isinstance(p, str) else page(p) for p in body[1])}</body></html>")
    if total[best] <= 0:
        marked = [()]
    else:
        least = min(dense[best[:k]] for k in range(len(best) + 1))
        assert threshold == pytest.approx(least) and found == pytest.approx(total[best])
        marked = set()
        for p in dense:
            if dense[p] >= least:
                below = [q for q in dense if q[: len(p)] == p]
                top = max(below, key=lambda q: total[q])
                if total[top] > 0:
                    marked.add(top)
        marked = [p for p in dense if p in marked and not any(p[:k] in marked for k in range(len(p)))]
    by = {path: n for n, path, _ in every}
    plain = lambda n: "".join(p if isinstance(p, str) else plain(p) for p in n[1])
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(plain(by[p]) for p in marked))


def test_deep_pages_and_ties():
    deep = "<div>" * 2000 + "text" + "</div>" * 2000
    assert html.extract(deep)[0] == "text"
    # two equal blocks: both reach the threshold, in the order of the page
    block = "<div><p>some words of the same length here</p><p>some words of the same length here</p></div>"
    assert html.extract(block + block)[0].count("same") == 4
