import random

import numpy as np
import pyarrow as pa

from emenda.llm import decontaminate as D
from emenda.llm.textvec import words as arrow_words

from .conftest import prose, words


def similarity(a, b):
    """Weighted Jaccard of word pairs, by the definition."""

    def bag(w):
        out = {}
        for x, y in zip(w, w[1:]) if len(w) > 1 else [(w[0], "")]:
            out[x, y] = out.get((x, y), 0) + len(x.encode()) + len(y.encode())
        return out

    a, b = bag(a), bag(b)
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def brute(rows, items):
    out = set()
    for i, t in rows:
        w = words(t or "")
        for j, x in items:
            v = words(x)
            least = D.THRESHOLD if len(v) >= D.MIN_WORDS else 1
            if w and v and any(similarity(w[k : k + len(v)], v) >= least - 1e-12 for k in range(max(len(w) - len(v), 0) + 1)):
                out.add((i, j))
    return out


def corpus():
    r = random.Random(3)
    items = [(j, prose(15 + 3 * j, 500 + j)) for j in range(12)]
    rows = [(i, prose(150, i)) for i in range(20)]
    for i in range(20, 80):
        j = r.randrange(12)
        w = items[j][1].split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "changed"
        a, b = prose(r.randrange(60), i).split(), prose(r.randrange(60), 1000 + i).split()
        rows.append((i, ("\n" if i % 2 else " ").join([*a, *w, *b]) + "."))
    return rows, items


def test_recall_against_brute_force(spark, docs):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.contaminated(docs(rows), bench).collect()
    want = brute(rows, items)
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.9 * len(want)
    exact = {(i, j) for i, t in rows for j, x in items if x in t.replace("\n", " ")}
    assert exact <= got
    text = dict(rows)
    for r in found:
        assert abs(similarity(words(text[r.doc_id][r.start : r.end]), words(dict(items)[r.item_id])) - r.similarity) < 1e-9
        assert r.distance <= D.RADIUS
    clean = {r.doc_id for r in D.clean(docs(rows), bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}


def test_short_texts_and_short_items(spark, docs):
    """Texts of fewer words than an item are compared whole, items of few words are met exactly."""
    items = [(j, prose(n, 600 + j, 100_000)) for j, n in enumerate([1, 2, 3, 4, 5, 8, 20, 40, 59])]
    rows = []
    for j, x in items:
        w = x.split()
        rows += [(20 * j + k, " ".join(w[: max(len(w) - k, 1)])) for k in range(9)]
        rows += [(20 * j + 10, f"{prose(30, j)} {x} {prose(30, 50 + j)}"), (20 * j + 11, f"{prose(9, j)} {' '.join(w[: len(w) // 2])} zzz {' '.join(w[len(w) // 2 + 1 :])}"), (20 * j + 12, " ".join(w[2:-2]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got, want = {(r.doc_id, r.item_id) for r in D.contaminated(docs(rows), bench).collect()}, brute(rows, items)
    assert got <= want and len(got) >= 0.9 * len(want)
    assert {(20 * j, j) for j in range(9)} <= got and {(20 * j + 10, j) for j in range(1, 9)} <= got and (10, 0) not in got


def test_blocks_miss_nothing_within_the_radius():
    r = np.random.default_rng(2)
    index = D.Index(list(range(40)), [prose(20, j) for j in range(40)], D.RADIUS, D.THRESHOLD)
    near = index.prints ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, D.RADIUS + 4), replace=False)) for _ in range(40)], np.uint64)
    win, item, distance = index.candidates(19, near)
    want = {(w, i) for w in range(40) for i in range(40) if bin(int(near[w] ^ index.prints[i])).count("1") <= D.RADIUS}
    assert set(zip(win.tolist(), item.tolist())) == want and len(distance) == len(want)


def test_odd_rows(spark, docs):
    item = prose(20, 7)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "zu kurz"), (5, "...")], "item_id bigint, text string")
    rows = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, item * 2), (5, prose(30_000, 1) + " " + item)]
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs(rows), bench).collect()} == {(3, 1), (4, 1), (5, 1)}
    assert sorted(r.doc_id for r in D.clean(docs(rows[1:3]), bench).collect()) == [1, 2]
    assert D.contaminated(docs([]), bench).count() == 0
    assert D.contaminated(docs(rows), bench.where("item_id > 9")).count() == 0
    assert D.clean(docs(rows), bench.where("item_id > 9")).count() == 7


def test_parts_cover_the_benchmark(spark, docs):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    parts = list(D.indexes(bench, part_items=5))
    assert len(parts) == 3 and sorted(i for p in parts for i in p.ids) == list(range(12))


def test_running_sums():
    w = next(arrow_words(pa.array([prose(50, 1)])))
    s, b = w.shingles(2)
    weight = D.pair_weights(w, b)
    run = D.running_sums(s, weight)
    got = D.fingerprints(run, np.array([3]), 10)[0]
    want = 0
    for bit in range(64):
        if sum(int(v) if int(x) >> bit & 1 else -int(v) for x, v in zip(s[3:13], weight[3:13])) > 0:
            want |= 1 << bit
    assert int(got) == want
