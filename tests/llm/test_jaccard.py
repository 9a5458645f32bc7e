import random

from emenda.llm import jaccard
from emenda.llm.components import components

from .conftest import prose, words


def sets_of(rows, n=3):
    out = {}
    for i, t in rows:
        w = words(t or "")
        if i is not None and w:
            out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    return out


def brute(rows, t):
    s = sets_of(rows)
    ids = sorted(s)
    return {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def expanded(found):
    group, pairs = {}, {}
    for r in found:
        if r.equal_sets:
            group.setdefault(r.doc_a, [r.doc_a]).append(r.doc_b)
    for g in group.values():
        pairs |= {(a, b): 1.0 for a in g for b in g if a < b}
    for r in found:
        if not r.equal_sets:
            for a in group.get(r.doc_a, [r.doc_a]):
                for b in group.get(r.doc_b, [r.doc_b]):
                    pairs[min(a, b), max(a, b)] = r.jaccard
    return pairs


def corpus():
    rows, r = [], random.Random(5)
    for g in range(12):
        base = prose(60 + 5 * g, g).split()
        for k in range(1 + 3 * (g % 4)):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[3][1].upper() + " !"), (103, "one"), (104, "One."), (105, "two words"), (106, prose(6000, 99))]
    return rows


def test_pairs_equal_brute_force(docs):
    rows = corpus()
    found = jaccard.jaccard_join(docs(rows)).collect()
    want = brute(rows, jaccard.THRESHOLD)
    got = expanded(found)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_lists_become_stars(docs):
    base = prose(80, 1).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[i % 80] = f"y{i}"
        rows.append((i, " ".join(w)))
    got = expanded(jaccard.jaccard_join(docs(rows)).collect())
    assert set(got) == set(brute(rows, jaccard.THRESHOLD))


def test_odd_rows(docs):
    text = prose(30, 3)
    rows = [(None, text), (1, None), (2, ""), (3, " !? "), (4, text), (4, text), (5, text), (6, "short")]
    assert {(r.doc_a, r.doc_b) for r in jaccard.jaccard_join(docs(rows)).collect()} == {(4, 5)}
    assert jaccard.jaccard_join(docs([])).collect() == []


def test_groups_keep_the_least(docs):
    rows = corpus()
    parent = {i: i for i, _ in rows}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in brute(rows, jaccard.THRESHOLD):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i, _ in rows if find(i) != i}
    assert {r.doc_id: r.kept_id for r in jaccard.near_duplicates(docs(rows)).collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (60, 59)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 59: 59, 60: 59}
    assert components(edges.where("a > 1000")).count() == 0


def test_classes_and_links_equal_brute_force(docs):
    rows = corpus() + [(200, prose(50, 7)), (200, corpus()[5][1]), (201, prose(50, 7)), (202, ""), (None, prose(50, 7))]
    sets = [(k, s) for k, (i, t) in enumerate(rows) for s in [sets_of([(k, t)]).get(k)] if i is not None and s]
    parent = {i: i for i, _ in rows if i is not None}
    links = dict.fromkeys(parent, 0)

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, (k, a) in enumerate(sets):
        for l, b in sets[x + 1 :]:
            if rows[k][0] != rows[l][0] and len(a & b) / len(a | b) >= jaccard.THRESHOLD:
                u, v = find(rows[k][0]), find(rows[l][0])
                parent[max(u, v)] = min(u, v)
                links[rows[k][0]] += 1
                links[rows[l][0]] += 1
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(docs(rows)).collect()}
    assert got == {i: (find(i), links[i]) for i in parent}
    assert jaccard.classes(docs([])).collect() == []


def test_query_gives_a_row_per_document(docs, tmp_path):
    from emenda.llm import queries

    base = prose(80, 1).split()
    rows = [(i, " ".join([*base[: i % 80], f"y{i}", *base[i % 80 + 1 :]])) for i in range(300)]
    frame = docs(rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op7_ngram_jaccard"](frame.sparkSession, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in got) == [(i, 0, 299) for i in range(300)]


def test_shared_passages_are_no_stars_where_counters_are_full(docs, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "_frequencies", lambda table: np.full(jaccard._COUNTERS, 5000))
    passage = prose(80, 2)
    rows = [(i, f"{prose(120, 1000 + i, 50_000)} {passage}") for i in range(600)] + [(700, prose(120, 1000, 50_000) + " " + passage + " more")]
    _, pairs, edges = jaccard.similar_sets(docs(rows))
    assert edges.where("star = 1").count() == 0
    assert pairs.count() == 1


def test_ngrams_of_some_documents_come_last_on_a_large_input(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [" ".join(f"w{w}" for w in r.integers(0, 10**9, 200)) + " " + shared for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    count, star_table, lists = jaccard._frequencies, jaccard.star_table, []

    def seen(packed, dtype, *rest):
        rows = jaccard.unpack(packed.toArrow().column("blob"), dtype)
        lists.append(np.unique(rows["key"], return_counts=True)[1])
        return star_table(packed, dtype, *rest)

    # beside as many n-grams as some GB of text have
    monkeypatch.setattr(jaccard, "_frequencies", lambda table: count(table) + np.random.default_rng(9).poisson(2**26 / jaccard._COUNTERS, jaccard._COUNTERS))
    monkeypatch.setattr(jaccard, "star_table", seen)
    assert all(x.links == 0 for x in jaccard.classes(df).collect())
    # half of a set's 258 n-grams and a few more are listed: enough others come before the 58 that all share
    assert (lists[0] > 1).sum() < 6 and lists[0].sum() == 30 * (258 - 129 + 4)
