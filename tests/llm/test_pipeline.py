import random

import corpus_pipeline
import pytest

from emenda.llm import runtime

from .conftest import prose, words


@pytest.fixture
def folder(spark, docs, tmp_path):
    passage, item = prose(60, 900), prose(30, 901)
    base = prose(120, 1)
    rows = [(i, prose(100, 10 + i)) for i in range(10)]
    rows += [(20, base), (21, base), (22, base + " extra"), (30, f"{prose(50, 70)} {passage} {prose(50, 71)}"), (31, f"{prose(50, 72)} {passage} {prose(50, 73)}")]
    rows += [(40, f"{prose(40, 74)} {item} {prose(40, 75)}"), (50, "!!! 123"), (51, None), (52, prose(9000, 76)), (None, prose(80, 77))]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_decisions_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = runtime.written(out, name)
        kept.append({r.doc_id for r in docs.collect()})
    every = {*range(10), 20, 21, 22, 30, 31, 40, 50, 51, 52, None}
    assert kept[0] == every - {50, 51}
    assert kept[1] == kept[0] - {21, 22}
    assert kept[2] == kept[1] and kept[3] == kept[2] - {40}
    text = {r.doc_id: r.text for r in docs.collect()}
    passage = prose(60, 900)
    assert passage in text[30] and passage not in text[31] and text[31].startswith(prose(50, 72))
    windows = corpus_pipeline.run(spark, folder).collect()
    assert {i for w in windows for i in w.doc_ids} == kept[3]
    assert len(words(passage)) == 60


def test_no_piece_of_a_passage_or_an_item_passes(spark, docs, tmp_path):
    """Of passages and items that several documents hold, the stages leave no eight words in a row but
    those of the document that keeps the passage."""
    passages, items = [prose(n, 40_000 + n, 100_000) for n in (60, 90, 200)], [prose(n, 41_000 + n, 100_000) for n in (30, 40, 50, 59)]
    rows = [(10 * i + k, f"{prose(200 + 9 * k, 42_000 + 10 * i + k, 100_000)} {p} {prose(210, 43_000 + 10 * i + k, 100_000)}") for i, p in enumerate(passages + items) for k in range(4)]
    rows.append((100, items[3]))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.substrings(spark, docs(rows), str(tmp_path))
    text = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, found, str(tmp_path)).collect()}
    assert 100 not in text and {0, 1, 2, 3, 10, 20} <= set(text)

    def pieces(p):
        w = p.split()
        return {" ".join(w[i : i + 8]) for i in range(len(w) - 7)}

    for i, p in enumerate(passages + items):
        holding = [d for d, t in text.items() if any(x in t for x in pieces(p))]
        assert holding == ([10 * i] if i < len(passages) else [])


def components_of(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(root)}


def test_stages_meet_brute_force(spark, docs, tmp_path):
    """Each stage on what its predecessor kept, against pairs of all documents, all windows and all paragraphs."""
    from emenda.llm import decontaminate, jaccard

    from . import test_decontaminate, test_jaccard, test_substring

    r, wide = random.Random(8), 100_000
    items = [(j, prose(20 + 3 * j, 80_000 + j, wide)) for j in range(4)]
    passages = [prose(70, 81_000 + j, wide) for j in range(4)]
    rows = []
    for i in range(70):
        body = prose(60 + i, 82_000 + i, wide)
        if i % 5 == 1:
            body = f"{body} {r.choice(passages)} {prose(40, 83_000 + i, wide)}"
        if i % 7 == 2:
            body = f"{body} {r.choice(items)[1]} {prose(30, 84_000 + i, wide)}"
        if i % 6 == 3 and i > 10:
            w = r.choice(rows)[1].split()
            w[r.randrange(len(w))] = "other"
            body = " ".join(w)
        rows.append((i, body))
    rows += [(100, rows[3][1]), (101, "12 34"), (102, ""), (103, prose(3, 5, wide)), (None, prose(50, 9, wide)), (None, prose(50, 9, wide))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, docs_):
        return runtime.written(stage(spark, docs_, str(tmp_path)), "stage")

    def plain(found):
        return sorted(((x.doc_id, x.text) for x in found.collect()), key=str)

    given = docs(rows)
    one = run(corpus_pipeline.language, given)
    assert plain(one) == sorted(((i, t) for i, t in rows if any(c.isalpha() for c in t)), key=str)

    two, texts = run(corpus_pipeline.near_duplicates, one), plain(one)
    group = components_of(test_jaccard.brute(texts, jaccard.THRESHOLD))
    assert plain(two) == sorted(((i, t) for i, t in texts if group.get(i, i) == i), key=str)

    three, texts = run(corpus_pipeline.substrings, two), [(i, t) for i, t in plain(two) if i is not None]
    node = [(i, t.split()[k : k + 24]) for i, t in texts for k in test_substring.brute_paragraphs(t)]
    edges = [(a, b) for a in range(len(node)) for b in range(a) if node[a][0] != node[b][0] and test_substring.jaccard(node[a][1], node[b][1]) >= 0.7]
    least = {}
    for v, c in components_of(edges).items():
        least[c] = min(least.get(c, 1 << 60), node[v][0])
    want = {node[v][0] for v, c in components_of(edges).items() if node[v][0] > least[c]}
    after, before = {i: t for i, t in plain(three) if i is not None}, dict(texts)
    cut = {i for i in before if after.get(i) != before[i]}
    assert cut <= want and len(cut) >= 0.9 * len(want) and want
    assert all(len(after.get(i, "").split()) <= len(before[i].split()) - 20 for i in cut)

    four, texts = run(corpus_pipeline.decontamination, three), plain(three)
    bad = {i for i, _ in test_decontaminate.brute(texts, items)}
    kept = plain(four)
    gone = [x for x in texts if x not in kept]
    assert {i for i, _ in gone} <= bad and len(gone) >= 0.9 * len(bad - {None}) and bad
    assert decontaminate.THRESHOLD == 0.7

    pieces = [p for w in corpus_pipeline.windows(spark, four, str(tmp_path)).collect() for p in w.pieces]
    assert sorted(((p.doc_id, p.end - p.start) for p in pieces), key=str) == sorted(((i, len(t)) for i, t in kept), key=str)


def test_empty_tables_and_other_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, spans string, set_id int"
    item = spark.createDataFrame([], "item_id bigint, text string")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    text = prose(80, 3)
    for name, rows in (("none", []), ("some", [(1, text, "en", None, len(text), 7, "s", 8)] * 2 + [(2, text, "en", None, len(text), 9, "t", 10)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        item.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        given = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept = given
        for step, stage in corpus_pipeline.STAGES[:-1]:
            kept = runtime.written(stage(spark, kept, str(tmp_path)), step)
            assert kept.columns == given.columns
        assert [tuple(r) for r in kept.collect()] == rows[:2]
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert [p.doc_id for w in found for p in w.pieces] == [r[0] for r in rows[:2]]


def test_near_duplicates_of_shared_passages_send_few_sets(docs, monkeypatch):
    import numpy as np

    import corpus_pipeline
    from emenda.llm import jaccard

    sent, needed = [], jaccard.needed_stars
    monkeypatch.setattr(jaccard, "_frequencies", lambda table: np.full(jaccard._COUNTERS, 5000))  # as on many GB
    monkeypatch.setattr(jaccard, "needed_stars", lambda edges: sent.append(needed(edges)) or sent[0])
    monkeypatch.setattr(jaccard, "discard", lambda table: None)
    passage = prose(80, 2)
    rows = [(i, f"{prose(120, 1000 + i, 50_000)} {passage}") for i in range(600)] + [(700, prose(120, 1000, 50_000) + " " + passage + " more")]
    frame = docs(rows)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(frame.sparkSession, frame, "").collect()} == set(range(600))
    assert sent[0].count() == 2


def test_workers_hold_little_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from emenda.llm import jaccard, substring, textvec

    def peak(work):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 2**20

    column = pa.array([prose(400, i) for i in range(20)] * 50)
    pack = runtime.Packer(4, jaccard._KEY)
    assert peak(lambda: [w.first for w in textvec.words(column)]) < 24
    assert peak(lambda: [list(pack.add(np.arange(i, i + 50_000, dtype=np.uint64))) for i in range(120)]) < 50
    rows = np.zeros(400_000, substring._PLACE)
    rows["key"] = textvec.mix(np.arange(len(rows), dtype=np.uint64) // np.uint64(3)) ^ np.arange(len(rows), dtype=np.uint64) % np.uint64(3)
    rows["doc"] = np.arange(len(rows))
    assert peak(lambda: substring.band_stars(rows)) < 5 * rows.nbytes / 2**20
