import gzip
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from emenda.llm import decontaminate, html, langid, licenses, packing, substring, topk, toxicity, warc

from .conftest import prose


# ---- language ID


def reference_bundle(text, dimensions):
    """Bundle of a text by the definition, trigram by trigram."""
    letters, vectors = langid._tables(dimensions)
    sym = []
    for c in text:
        s = int(letters[ord(c)]) if ord(c) < len(letters) else 0
        if s or not sym or sym[-1]:
            sym.append(s)
    out = np.zeros(dimensions)
    for a, b, c in zip(sym, sym[1:], sym[2:]):
        if a or b or c:
            out += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return out


def test_bundles_by_definition():
    texts = ["Hello world", "", None, "été à  la\nplage 12", "日本語 x", "ab", "a" * 500, "𐐨𐐩𐐪 𐐨", "a😀b"]
    got = np.concatenate([b for _, b, _ in langid.bundles(pa.array(texts), 64)])
    for t, g in zip(texts, got):
        assert np.allclose(reference_bundle(t or "", 64), g)


def language_rows(n, seed):
    r = random.Random(seed)
    parts = {"aa": ["tion", "the", "ing", "and", "er"], "bb": ["sch", "ung", "der", "ein", "keit"], "cc": ["eux", "oir", "que", "les", "ment"]}
    return [(i, " ".join("".join(r.choices(parts[k], k=2)) for _ in range(40)), k) for i, k in ((i, r.choice(list(parts))) for i in range(n))]


def test_held_out_accuracy(docs):
    train, test = language_rows(120, 1), language_rows(90, 2)
    model = langid.fit(docs(train), sample=30)
    got = {r.doc_id: r for r in langid.identify(docs(test), model).collect()}
    assert sum(got[i].language == k for i, _, k in test) >= 0.95 * len(test)
    assert all(r.accepted for r in got.values())


def test_classes_by_brute_force(docs):
    """Languages, similarities and acceptance of every row, from bundles by the definition."""
    names, proto = model = langid.fit(docs(language_rows(90, 1)), sample=30)
    rows = [(i, t) for i, t, _ in language_rows(20, 4)] + [(100 + i, t) for i, t in enumerate(["the", "der.", "x", "zqxj kvwp", "les que", "12", "𐐨𐐩𐐪"])]
    for r in langid.identify(docs(rows), model).collect():
        v = reference_bundle(dict(rows)[r.doc_id], proto.shape[1])
        cos = proto @ v / (np.linalg.norm(v) or 1)
        sym = re.sub(r"[^a-z𐐨𐐩𐐪]+", " ", dict(rows)[r.doc_id].lower())
        least = langid.MIN_SIMILARITY * min(max(len(sym) - 2, 0) / langid.ENOUGH, 1) ** 0.5
        assert r.similarity == pytest.approx(max(cos.max(), 0), abs=2e-5) and r.accepted == (cos.max() > 0 and cos.max() >= least)
        assert r.language == (names[int(cos.argmax())] if cos.max() > 0 else None)


def test_short_texts_of_a_language_are_kept(docs):
    model = langid.fit(docs(language_rows(120, 1)), sample=30)
    short = [(i, " ".join(t.split()[:2]), k) for i, t, k in language_rows(60, 5)]
    assert langid.accepted(docs(short), model).count() >= 58


def test_any_column_names_pass(spark):
    frame = spark.createDataFrame([(1, "the tion ing and", 2, 3)], "doc_id bigint, text string, `a.b` int, accepted int")
    model = langid.fit(frame.selectExpr("doc_id", "text", "'en' as lang"))
    out = langid.accepted(frame, model)
    assert out.columns == frame.columns and out.count() == 1
    item = spark.createDataFrame([(1, prose(20, 3))], "item_id bigint, text string")
    for kept in (decontaminate.clean(frame, item), substring.without_repeats(frame)):
        assert kept.columns == frame.columns and kept.collect() == frame.collect()


def test_language_of_odd_rows(docs):
    model = langid.fit(docs(language_rows(60, 1)))
    rows = [(None, "the tion ing and er the ing"), (1, None), (2, ""), (3, "123 !!"), (4, "the tion and " * 30_000), (4, "the tion and")]
    got = langid.identify(docs(rows), model).collect()
    assert [(r.doc_id, r.accepted) for r in got] == [(None, True), (1, False), (2, False), (3, False), (4, True), (4, True)]
    assert got[1].language is None and got[1].similarity == 0
    assert langid.accepted(docs(rows), model).columns == docs(rows).columns
    assert langid.accepted(docs(rows), model).count() == 3
    assert langid.identify(docs([]), model).count() == 0
    none = langid.fit(docs([]))
    assert {r.accepted for r in langid.identify(docs(rows), none).collect()} == {False}


# ---- packing


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        room = min(fit) if fit else capacity
        if fit:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64, 100])
    lengths = [r.randint(1, capacity - 1) for _ in range(r.randint(0, 200))]
    runs, windows = packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    fill, seen = {}, {}
    for n, first, count, window, per, offset in runs:
        assert seen.get(n, 0) == first
        seen[n] = first + count
        for i in range(count):
            w = window + i // per
            assert fill.get(w, 0) == offset + n * (i % per)
            fill[w] = fill.get(w, 0) + n
    assert {n: lengths.count(n) for n in set(lengths)} == seen
    assert windows == len(fill) and sorted(capacity - v for v in fill.values()) == best_fit(lengths, capacity)


def test_packed_windows_hold_all_text(docs):
    enc = packing.encoding(packing.TOKENIZERS, packing.VOCABULARY)
    rows = [(i, prose(5 + 7 * i % 90, i)) for i in range(60)] + [(70, prose(900, 1)), (71, "日本語テキスト" * 200), (72, None), (73, ""), (None, "no id here"), (74, "same"), (74, "same")]
    got = packing.packed(docs(rows), capacity=64, share_pieces=3).collect()
    text = {i: t for i, t in rows if i is not None}
    spans, lengths = {}, []
    for w in got:
        at = 0
        for p in w.pieces:
            assert p.offset == at
            at += p.tokens
            spans.setdefault(p.doc_id, []).append((p.piece, p.start, p.end, p.tokens))
        assert at == w.tokens <= 64
    for i, t in text.items():
        if t and i != 74:
            own = sorted(spans[i])
            assert "".join(t[a:b] for _, a, b, _ in own) == t
            assert sum(n for *_, n in own) == len(enc.encode_ordinary(t))
            assert all(n == 64 for *_, n in own[:-1])
    assert len(spans[74]) == 2 and len(spans[None]) == 1 and not {72, 73} & set(spans)
    for _, t in rows:
        n = len(enc.encode_ordinary(t or ""))
        lengths += [64] * (n // 64) + [n % 64] * (n % 64 > 0)
    assert sorted(64 - w.tokens for w in got) == best_fit(lengths, 64)
    assert packing.packed(docs([])).collect() == []


def test_segment_tree():
    tree, rooms, r = packing.Segments(50), {}, random.Random(1)
    for _ in range(500):
        v = r.randint(1, 50)
        rooms[v] = rooms.get(v, 0) + 1
        tree.add(v, 1)
        if r.random() < 0.6:
            gone = r.choice([k for k, n in rooms.items() if n])
            rooms[gone] -= 1
            tree.add(gone, -1)
        least = r.randint(1, 50)
        assert tree.tightest(least) == min((k for k, n in rooms.items() if n and k >= least), default=None)


# ---- licences


def test_spans_equal_those_of_the_whole_text():
    """The seeds lose nothing: searching whole texts by the regex library alone gives the same."""
    notices = {"a": "Released under the MIT License", "b": "All rights reserved", "c": "This work is licensed under the GNU General Public License, version 3"}
    scanner, r = licenses.Scanner(notices), random.Random(4)
    for k in range(60):
        parts = []
        for _ in range(4):
            parts.append(prose(r.randrange(12), k))
            n = list(r.choice(list(notices.values())))
            for _ in range(r.randrange(9)):
                i = r.randrange(len(n))
                n[i : i + r.randrange(2)] = r.choice(["", "x", "  "])
            parts.append("".join(n))
        text = r.choice(["\n", " "]).join(parts)
        flat = scanner.flat(text)
        want = sorted(((n, s, e, *d) for p, (n, *_) in enumerate(scanner.patterns) for s, e, d in scanner.matches(p, flat, 0, len(flat))), key=lambda x: (x[1], x[2], x[0]))
        assert [(m[0], sum(m[3:])) for m in scanner.scan(text)] == [(m[0], sum(m[3:])) for m in want]


def test_license_rows(docs):
    rows = [(None, "All rights reserved"), (1, None), (2, ""), (3, "x\nAll right reserved."), (3, "x\nAll right reserved."), (4, prose(20_000, 1) + " LICENSED UNDER\tthe Apache License, Version 2.0"), (5, "İ released under the MIT Licence")]
    got = licenses.scan(docs(rows)).collect()
    assert [(r.doc_id, r.notice, r.edits) for r in got] == [(3, "all-rights", 1), (3, "all-rights", 1), (4, "Apache-2.0", 0), (5, "MIT", 1)]
    assert got[0].matched == "All right reserved" and got[0].start == 2
    assert licenses.scan(docs([])).count() == 0


# ---- toxicity


def test_clauses_not_words():
    s = toxicity.Scorer(dict(toxicity.INSULTS), {})
    score = {t: s.score(t)[0] for t in ("you are an idiot", "an idiot box", "you are not an idiot", 'he said "you idiot"', "I will kill you", "kill the process", "the cat sat", "idiotic", "you idiot, you moron")}
    assert score["you are an idiot"] > score["an idiot box"] >= toxicity.THRESHOLD
    assert score["you are not an idiot"] < toxicity.THRESHOLD and score['he said "you idiot"'] < score["you are an idiot"]
    assert score["I will kill you"] >= toxicity.THRESHOLD and score["kill the process"] == score["the cat sat"] == score["idiotic"] == 0
    assert score["you idiot, you moron"] > score["you are an idiot"]


def test_machine_is_the_product_of_its_parts():
    parts = (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)
    g, r = toxicity.Grammar(*parts), random.Random(1)
    for _ in range(300):
        clause = [(r.choice(toxicity.SYMBOLS), 1.0) for _ in range(r.randrange(9))]
        states, total = [0] * 5, 0.0
        for symbol, weight in clause:
            moves = [p.go(x, symbol) for p, x in zip(parts, states)]
            states = [m[0] for m in moves]
            total += weight * math.prod(m[1] for m in moves) if symbol == "insult" else 0
        ends = [p.final.get(x, (1.0, 0.0)) for p, x in zip(parts, states)]
        assert g.weigh(clause) == pytest.approx((total + sum(e[1] for e in ends)) * math.prod(e[0] for e in ends))


def test_learned_insults_and_odd_rows(spark, docs):
    rows = [(i, prose(30, i) + (" blorkface zingo" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    scorer = toxicity.fit(docs(rows), labels)
    assert "blorkface" in scorer.words and "blork" in scorer.beginnings
    new = [(None, "blorkface"), (1, None), (2, ""), (3, "a blorkface"), (3, "a blorkface"), (4, prose(20_000, 2) + ". you blorkish"), (5, prose(50, 3))]
    got = toxicity.toxic(docs(new), scorer).collect()
    assert [r.doc_id for r in got] == [3, 3, 4] and got[2].clause.endswith("you blorkish")
    assert toxicity.toxic(docs([]), scorer).count() == 0
    assert toxicity.fit(docs(rows), labels.where("doc_id < 0")).words == toxicity.INSULTS


def test_scores_by_brute_force(docs):
    """Documents found, and their scores, by running the machine over all clauses of all texts."""
    s, r = toxicity.Scorer(dict(toxicity.INSULTS), {"blork": 1.0}), random.Random(6)
    bag = "you are an idiot moron not never said he kill will the cat sat . , ! ; \n \" blorkish blorkface fine table".split(" ")
    rows = [(i, " ".join(r.choice(bag) for _ in range(r.randrange(60)))) for i in range(200)]
    want = {}
    for i, t in rows:
        total, heaviest = 0.0, 0.0
        for clause in re.split(r"[.!?;:\n]", t):
            symbols = [s.read(m.group()) for m in toxicity._WORD.finditer(clause)]
            trigger = any(w in toxicity.WORDS["threat"].split() or s.read(w)[0] == "insult" for w in re.findall(r"[^\W\d_]+", clause))
            weight = s.grammar.weigh(symbols) if trigger else 0
            total, heaviest = total + max(weight, 0), max(heaviest, weight)
        if total >= toxicity.THRESHOLD:
            want[i] = (pytest.approx(total, abs=1e-5), heaviest)
    got = toxicity.toxic(docs(rows), s).collect()
    assert {r.doc_id: r.score for r in got} == {i: x for i, (x, _) in want.items()}
    for r in got:
        assert s.score(r.clause)[0] == pytest.approx(want[r.doc_id][1]) and dict(rows)[r.doc_id][r.start : r.end].strip() == r.clause


def test_commas_do_not_part_what_belongs_together():
    s = toxicity.Scorer(dict(toxicity.INSULTS), {})
    assert s.score('he said, "you idiot"')[0] == s.score('he said "you idiot"')[0] and s.score("you, idiot")[0] == s.score("you idiot")[0]


# ---- top-k


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 12)).astype(np.float32)
    x[20:40] = x[:20]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(0, x[0].tolist(), 1), (None, x[1].tolist(), 1), (900, None, 1), (901, [1.0], 1), (903, [2.0], 1), (904, [-1.0], 1), (905, [1.0, 1.0], 1), (906, [], 1), (902, [float("nan")] * 12, 1)], "vec_id bigint, embedding array<float>, block int")
    got = {}
    for row in topk.top_k(frame, k=5, block_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    score = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 9)
    want = {i: sorted((j for j in range(150) if j != i), key=lambda j: (-score[i, j], j))[:5] for i in range(150)}
    # vectors of another length are compared with one another
    want |= {901: [903, 904], 903: [901, 904], 904: [901, 903]}
    assert got == want
    assert topk.top_k(frame.where("vec_id > 5000")).count() == 0
    assert topk.top_k(frame.where("vec_id < 3"), k=10).groupBy("query_id").count().collect() and topk.top_k(frame.where("vec_id < 3")).count() == 6


def test_searches_of_the_query_are_ids_divisible_by_50_over_all_rows(spark, tmp_path):
    from emenda.llm import queries

    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(230, 8)), 1).astype(np.float32)
    ids = [i - 100 for i in range(230)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(50, x[3].tolist()), (1001, [1.0]), (1050, [2.0, 1.0]), (1051, [1.0, 1.0]), (None, x[0].tolist())]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for row in queries.queries()["op9_topk"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    score = {}
    for q, a in rows:
        for j, b in rows:
            if q is not None and j is not None and q % 50 == 0 and q != j and len(a) == len(b):
                score[q, j] = max(score.get((q, j), -1e9), round(float(np.float64(a) @ np.float64(b)), 9))
    want = {q: sorted((j for p, j in score if p == q), key=lambda j: (-score[q, j], j))[:10] for q in {q for q, _ in score}}
    assert got == want and set(got) == {-100, -50, 0, 50, 100, 1050}
    frame = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    few = topk.top_k(frame, k=10, block_rows=3, every=50).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == sorted((q, n + 1, j) for q, js in want.items() for n, j in enumerate(js))


# ---- HTML


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>Away</a></ul></nav>
<div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p>First long paragraph with a fair number of words in it.<p>Second <b>long</b> paragraph, which also has a fair number of words.<script>var a = "<p>no</p>"</script></article>
<footer>&copy; <a href=z>site</a></footer></body></html>"""


def test_article_is_found():
    text, best, threshold = html.extract(PAGE)
    assert text.split("\n") == ["Title & more", "First long paragraph with a fair number of words in it.", "Second long paragraph, which also has a fair number of words."]
    assert best > threshold > 0


def test_counts_by_recursion():
    """Counts and sums of every node, by plain recursion over the tree."""
    body = html.parse(PAGE)
    html.score(body)

    def count(n):
        c = [sum(len(x.strip()) for x in n.parts if isinstance(x, str)), 0, 0, 0]
        if n.link:
            c[2] = c[0]
        total = 0.0
        for x in n.parts:
            if not isinstance(x, str):
                d = count(x)
                c = [c[0] + d[0], c[1] + d[1] + 1, c[2] + d[2], c[3] + d[3] + x.link]
                total += x.density
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == tuple(c) and n.total == pytest.approx(total)
        return c

    count(body)


def test_odd_pages(spark):
    pages = ["", "plain text", "<p>", "<b><i>x</b></i>", "<a href='>'>q</a>", "<div" * 50, "<!-- open", "<script>never closed", None, "<p>" * 3000 + "deep"]
    frame = spark.createDataFrame([(i if i else None, None, p, "x") for i, p in enumerate(pages)], "page_id bigint, url string, html string, text string")
    got = [r.text for r in html.extract_text(frame).collect()]
    assert got[:4] == ["", "plain text", "", "x"] and got[8] is None and got[9] == "deep"
    assert html.extract_text(frame.where("page_id > 99")).count() == 0


# ---- WARC


def test_round_trip_of_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>", "d"), (2, "http://b", "<p>é</p>", "d"), (3, None, None, "d"), (None, "http://c", "", "d"), (1, "http://a", "<p>é</p>", "d")], "page_id bigint, url string, html string, digest string")
    records = warc.page_records(pages)
    headers, store = warc.archive(records)
    assert store.count() == 2 and sorted(r.copies for r in store.collect()) == [1, 3]
    want = sorted(bytes(r.header) + bytes(r.payload or b"") + warc.END for r in records.collect())
    rebuilt = warc.reconstruct(headers, store).collect()
    assert sorted(bytes(r.record) for r in rebuilt) == want and all(r.verified for r in rebuilt)
    bad = store.selectExpr("digest", "cast('wrong' as binary) payload", "copies", "verified")
    assert sorted(r.verified for r in warc.reconstruct(headers, bad).collect()) == [False, False, False, False, True]
    (tmp_path / "a.warc").write_bytes(b"".join(want))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(w) for w in want))
    (tmp_path / "c.warc").write_bytes(want[0][:-8])
    long = b"WARC/1.1\r\nContent-Length: 3000000\r\n\r\n" + bytes(range(250)) * 12_000 + warc.END
    (tmp_path / "d e.warc.gz").write_bytes(gzip.compress(long + want[0]) + gzip.compress(want[1])[:-9])
    back = warc.read(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        assert [bytes(r.header) + bytes(r.payload) + warc.END for r in sorted((r for r in back if r.path.endswith(name)), key=lambda r: r.place)] == want
    assert [bytes(r.header) + bytes(r.payload) + warc.END for r in sorted((r for r in back if "e.warc.gz" in r.path), key=lambda r: r.place)][:2] == [long, want[0]]
    for size in (1, 7, 100):
        for data in (b"".join(want), b"".join(map(gzip.compress, want))):
            assert [h + p + warc.END for _, h, p in warc.split(data, size)] == want
    trip = warc.round_trip(pages).collect()
    assert all("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in r.record for r in trip)
    assert len(trip) == 5 and all(r.verified for r in trip)
    assert {r.digest for r in trip if r.length} == {hashlib.sha256("<p>é</p>".encode()).hexdigest()}
    assert all(re.match(r"WARC/1.1\r\n", r.record) for r in trip)
    assert warc.round_trip(pages.where("page_id > 9")).count() == 0
