import random
import re

import numpy as np
import pyarrow as pa

from emenda.llm import substring
from emenda.llm.textvec import words as arrow_words

from .conftest import prose, words


def brute_paragraphs(text):
    """First words of the paragraphs of a text, by the definition."""
    w = list(arrow_words(pa.array([text])))
    if not w:
        return []
    s, _ = w[0].shingles(3)
    s = s.tolist()
    n = len(w[0].hash)
    chosen = set()
    for a in range(-(substring.WINNOW - 1), len(s)):
        run = [(s[i], i) for i in range(max(a, 0), min(a + substring.WINNOW, len(s)))]
        least = min(run)[0]
        chosen |= {i for v, i in run if v == least}
    return sorted(i for i in chosen if i + substring.PARAGRAPH <= n)


def test_anchors_follow_the_definition():
    for k in (5, 16, 17, 40, 300):
        text = prose(k, k)
        first = [int(f) for w in arrow_words(pa.array([text])) for f in substring.paragraphs(w)[1]]
        assert first == brute_paragraphs(text)


def test_shared_passages_go_and_the_rest_stays(docs):
    passage = prose(60, 1000)
    rows = [(i, f"{prose(30 + i, i)} {passage} {prose(25 + i, 50 + i)}") for i in range(6)] + [(10 + i, prose(90, 200 + i)) for i in range(6)]
    spans = {}
    for r in substring.repeated(docs(rows)).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.kept_doc_id))
    assert set(spans) == {1, 2, 3, 4, 5}
    text = dict(rows)
    for i, found in spans.items():
        gone = " ".join(text[i][a:b] for a, b, _ in sorted(found))
        assert all(k == 0 for *_, k in found)
        assert gone in passage or all(text[i][a:b] in passage for a, b, _ in found)
        assert len(gone.split()) >= 20
    kept = {r.doc_id: r.text for r in substring.without_repeats(docs(rows)).collect()}
    assert sum(passage in t for t in kept.values()) == 1 and kept[0] == text[0]
    assert all(kept[10 + i] == text[10 + i] for i in range(6))


def test_near_paragraphs_meet_brute_force(docs):
    """Of pairs of edited paragraphs that reach the threshold, at least nine in ten share a cluster."""
    passages = [prose(48, 300 + i).split() for i in range(60)]
    rows = []
    for i, p in enumerate(passages):
        edited = list(p)
        edited[0] = "zzz"
        rows += [(2 * i, " ".join(p)), (2 * i + 1, " ".join(edited))]
    hit = {r.doc_id for r in substring.repeated(docs(rows)).collect()}
    assert len(hit & set(range(1, 120, 2))) >= 54


def test_bands_meet_nearly_all_pairs_at_the_threshold():
    """Paragraphs with two edited words, at 19/27, collide in a band nineteen times in twenty at least."""
    met = []
    for i in range(600):
        a = prose(24, 5000 + i, 100_000).split()
        b = list(a)
        b[4 + i % 8] = b[14 + i % 7] = "zzz"
        keys = []
        for text in (a, b):
            w = next(iter(arrow_words(pa.array([" ".join(text)]))))
            keys.append(substring._bands(w, np.zeros(1, np.int64), substring.tuned())[0].tolist())
        met.append(any(x == y for x, y in zip(*keys)))
    assert sum(met) >= 0.93 * len(met) and substring.tuned() == 11


def left_over(spans, text, doc, first, size):
    """Words first ... first + size - 1 of a text that no span covers."""
    at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)][first : first + size]
    return sum(not any(s <= a and b <= e for s, e in spans.get(doc, [])) for a, b in at)


def spans_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.start, r.end))
    return out


def test_equal_passages_go_to_their_ends(docs):
    """Of passages of 50 to 500 words nothing stays in the later documents, and nothing else goes."""
    rows, wide = [], 100_000
    for i, size in enumerate([50, 52, 55, 60, 75, 100, 200, 500] * 5):
        passage = prose(size, 7000 + i, wide)
        for k in range(3):
            rows.append((3 * i + k, f"{prose(20 + 7 * k, 10 * i + k, wide)} {passage} {prose(35 + k, 90_000 + 10 * i + k, wide)}"))
    spans, sizes = spans_of(substring.repeated(docs(rows)).collect()), [50, 52, 55, 60, 75, 100, 200, 500] * 5
    assert not any(3 * i in spans for i in range(40))
    for i, size in enumerate(sizes):
        for k in (1, 2):
            text, doc = rows[3 * i + k][1], 3 * i + k
            assert left_over(spans, text, doc, 20 + 7 * k, size) == 0
            assert sum(len(text[s:e].split()) for s, e in spans[doc]) <= size + 4


def edited(passage, seed):
    """The passage with a word replaced, added or left out at a random place, and that place."""
    r, p = random.Random(seed), passage.split()
    at = r.randrange(len(p))
    p[at : at + 1] = [["zzz"], ["zzz", p[at]], []][seed % 3]
    return " ".join(p), at


def test_passages_with_an_edit_anywhere_are_found_whole(docs):
    """All passages of 60 words with an edited word share 24-word windows at the threshold: nineteen in
    twenty are found, and of these all words go up to an edit that is near an end."""
    rows, sizes, places = [], [], []
    for i in range(120):
        passage = prose(60, 20_000 + i, 100_000)
        other, at = edited(passage, i)
        rows += [(2 * i, f"{prose(40, 30_000 + i, 100_000)} {passage} {prose(40, 31_000 + i, 100_000)}"), (2 * i + 1, f"{prose(30, 32_000 + i, 100_000)} {other} {prose(30, 33_000 + i, 100_000)}")]
        sizes.append(len(other.split()))
        places.append(at)
    spans = spans_of(substring.repeated(docs(rows)).collect())
    found = [i for i in range(120) if 2 * i + 1 in spans]
    assert len(found) >= 114
    for i in found:
        left = left_over(spans, rows[2 * i + 1][1], 2 * i + 1, 30, sizes[i])
        assert left == 0 or min(places[i], 60 - places[i]) <= substring.REJOIN and left <= substring.REJOIN + 2


def test_odd_rows(docs):
    p = prose(50, 9)
    rows = [(None, p), (None, p), (1, None), (2, ""), (3, p), (3, p), (4, "is " * 500), (5, prose(20_000, 8)), (6, p)]
    found = substring.repeated(docs(rows)).collect()
    assert {r.doc_id for r in found} == {6}
    out = substring.without_repeats(docs(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 3, 4, 5, 6)]
    assert out[0].hub == 1 and sum(r.doc_id is None for r in out) == 2
    assert substring.repeated(docs([])).collect() == []
    whole = substring.without_repeats(docs([(1, p), (2, p)])).collect()
    assert all(r.n_chars == len(r.text) for r in whole)


def test_sliding():
    x = np.random.default_rng(1).integers(0, 100, 50)
    for w in (1, 2, 7, 16, 34):
        assert substring.sliding(np.minimum, x, w).tolist() == [x[i : i + w].min() for i in range(50 - w + 1)]


def test_words_are_those_of_the_regex():
    text = "Àé façade, x_y 1.2\tŽ日本 ß end"
    assert sum(len(w.hash) for w in arrow_words(pa.array([text, None, "", "B"]))) == len(words(text)) + 1


def test_clashing_columns(spark):
    p = prose(60, 11)
    rows = [(1, f"{prose(30, 1)} {p} {prose(30, 2)}", 7, "x", 5), (2, f"{prose(30, 3)} {p} {prose(30, 4)}", 8, "y", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, spans int, `__spans` string, `a.b` int")
    out = {r.doc_id: tuple(r) for r in substring.without_repeats(frame).collect()}
    assert substring.without_repeats(frame).columns == frame.columns
    assert out[1] == rows[0] and out[2][2:] == (8, "y", None) and out[2][1].split() == (prose(30, 3) + " " + prose(30, 4)).split()


def jaccard(a, b):
    a, b = (set(zip(x, x[1:])) for x in (a, b))
    return len(a & b) / len(a | b)


def test_clusters_by_brute_force(docs):
    """Of all paragraphs of all texts, by the definition: documents that have a paragraph in a cluster with an
    earlier document's lose words (nineteen in twenty), and no other document does."""
    r, rows = random.Random(12), []
    passages = [prose(70, 50_000 + i, 100_000).split() for i in range(12)]
    for i in range(90):
        w = list(r.choice(passages)) if i % 3 else prose(70, 60_000 + i, 100_000).split()
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        rows.append((i, " ".join(prose(r.randrange(40), 61_000 + i, 100_000).split() + w + prose(r.randrange(40), 62_000 + i, 100_000).split())))
    node = [(i, t.split()[k : k + substring.PARAGRAPH]) for i, t in rows for k in brute_paragraphs(t)]
    root = list(range(len(node)))

    def find(v):
        return v if root[v] == v else find(root[v])

    for a in range(len(node)):
        for b in range(a):
            if node[a][0] != node[b][0] and jaccard(node[a][1], node[b][1]) >= substring.THRESHOLD:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    want = {i for v, (i, _) in enumerate(node) if node[find(v)][0] < i}
    got = {x.doc_id for x in substring.repeated(docs(rows)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 40


def test_one_word_edited_at_every_distance(docs):
    """Copies of 120 words with one word replaced every k: found at every k from 12 on, and nearly all of
    it goes from 20 on."""
    for k, least in ((12, 0.8), (15, 0.85), (20, 0.9), (30, 0.9)):
        rows, gone = [], 0
        for i in range(40):
            w = prose(120, 70_000 + i, 100_000).split()
            e = [f"edit{j}" if j % k == k // 2 else x for j, x in enumerate(w)]
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(e))]
        for doc, spans in spans_of(substring.repeated(docs(rows)).collect()).items():
            text = rows[doc][1]
            gone += sum(any(s <= m.start() and m.end() <= e for s, e in spans) for m in re.finditer(r"\S+", text))
        print(k, gone / (40 * 120))
        assert gone >= least * 40 * 120


def test_stars_by_brute_force():
    """Leaders and all others of their stars, whatever the star's size."""
    r = np.random.default_rng(4)
    for n, t in ((2, 0.8), (3, 0.7), (9, 0.8), (60, 0.7), (300, 0.8), (300, 0.7), (300, 0.5)):
        base = r.integers(1, 1 << 31, (max(n // 8, 1), substring.PARAGRAPH), dtype=np.uint32)
        line = np.zeros((n, 2 * substring.CONTEXT + substring.PARAGRAPH), np.uint32)
        own = base[r.integers(0, len(base), n)]
        edits = r.random(own.shape) < 0.06
        line[:, substring.CONTEXT : substring.CONTEXT + substring.PARAGRAPH] = np.where(edits, r.integers(1, 1 << 31, own.shape), own)
        star, doc = np.sort(r.integers(0, max(n // 20, 1), n)), r.integers(0, n, n)
        got = set(zip(*(x.tolist() for x in substring.similar_in_stars(star, doc, line, t))))
        w, want = line[:, substring.CONTEXT : substring.CONTEXT + substring.PARAGRAPH].tolist(), set()
        for s in np.unique(star):
            rows, linked = np.flatnonzero(star == s).tolist(), set()
            for a in rows:
                if a not in linked:
                    hits = {b for b in rows if doc[a] != doc[b] and jaccard(w[a], w[b]) >= t}
                    want |= {(a, b) for b in hits}
                    linked |= {a} | hits
        # a pair of two leaders may come once, from either
        assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want}
