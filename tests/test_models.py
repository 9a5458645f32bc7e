"""Folds and searches against plain models of their definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from emenda import catalog
from emenda.functions import text as T
from emenda.operators import decision, lattice, rebuild, sequences, spans


def test_accent_map():
    assert len(T.ACCENTS) == 134 and T.ACCENTS["ữ"] == "u" and T.ACCENTS["Đ"] == "D" and "ç" not in T.ACCENTS and "ö" not in T.ACCENTS


def first_fit(found, length):
    at, out = 0, []
    for s in sorted(found, key=lambda s: (s[0], -s[3], s[0] - s[1], s[2])):
        if 0 <= s[0] < s[1] <= length and s[0] >= at:
            out.append(s)
            at = s[1]
    return out


def test_conflicts_are_resolved_by_first_fit(spark):
    r, rows = random.Random(1), []
    for i in range(60):
        rows.append((i, [(a := r.randrange(30), a + r.randrange(6), f"k{r.randrange(3)}", r.randrange(4), "v") for _ in range(r.randrange(9))]))
    df = spark.createDataFrame(rows, f"id int, s {spans.SPAN}").select("id", spans.resolve(F.col("s"), F.lit(28)).alias("s"))
    got = {x.id: [tuple(s)[:4] for s in x.s] for x in df.collect()}
    assert got == {i: [s[:4] for s in first_fit(found, 28)] for i, found in rows}


def test_masks_round_trip(spark):
    texts = ["2'-FL, DHA, 120ml, $25.99, 10%", "mail a.b@c.example or https://x.example/y?z=1 40°C", "", "không có gì", "AB-12 AB-12 2024-01-02"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in spans.protect(df).select("text", "masked", spans.restore(F.col("masked"), F.col("spans")).alias("back")).collect():
        assert r.back == r.text
    masked = {r.doc_id: r.masked for r in spans.protect(df).collect()}
    assert "DHA" not in masked[0] and "120" not in masked[0] and "25.99" not in masked[0] and "10%" not in masked[0] and "⟪EMAIL_0⟫" in masked[1]


def test_changes_are_resolved_by_confidence(spark):
    r, rows = random.Random(2), []
    for i in range(60):
        rows.append((i, sorted((a := r.randrange(20), a + 1 + r.randrange(5), "o", "r", r.randrange(5) / 5, "x") for _ in range(r.randrange(8)))))
    got = {x.id: [tuple(c) for c in x.c] for x in spark.createDataFrame(rows, f"id int, c {rebuild.CHANGE}").select("id", rebuild.resolve(F.col("c")).alias("c")).collect()}
    for i, changes in rows:
        kept = []
        for c in sorted(changes, key=lambda c: -c[4]):
            if all(c[1] <= k[0] or k[1] <= c[0] for k in kept):
                kept.append(c)
        assert got[i] == sorted(kept)


def test_best_path_of_a_lattice(spark):
    r = random.Random(3)
    edges, islands = [], []
    for i in range(30):
        n = r.randrange(1, 6)
        islands.append((i, 0, n))
        for a in range(n):
            for b in range(a + 1, n + 1):
                if r.random() < 0.4:
                    edges.append((i, 0, a, b, f"{a}-{b}", round(r.random() * 4, 2), round(r.random() / 2, 2)))

    def best(i, at, n):
        if at == n:
            return (0.0, 0.0)
        options = [(best(i, at + 1, n))] + [(s + best(i, b, n)[0], -k + best(i, b, n)[1]) for e, _, a, b, _, s, k in edges if e == i and a == at]
        return max(options)

    e = spark.createDataFrame(edges, "doc_id int, island int, start_pos int, end_pos int, output string, score double, risk double")
    d = spark.createDataFrame(islands, "doc_id int, island int, n int")
    for x in lattice.decode(e, d).collect():
        score, safe = best(x.doc_id, 0, x.n)
        assert x.score == pytest.approx(score) and x.risk == pytest.approx(-safe)


def test_beam_is_exhaustive_when_wide():
    r = random.Random(4)
    for _ in range(40):
        originals = [r.choice("abcd") for _ in range(r.randrange(1, 5))]
        choices = [[(o, 0.1)] + [(c, round(r.random(), 3)) for c in "xyz"[: r.randrange(4)]] for o in originals]
        table = {(a, b): round(r.random(), 3) for a in "abcdxyz" for b in "abcdxyz"}

        def score(t):
            return sum(dict(c)[x] for c, x in zip(choices, t)) + sum(table[a, b] for a, b in zip(t, t[1:]))

        every = [tuple(x[0] for x in p) for p in itertools.product(*choices)]
        found = sequences.beam(originals, choices, lambda a, b: table[a, b], 1000)
        assert {t for t, _ in found} == set(every) and all(s == pytest.approx(score(t)) for t, s in found)
        narrow = sequences.beam(originals, choices, lambda a, b: table[a, b], 2)
        assert tuple(originals) in {t for t, _ in narrow}
        assert {t for t, _ in sequences.product(originals, choices)} == set(every)


def test_position_lists_reach_the_original():
    choices = [(f"c{i}", 1 - i / 20) for i in range(12)] + [("o", 0.1)]
    assert sequences.position_choices("o", choices, 3)[-1] == ("o", 0.1) and len(sequences.position_choices("c0", choices, 3)) == 3


def test_thresholds():
    with pytest.raises(ValueError):
        decision.Thresholds(0.7, 0.1, 0.2)


def test_short_documents_of_any_id_are_corrected(spark, tmp_path):
    text = "một hai ba bốn năm sáu bảy tám"
    rows = [(i, text + " chín" * (i % 3), len(text) + 5 * (i % 3)) for i in (1, 199, 200, 5000, 10**12)] + [(7, text * 20, 600)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["correct_documents"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 199, 200, 5000, 10**12} and all(r.status == "ok" for r in got)


def test_distance_equals_the_matrix():
    from emenda.functions.chars import distance

    def matrix(x, y):
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        return row[-1]

    r = random.Random(5)
    for _ in range(300):
        x, y = ("".join(r.choice("abc") for _ in range(r.randrange(90))) for _ in range(2))
        assert distance(x, y) == matrix(x, y) == distance(list(y), list(x))
    assert distance("", "") == 0 and distance("", "ab") == 2 and distance("x" * 30_000, "y" + "x" * 30_000 + "z") == 2


def test_tokens_of_odd_texts(spark):
    from emenda.operators import tokens as K

    texts = ["", None, "a", "é1\n\n  x  y", "日本語𐐨😀!?", "½²3٣", "​­" * 3, "w " * 30_000, "đa-bc"]
    df = spark.createDataFrame([(f"k{i}", t, 1) for i, t in enumerate(texts)], "id string, text string, tok_idx int")
    rows = K.tokenize(df, key="id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert {f"k{i}" for i, t in enumerate(texts) if t} == set(by)
    for i, t in enumerate(texts):
        if t:
            own = sorted(by[f"k{i}"], key=lambda r: r.tok_idx)
            assert [r.tok_idx for r in own] == list(range(len(own))) and "".join(r.token for r in own) == t
            assert all(t[r.start : r.end] == r.token for r in own)
    assert [(r.token, r.token_type) for r in by["k3"]] == [("é", "VI_WORD"), ("1", "NUMBER"), ("\n\n", "NEWLINE"), ("  ", "SPACE"), ("x", "FOREIGN_WORD"), ("  ", "SPACE"), ("y", "FOREIGN_WORD")]
    assert [r.token_type for r in by["k4"]] == ["FOREIGN_WORD", "PUNCT"] and [r.token_type for r in by["k5"]] == ["PUNCT", "NUMBER"] and [r.token_type for r in by["k6"]] == ["UNKNOWN"]
    key = lambda r: (r.id, r.tok_idx)
    a = sorted(K.islands(K.tokenize(df, key="id"), key="id").select("id", "tok_idx", "token", "island", "word_pos").collect(), key=key)
    b = sorted(K.island_words(df, key="id").select("id", "tok_idx", "token", "island", "word_pos").collect(), key=key)
    assert a == b
    assert "Exchange" not in K.tokenize(df, key="id")._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    from emenda.catalog import correction
    from emenda.plans import correct as P

    rows = [(1, "so muong gat ngang"), (1, "MOI QUAN HE."), (None, "so muong gat ngang"), (1, "so muong gat ngang"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text, r.corrected, r.status) for r in P.correct(df, correction.fixture_resources(spark)).collect()), key=str)
    good = "số muỗng gạt ngang"
    assert got == sorted([(1, "so muong gat ngang", good, "ok")] * 2 + [(1, "MOI QUAN HE.", "MỐI QUAN HỆ.", "ok"), (None, "so muong gat ngang", good, "ok"), (None, None, None, "no_text")], key=str)
