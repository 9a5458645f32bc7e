"""What keeps the work of a query in proportion to its input: what its plan sends between tasks, and what of it leaves the JVM."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emenda import catalog
from emenda.catalog import correction
from emenda.functions import chars
from emenda.functions import text as T
from emenda.operators import candidates as C
from emenda.operators import tokens as K
from emenda.operators.spans import mark_tokens
from emenda.plans.correct import restore_accents
from emenda.sources import writers

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cg_merge", "cg_trim", "cg_rank", "cg_stats", "cg_prior", "cg_document", "cg_edit", "cg_cache", "cg_identity_only", "dc_sources"])
def test_candidates_are_not_gathered_by_place(spark, name):
    """They are merged and ranked by distinct token; places are joined, never grouped, sorted or compared."""
    found = plan(catalog.queries()[name](spark, DATA))
    assert "hashpartitioning(doc_id" not in found
    assert name != "cg_document" or "hashpartitioning(form" not in found


def test_placed_candidates_are_those_of_every_place(spark):
    rows = [(d, i, t, "SPACE" if t == " " else "FOREIGN_WORD", p) for d, text in enumerate(["The the", "de x thé", "de"]) for i, (t, p) in enumerate((w, w == "x") for w in text.replace(" ", "| |").split("|"))]
    toks = spark.createDataFrame(rows, "doc_id int, tok_idx int, token string, token_type string, protected boolean")
    lexicon = spark.createDataFrame([(1, "the", "the", 0.6), (2, "thé", "the", 0.4), (3, "dé", "de", 0.5), (4, "x", "x", 1.0), (5, "ẋ", "x", 1.0), (6, " ", " ", 1.0)], "entry_ord long, surface string, no_tone string, freq double")
    lexicon = lexicon.withColumns({"kind": F.lit("common_word"), "domain": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    lx = C.Lexicons(lexicon=lexicon, syllables=lexicon)
    keys = ["doc_id", "tok_idx"]
    each = C.merge(C.proposals(toks, lx), keys)
    columns = sorted(each.columns)
    assert sorted(map(str, C.placed(toks, C.others(toks, lx), keys).select(columns).collect())) == sorted(map(str, each.select(columns).collect()))
    for most in (1, 2, 32):
        want = C.rank(each, keys, most)
        columns = sorted(want.columns)
        assert sorted(map(str, C.generate(toks, lx, most).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


@pytest.mark.parametrize("name, absent", [("tok_spans", "Exchange"), ("tok_phrase_rebuild", "Exchange"), ("tok_windows", "Join"), ("tok_reconstruct", ", token, token#"), ("restore_accents", "tok_idx")])
def test_tokens_are_not_shuffled(spark, name, absent):
    found = plan(catalog.queries()[name](spark, DATA))
    assert absent not in found and (name != "tok_reconstruct" or "piece" in found)


TEXTS = [(1, "Số  muỗng\n12 gạt-ngang"), (2, ""), (3, None), (4, "a\x1c b"), (5, "longest words abcdefgh abcdefghi\nab " * 40), (None, "đường thé de"), (4, "DE thé")]


def test_scattered_tokens_are_the_same_texts_and_windows(spark):
    docs = spark.createDataFrame([r for r in TEXTS if r[0]][:-1], "doc_id int, text string")
    toks = K.tokenize(docs).cache()
    n = toks.count()
    for rows in (toks, toks.repartition(7, "tok_idx"), toks.orderBy(F.desc("tok_idx"))):
        assert {r.doc_id: r.text for r in K.reconstruct(rows).collect()} == {d: t for d, t in TEXTS[:5] if t}
    marked = toks.select("doc_id", "tok_idx", F.when(F.length("token") > 7, 2).otherwise(1).alias("n_candidates"), (F.length("token") == 9).alias("protected"))
    for most in (4, 5):
        want = []
        for d, _ in TEXTS[:5]:
            own = sorted(r for r in marked.where(F.col("doc_id") == d).collect())
            places = [(max(r.tok_idx - most // 2, 0), r.tok_idx) for r in own if r.n_candidates > 1 and not r.protected]
            for a, t in places:
                b = min(t + most // 2 + 1, len(own), a + most)
                if want and want[-1][0] == d and a <= want[-1][3]:
                    want[-1] = (*want[-1][:3], max(b, want[-1][3]))
                else:
                    want.append((d, want[-1][1] + 1 if want and want[-1][0] == d else 0, a, b))
        for rows in (marked, marked.repartition(5, "tok_idx")):
            assert sorted(tuple(r) for r in K.windows(rows, most).collect()) == want
    assert n == toks.count() and want


def test_every_row_is_restored_by_its_own_words(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    best = spark.createDataFrame([("so", "số", 3), ("so", "sò", 2), ("de", "dé", 1), ("the", "the", 2), ("the", "thé", 1), ("duong", "đường", 1)], "no_tone string, surface string, cnt int")
    got = sorted((str(r.doc_id), r.restored) for r in restore_accents(docs, best).collect())
    assert got == sorted([("1", "số  muong\n12 gat-ngang"), ("4", "a\x1c b"), ("5", TEXTS[4][1]), ("None", "đường the dé"), ("4", "dé the")])


def test_words_take_their_places(spark):
    rows = [(["a", " ", "b", "", "c"], ["X", "Y"]), (["a"], []), ([], ["X"]), (None, ["X"]), (["a"], None), ([" ", "\x1c", "b"], ["ü", "Y"])]
    found = spark.createDataFrame(rows, "t array<string>, w array<string>").select(K.rebuild_phrase("t", "w").alias("o"))
    assert [r.o for r in found.collect()] == ["X Yc", "a", "", None, None, " \x1cü"]
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    by = sorted((str(r[0]), list(r[1:])) for r in K.word_spans(K.island_words(docs)).drop("words").where("doc_id <> 4").collect())
    assert by == sorted((str(r[0]), list(r[1:])) for r in K.span_places(docs).where("doc_id <> 4").collect()) and by


def test_long_texts_are_compared_by_bounds_that_meet():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    r = random.Random(7)
    for _ in range(60):
        a = "".join(r.choices("abcdé\ud800𝄞", k=r.randrange(60, 150)))
        for b in (a.replace("a", "x"), a.replace("b", ""), a[3:] + "abc", "".join(r.choices("abcd", k=100)), a.replace("a", "b"), "z" * len(a), ""):
            assert chars.distance(a, b) == chars.distance(b, a) == plain(a, b) == chars.distance(list(a), list(b))
    text = "".join(r.choices("abcde ", k=400_000))
    began = time.time()
    assert chars.distance(text, text.replace("e", "x")) == chars.distance(text.replace("e", ""), text) == text.count("e")
    assert time.time() - began < 10


def test_texts_in_normal_form_are_handed_back(spark):
    texts = pa.array(["é", None, "", "muỗng – x"])
    assert T.nfc.func(texts) is texts
    assert T.nfc.func(pa.array(["é", None, "", "a﻿", "q̣̇", "Å"])).to_pylist() == ["é", None, "", "a﻿", "q̣̇", "Å"]


def test_tokens_are_marked_where_they_are(spark):
    assert "SortMergeJoin" not in (found := plan(catalog.queries()["prot_mark"](spark, DATA))) and "Exchange hashpartitioning" not in found
    toks = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 6), (2, 0, 0, 4), (None, 0, 0, 4), (1, 0, 0, 4)], "doc_id int, tok_idx int, start int, end int")
    spans = spark.createDataFrame([(1, 0, 5), (1, 0, 4), (1, 5, 9), (None, 0, 9)], "doc_id int, start int, end int")
    assert sorted(map(str, ((r.doc_id, r.tok_idx, r.protected) for r in mark_tokens(toks, spans).collect()))) == sorted(map(str, [(1, 0, True), (1, 1, False), (2, 0, False), (None, 0, False), (1, 0, True)]))


def test_token_lines_are_put_together_without_a_formatter(spark):
    rows = spark.createDataFrame([(1, i, t, "PUNCT", p) for i, t, p in [(0, "a", True), (12, "b c", False), (999, "", None), (1000, "%d", True), (None, None, True)]], "doc_id int, tok_idx int, token string, token_type string, protected boolean")
    found = writers.token_lines(rows)
    line = F.format_string("%3d %s %s%s", F.col("tok_idx"), F.col("token"), F.col("token_type"), F.when(F.col("protected"), " [protected]").otherwise(""))
    key = lambda r: str(r.tok_idx)
    assert [r.line for r in sorted(found.collect(), key=key)] == [r.line for r in sorted(rows.select("tok_idx", line.alias("line")).collect(), key=key)]
    assert "format_string" not in plan(found)


def test_domain_is_looked_up_by_distinct_token(spark):
    assert "SortMergeJoin" not in (found := plan(catalog.queries()["cg_domain"](spark, DATA))) and "Exchange hashpartitioning" not in found


def test_ngrams_are_sent_once_for_every_place(spark):
    assert plan(catalog.queries()["tok_ngrams"](spark, DATA)).count("Exchange") == 1
    r = random.Random(3)
    rows = [([r.choice(["a", "bc", "đ", "𝄞", "."]) for _ in range(r.randrange(9))],) for _ in range(700)] + [(None,), ([],)]
    docs = spark.createDataFrame(rows, "w array<string>")
    for most in (2, 3, 4, 6):
        want = docs.select(F.explode(K.ngrams(F.col("w"), 2, most)).alias("ngram")).groupBy("ngram").count()
        assert sorted(map(tuple, K.ngram_counts(docs, "w", most).collect())) == sorted(map(tuple, want.collect()))


def test_what_is_mined_is_mined_once(spark, monkeypatch):
    """correct() reads its resources many times; none of these reads goes back to the documents."""
    given = []
    monkeypatch.setattr(correction.P, "correct", lambda docs, resources, config: given.append(resources) or docs.selectExpr("doc_id", "text corrected", "1D confidence", "array(1) changes", "array(1) flags", "'ok' status"))
    catalog.queries()["correct_documents"](spark, DATA)
    assert not [f for df in (given[0].lexicon, given[0].ngrams) for f in df.inputFiles() if "documents" in f]
