"""The search over states against the list of all sequences of the beam."""

import random

from pyspark.sql import functions as F

from emenda import catalog
from emenda.operators import decision, scoring, search, sequences

CANDIDATES = "doc_id bigint, win_id bigint, tok_idx int, token string, text string, prior double, rank int, edit_distance int, sources array<string>, is_original boolean"
WORDS = ["mot", "một", "mốt", "hai", "hải", "xa", "xà", "xa xa"]


def windows(r, number, longest):
    rows = []
    for w in range(number):
        for i in range(r.randrange(1, longest)):
            token = r.choice(["mot", "hai", "xa", "xà", " ", " "])
            own = [] if token == " " else r.sample([x for x in WORDS if x != token], r.randrange(5))
            rows.append((w % 3, w, i, token, token, 0.1, 1, None, ["original"], True))
            for k, text in enumerate(own):
                rows.append((w % 3, w, i, token, text, r.choice([0.1, 0.2, 0.2, 0.25]), k + 2, r.choice([None, 1, 2]), r.choice([["ocr_confusion"], ["word_lexicon"]]), False))
    return rows


def grams(r):
    out = {}
    for kind, n, share in (("bigram", 2, 0.3), ("trigram", 3, 0.1), ("fourgram", 4, 0.03)):
        for _ in range(int(share * len(WORDS) ** n)):
            out[kind, " ".join(r.choice(WORDS) for _ in range(n))] = r.choice([0.1, 0.25, 0.6])
    for kind in ("negative", "domain"):
        for n in (1, 2, 3):
            for _ in range(12):
                out[kind, " ".join(r.choice(WORDS) for _ in range(n))] = r.choice([0.5, 1.0])
    return [(kind, r.choice(["a", "b"]) if kind == "domain" else None, g, s) for (kind, g), s in out.items()]


def test_states_decide_as_all_sequences_do(spark):
    r = random.Random(11)
    cands = spark.createDataFrame(windows(r, 240, 9), CANDIDATES).cache()
    ngrams = spark.createDataFrame(grams(r), "kind string, domain string, ngram string, score double").cache()
    words = spark.createDataFrame([("mot", "mot"), ("một", "mot"), ("hải", "hai"), ("xa", "xa"), ("xà", "xa")], "surface string, no_tone string")
    syllables = words.where("surface <> 'xa'")
    keys = ["doc_id", "win_id"]
    columns = [*keys, "pos", "original", "best", "second", "decision", "reason", *(F.round(c, 8).alias(c) for c in ("best_raw", "second_raw", "conf", "second_conf", "margin"))]
    originals = cands.where("is_original").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]).alias("originals"))
    ties = 0
    for width, most, domain in ((32, 8, None), (3, 8, "a"), (2, 2, "b")):
        seqs = sequences.generate(cands, ngrams.where("kind = 'bigram'"), "doc_id", width, most).join(originals, keys).cache()
        ties += seqs.groupBy(*keys).count().where(F.col("count") > width + 1).count()
        want = decision.decide(scoring.score(seqs, cands, words, syllables, words, ngrams, keys, domain), keys).select(columns)
        got = search.decide(cands, words, syllables, words, ngrams, "doc_id", domain, width, most).select(columns)
        a, b = (sorted(map(tuple, x.collect()), key=str) for x in (want, got))
        assert len(a) == cands.where("is_original").count() and a == b
    assert ties > 50


def test_ties_of_a_long_window_are_not_listed():
    own = [search.Choice(f"c{i}", 0.3, 0.1 * (i == 5)) for i in range(8)] + [search.Choice("o", 0.1, 1.0)]
    found = search.best(["o"] * 200, [own] * 200, lambda a, b: 0.0, {}, {})
    # all 8 ** 200 sequences of c0 ... c7 are ties of the beam; the originals, put back, score best
    assert found == [("o", 200.0, "c5", 20.0)] * 200


def test_documents_of_many_ties_are_corrected(spark, tmp_path):
    forms = [[f"{c}{v}n" for v in ("á", "à", "ả", "ã", "ạ")] for c in "bcdghklmnprstvx"]
    r = random.Random(3)
    texts = [" ".join(f[(i + j) % 5] for j, f in enumerate(r.sample(forms * 3, 45))) for i in range(10)]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["correct_documents"](spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(range(10)) and all(x.status == "ok" and len(x.corrected) == len(texts[x.doc_id]) for x in got)
