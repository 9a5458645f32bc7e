"""Look-ups, filters and small steps, on literal tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T
from ..operators import candidates as C
from ..operators import decision as D
from ..operators import lattice, scoring, sequences
from ..operators import lookup as L
from ..operators import spans as S
from ..operators import tokens as K
from ..plans import correct as P
from ..plans import lexicon as X
from ..session import written
from ..sources import readers
from .correction import ABBREVIATIONS, CONFUSIONS, DECISIONS, DOMAIN, KNOWN, NGRAMS, PHRASES, TEXTS, _DEC, _edges, _lx, _scored, _T, _tokens, _WORD, fixture_resources
from .registry import Fixture, lit, query, strip_sql
from .tokens import islands_sql, tokens_sql

JSON = Fixture("json string", [('[{"surface": "muỗng", "freq": 0.9}, {"surface": "gạt"}]',)])


@query("src_json_lexicon", "SELECT * FROM (VALUES ('muỗng', CAST(0.9 AS DOUBLE)), ('gạt', NULL)) AS v(surface, freq)")
def src_json_lexicon(spark, sf):
    return readers.parse_json_array(JSON.df(spark), "surface string, freq double")


SNAPSHOT = Fixture("surface string, no_tone string, kind string, freq double, conf double", [("số", "so", "common_word", 0.0, None), ("gạt", "gat", "common_word", 0.4, 0.0), ("ml", "ml", "unit_word", None, 0.7)])


@query("src_sqlite", f"SELECT surface, no_tone, kind, CASE WHEN coalesce(freq, 0) = 0 THEN 1.0 ELSE freq END AS freq, CASE WHEN coalesce(conf, 0) = 0 THEN CASE WHEN coalesce(freq, 0) = 0 THEN 1.0 ELSE freq END ELSE conf END AS confidence FROM {SNAPSHOT.sql()}")
def src_sqlite(spark, sf):
    return readers.snapshot_entries(SNAPSHOT.df(spark))


LEFT, RIGHT = Fixture("key string, v string", [("a", "json"), ("b", "json")]), Fixture("key string, v string", [("b", "db"), ("c", "db")])


@query(
    "src_hybrid",
    "SELECT * FROM (VALUES ('keep', 'a', 'json'), ('keep', 'b', 'json'), ('keep', 'c', 'db'), ('overwrite', 'a', 'json'), ('overwrite', 'b', 'db'), ('overwrite', 'c', 'db'), ('append', 'a', 'json'), ('append', 'b', 'json'), ('append', 'b', 'db'), ('append', 'c', 'db')) AS t(rule, key, v)",
)
def src_hybrid(spark, sf):
    parts = [readers.hybrid(LEFT.df(spark), RIGHT.df(spark), "key", r).select(F.lit(r).alias("rule"), "key", "v") for r in ("keep", "overwrite", "append")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src_matchers", "SELECT * FROM (VALUES (0, 'u', 7), (1, 'l', 2)) AS v(place, name, priority)")
def src_matchers(spark, sf):
    rows = [{"name": "l", "type": "lexicon", "priority": 2, "entries": ["x"]}, {"name": "none", "type": "regex", "patterns": []}, {"name": "u", "type": "regex", "priority": 7, "patterns": ["y"]}, {"name": "?", "type": "other"}]
    return spark.createDataFrame([(i, m.name, m.priority) for i, m in enumerate(S.load_matchers(rows))], "place int, name string, priority int")


@query("src_ngram_json", "SELECT * FROM (VALUES ('bigram', NULL, 'a b', CAST(0.5 AS DOUBLE)), ('trigram', NULL, 'a b c', 0.25), ('negative', NULL, 'x y', 0.125), ('domain', 'd', 'p q', 0.75)) AS v(kind, domain, ngram, score)")
def src_ngram_json(spark, sf):
    raw = spark.sql("SELECT map('a b', 0.5D) bigrams, map('a b c', 0.25D) trigrams, cast(map() AS map<string, double>) fourgrams, map('x y', 0.125D) negative_phrases, map('d', map('p q', 0.75D)) domain_phrases")
    return readers.ngram_store(raw)


DOMAINS = Fixture("domain string, phrases array<string>", [("sữa", ["muỗng gạt ngang", "số muỗng"]), ("y", ["x"])])


@query("src_domain_phrases", f"SELECT domain, unnest(phrases) AS ngram, CAST(0.95 AS DOUBLE) AS score FROM {DOMAINS.sql()}")
def src_domain_phrases(spark, sf):
    return readers.domain_phrases(DOMAINS.df(spark))


CURATED = Fixture("phrase string, tokens array<string>, n bigint, score double", [("a b", ["a", "b"], 2, 0.9), ("c", ["c"], 1, 0.9), ("d e f", ["d", "e", "f"], 2, 0.9), ("g h", ["g", "h"], 2, None)])


@query("src_curated", f"SELECT phrase, n, coalesce(score, 1.0) AS score FROM {CURATED.sql()} WHERE n >= 2 AND n = len(tokens)")
def src_curated(spark, sf):
    return readers.tokenized_phrases(CURATED.df(spark)).select("phrase", "n", "score")


@query("src_negative", f"SELECT phrase, n, coalesce(score, 0.05) AS score FROM {CURATED.sql()} WHERE n >= 2 AND n = len(tokens)")
def src_negative(spark, sf):
    return readers.tokenized_phrases(CURATED.df(spark), 0.05).select("phrase", "n", "score")


@query("src_foreign", f"SELECT DISTINCT lower(surface) AS word FROM {DOMAIN.sql()}")
def src_foreign(spark, sf):
    return DOMAIN.df(spark).select(F.lower("surface").alias("word")).distinct()


@query("flt_kind", f"SELECT surface FROM {DOMAIN.sql()} WHERE kind IN ('common_word', 'unit_word', 'name', 'location', 'brand')")
def flt_kind(spark, sf):
    return DOMAIN.df(spark).where(F.col("kind").isin(*C.WORD_KINDS)).select("surface")


@query("flt_not_self", f"SELECT count(*) AS n FROM {_WORD}")
def flt_not_self(spark, sf):
    return C.from_words(_tokens(spark, sf).where(F.col("token_type").isin(*K.WORDS)), _lx(spark, sf)).where("text <> token").agg(F.count("*").alias("n"))


PATHS = Fixture("id bigint, n_changes bigint, score double, risk double", [(1, 0, 9.0, 0.0), (2, 1, 1.9, 0.1), (3, 1, 2.0, 0.5), (4, 2, 5.0, 0.6)])


@query("flt_accept_decode", f"SELECT id FROM {PATHS.sql()} WHERE n_changes > 0 AND score >= 2.0 AND risk <= 0.5")
def flt_accept_decode(spark, sf):
    rows = PATHS.df(spark).withColumn("path", F.when(F.col("n_changes") > 0, F.sequence(F.lit(1), F.col("n_changes").cast("int"))).otherwise(F.array().cast("array<int>")))
    return lattice.accepted(rows).select("id")


CHANGED = Fixture("seq_id bigint, tokens array<string>, originals array<string>", [(0, ["gạt"], ["gat"]), (1, ["gặt"], ["gạt"]), (2, ["số", "muỗng"], ["số", "mùông"]), (3, ["mùông"], ["muỗng"])])


def _over(spark):
    known = KNOWN.df(spark)
    rows = scoring.positions(CHANGED.df(spark).withColumn("win_id", F.lit(1)), ["win_id"])
    return scoring.overcorrection(rows, known.unionByName(spark.createDataFrame([("gat", "gat")], "surface string, no_tone string")), known, NGRAMS.df(spark), ["win_id"])


@query("flt_accentless", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS DOUBLE)), (1, 1)) AS v(seq_id, overcorrection)")
def flt_accentless(spark, sf):
    return _over(spark).where("seq_id < 2").select("seq_id", "overcorrection")


@query("flt_ngram_gain", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(0 AS DOUBLE)), (3, 1)) AS v(seq_id, overcorrection)")
def flt_ngram_gain(spark, sf):
    return _over(spark).where("seq_id >= 2").select("seq_id", "overcorrection")


ASKED = Fixture("token string", [("thé",), ("dé",), ("of",), ("the",), ("und",), ("quan hệ",), ("x",)])


@query("jn_abbrev", f"SELECT token, exp_ord, expansion FROM {ASKED.sql()} JOIN {ABBREVIATIONS.sql()} ON token = surface")
def jn_abbrev(spark, sf):
    return L.by_abbreviation(ASKED.df(spark), ABBREVIATIONS.df(spark)).select("token", F.col("exp_ord").cast("bigint").alias("exp_ord"), "expansion")


@query("jn_ocr", f"SELECT token, correction, CAST(0.7 AS DOUBLE) AS score FROM {ASKED.sql()} JOIN {CONFUSIONS.sql()} ON token = noisy")
def jn_ocr(spark, sf):
    return L.by_confusion(ASKED.df(spark), CONFUSIONS.df(spark)).select("token", "correction", F.lit(0.7).alias("score"))


@query("jn_phrase_notone", f"SELECT token, phrase FROM {ASKED.sql()} JOIN {PHRASES.sql()} ON trim({strip_sql('token')}) = no_tone")
def jn_phrase_notone(spark, sf):
    return L.by_no_tone(ASKED.df(spark), PHRASES.df(spark)).select("token", "phrase")


def _text_tokens(spark):
    return K.tokenize(TEXTS.df(spark).withColumn("text", F.lower("text"))).withColumn("protected", F.lit(False))


@query("cg_phrase", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'so'), (1, 'gat'), (2, 'quan'), (4, 'số'), (5, 'so'), (5, 'quan'), (5, 'he')) AS v(doc_id, text)")
def cg_phrase(spark, sf):
    toks = _text_tokens(spark)
    lx = C.Lexicons(phrases=PHRASES.df(spark).where("n < 4"))
    words = toks.where(F.col("token_type").isin(*K.WORDS))
    return C.phrase_evidence(toks, C.identity(words, lx), lx).where("length(text) < 5").select("doc_id", "text")


@query("cg_identity_only", f"SELECT token_type, count(*) AS n FROM {_T} WHERE token_type IN ('NUMBER', 'UNIT', 'PUNCT', 'SPACE', 'NEWLINE', 'PROTECTED') GROUP BY 1")
def cg_identity_only(spark, sf):
    """Proposals of distinct tokens, each counted as often as the token occurs."""
    forms = _tokens(spark, sf).groupBy("token", "token_type", "protected").agg(F.count("*").alias("places"))
    forms = written(forms, "forms").withColumn("form", F.struct("token_type", "places", "token"))
    lx = _lx(spark, sf)
    lx.keys = ["form"]
    found = C.proposals(forms, lx).select("form.token_type", "form.places").where(F.col("token_type").isin(*K.IDENTITY_ONLY))
    return found.groupBy("token_type").agg(F.sum("places").alias("n"))


@query("cg_cache", f"SELECT doc_id, tok_idx, count(*) AS n FROM {_WORD} GROUP BY 1, 2")
def cg_cache(spark, sf):
    """Candidates of distinct tokens, joined back to their places."""
    words = _tokens(spark, sf).where(F.col("token_type").isin(*K.WORDS))
    found = C.from_words(C.distinct(words), C.Lexicons(lexicon=_lx(spark, sf).lexicon, keys=[])).groupBy("token").agg(F.count("*").alias("n"))
    return words.select("doc_id", "tok_idx", "token").join(found, "token").select("doc_id", "tok_idx", "n")


COUNTS = Fixture("id bigint, counts array<bigint>, lim bigint", [(1, [3, 4, 2], 10), (2, [1, 1], 5), (3, [8, 8, 8], 100), (4, [5], 0)])


@query("cg_trim_window", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '2,2,2'), (2, '1,1'), (3, '4,5,5'), (4, '1')) AS v(id, counts)")
def cg_trim_window(spark, sf):
    @F.pandas_udf(ArrayType(LongType()))
    def trim(counts: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([sequences.trimmed(list(c), n) for c, n in zip(counts, limits)])

    return COUNTS.df(spark).select("id", F.array_join(trim("counts", "lim").cast("array<string>"), ",").alias("counts"))


@query("lat_identity", f"SELECT doc_id, island, word_pos AS start_pos, CAST(word_pos + 1 AS INTEGER) AS end_pos, CAST(0 AS DOUBLE) AS score FROM {islands_sql()}")
def lat_identity(spark, sf):
    words = K.islands(_tokens(spark, sf))
    return words.select("doc_id", "island", F.col("word_pos").alias("start_pos"), (F.col("word_pos") + 1).alias("end_pos"), F.lit(0.0).alias("score"))


_CHANGES = "(VALUES (CAST(1 AS BIGINT), 'số muỗng gạt ngang', 0.97::DOUBLE * 4.5 / 5.5), (2, 'mối quan hệ', 0.96::DOUBLE * 4.25 / 5.5), (5, 'số muỗng', 0.9::DOUBLE * 4.0 / 5.5), (5, 'mối quan hệ', 0.96::DOUBLE * 4.25 / 5.5))"


@query("lat_change", f"SELECT doc_id, output, round(c, 6) AS confidence FROM {_CHANGES} AS v(doc_id, output, c)")
def lat_change(spark, sf):
    words, edges = _edges(spark)
    best = lattice.accepted(lattice.decode(edges, words.groupBy("doc_id", "island").agg(F.count("*").cast("int").alias("n"))))
    return lattice.changes(best, edges).select("doc_id", "output", F.round("confidence", 6).alias("confidence"))


@query("lat_accept", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 1), (5, 2)) AS v(doc_id, changes)")
def lat_accept(spark, sf):
    return P.phrase_changes(_text_tokens(spark), PHRASES.df(spark)).select("doc_id", F.size("phrase_changes").cast("bigint").alias("changes"))


@query("sc_conf", f"SELECT id, greatest(0, least(1, (score + 5) / 10)) AS confidence FROM {PATHS.sql()}")
def sc_conf(spark, sf):
    return PATHS.df(spark).select("id", scoring.confidence(F.col("score")).alias("confidence"))


@query("sc_neg", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0.05 AS DOUBLE))) AS v(seq_id, negative)")
def sc_neg(spark, sf):
    rows = spark.createDataFrame([(1, 0, ["số", " ", "mường"]), (1, 1, ["số"])], "win_id bigint, seq_id bigint, tokens array<string>")
    return scoring.whole_window(rows, NGRAMS.df(spark), "negative", ["win_id"], "negative").select("seq_id", "negative")


@query("sc_rank", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 1), (0, 2)) AS v(seq_id, rank)")
def sc_rank(spark, sf):
    return _scored(spark).select("seq_id", "rank")


@query("sc_product_worked", "SELECT CAST(1 AS BIGINT) AS seq_id, CAST(4.0 AS DOUBLE) AS word, CAST(5.2 AS DOUBLE) AS ngram, CAST(3.5 AS DOUBLE) AS edit")
def sc_product_worked(spark, sf):
    return _scored(spark).where("seq_id = 1").select("seq_id", "word", F.round("ngram", 6).alias("ngram"), "edit")


@query("dc_change", f"SELECT id, original, best AS replacement, 'diacritic_restored' AS reason FROM {DECISIONS.sql()} WHERE {_DEC} = 'accept'")
def dc_change(spark, sf):
    d, _ = D.ladder(*(F.col(c) for c in ("original", "best", "conf", "margin", "protected")))
    return DECISIONS.df(spark).where(d == "accept").select("id", "original", F.col("best").alias("replacement"), F.lit("diacritic_restored").alias("reason"))


@query("dc_pipeline", f"SELECT {_DEC} AS decision, count(*) AS n FROM {DECISIONS.sql()} GROUP BY 1")
def dc_pipeline(spark, sf):
    d, _ = D.ladder(*(F.col(c) for c in ("original", "best", "conf", "margin", "protected")))
    return DECISIONS.df(spark).groupBy(d.alias("decision")).agg(F.count("*").alias("n"))


@query("rb_offsets", f"SELECT doc_id, tok_idx, start, \"end\" FROM {tokens_sql()} WHERE tok_idx % 7 = 0")
def rb_offsets(spark, sf):
    toks = _tokens(spark, sf)
    return toks.where("tok_idx % 7 = 0").select("doc_id", "tok_idx").join(toks, ["doc_id", "tok_idx"]).select("doc_id", "tok_idx", "start", "end")


@query("snk_result", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'ok'), (2, 'ok'), (3, 'ok'), (4, 'ok'), (5, 'ok'), (6, 'ok'), (7, 'no_text'), (8, 'ok')) AS v(doc_id, status)")
def snk_result(spark, sf):
    return P.correct(TEXTS.df(spark), fixture_resources(spark)).select("doc_id", "status")


@query("prot_lex_rule", f"SELECT token, token IN ('thé') OR token IN (SELECT surface FROM {ABBREVIATIONS.sql()}) OR token IN (SELECT surface FROM {DOMAIN.sql()} WHERE domain IN ('chemical', 'brand', 'code')) AS protected FROM {ASKED.sql()}")
def prot_lex_rule(spark, sf):
    rows = L.flagged(ASKED.df(spark), spark.createDataFrame([("thé",)], "w string"), "token", "w", "a")
    rows = L.flagged(rows, ABBREVIATIONS.df(spark), "token", "surface", "b")
    rows = L.flagged(rows, DOMAIN.df(spark).where("domain in ('chemical', 'brand', 'code')"), "token", "surface", "c")
    return rows.select("token", (F.col("a") | F.col("b") | F.col("c")).alias("protected"))


@query("fn_facade", f"SELECT doc_id, {lit('v')} AS v, {strip_sql('text')} = {strip_sql('lower(text)')} AS same FROM documents")
def fn_facade(spark, sf):
    from .registry import documents

    return documents(spark, sf).select("doc_id", F.lit("v").alias("v"), (T.strip_accents(F.col("text")) == T.strip_accents(F.lower("text"))).alias("same"))
