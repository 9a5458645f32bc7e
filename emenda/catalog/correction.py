"""Candidates, sequences, scores, decisions and the correction of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import decision as D
from ..operators import lattice, rebuild, scoring, sequences
from ..operators import tokens as K
from ..plans import correct as P
from ..plans import lexicon as X
from ..session import written
from .building import FREQ_SQL, frequencies
from .registry import Fixture, documents, query, strip_sql
from .tokens import tokens_sql

_T = tokens_sql()
_KEYS = ["doc_id", "tok_idx"]


def _tokens(spark, sf):
    return K.tokenize(documents(spark, sf)).withColumn("protected", F.lit(False))


def _lx(spark, sf, **more):
    lexicon = written(X.as_lexicon(frequencies(spark, sf)), "lexicon")
    return C.Lexicons(lexicon=lexicon, syllables=lexicon, **more)


@query("cg_identity", f"SELECT doc_id, tok_idx, token AS text, CAST(0.1 AS DOUBLE) AS prior FROM {_T} WHERE token <> ''")
def cg_identity(spark, sf):
    return C.identity(_tokens(spark, sf), C.Lexicons()).select("doc_id", "tok_idx", "text", "prior")


_WORD = f"(SELECT t.doc_id, t.tok_idx, t.token, f.surface AS text, f.freq FROM {_T} t JOIN {FREQ_SQL} f ON {strip_sql('t.token')} = f.no_tone WHERE t.token_type IN ('VI_WORD', 'FOREIGN_WORD', 'UNKNOWN') AND f.surface <> t.token)"


@query("cg_word", f"SELECT doc_id, tok_idx, text, round(0.25 + 0.3 * freq, 9) AS prior FROM {_WORD}")
def cg_word(spark, sf):
    words = _tokens(spark, sf).where(F.col("token_type").isin(*K.WORDS))
    return C.from_words(words, _lx(spark, sf)).select("doc_id", "tok_idx", "text", F.round("prior", 9).alias("prior"))


@query("cg_syllable", f"SELECT doc_id, tok_idx, text, round(0.2 + 0.2 * freq, 9) AS prior FROM {_WORD}")
def cg_syllable(spark, sf):
    words = _tokens(spark, sf).where(F.col("token_type").isin(*K.WORDS))
    return C.from_syllables(words, _lx(spark, sf)).select("doc_id", "tok_idx", "text", F.round("prior", 9).alias("prior"))


CONFUSIONS = Fixture("noisy string, corr_ord int, correction string", [("the", 0, "thé"), ("the", 1, "tho"), ("the", 2, "thy"), ("de", 0, "dé"), ("und", 0, "und")])
_CONF = CONFUSIONS.sql()


@query("cg_ocr", f"SELECT doc_id, tok_idx, correction AS text FROM {_T} t JOIN {_CONF} c ON t.token = c.noisy WHERE corr_ord < 2 AND correction <> token")
def cg_ocr(spark, sf):
    return C.from_confusions(_tokens(spark, sf), C.Lexicons(confusions=CONFUSIONS.df(spark))).select("doc_id", "tok_idx", "text")


ABBREVIATIONS = Fixture("surface string, exp_ord int, expansion string", [("of", 0, "out of"), ("of", 1, "off"), ("en", 0, "en bloc")])


@query("cg_abbrev", f"SELECT doc_id, tok_idx, expansion AS text, CAST(len(string_split(expansion, ' ')) AS INTEGER) AS replacement_tokens FROM {_T} t JOIN {ABBREVIATIONS.sql()} a ON t.token = a.surface")
def cg_abbrev(spark, sf):
    return C.from_abbreviations(_tokens(spark, sf), C.Lexicons(abbreviations=ABBREVIATIONS.df(spark))).select("doc_id", "tok_idx", "text", "replacement_tokens")


DOMAIN = Fixture("entry_ord bigint, surface string, no_tone string, kind string, freq double, domain string, tags array<string>", [(1, "dé", "de", "common_word", 0.5, "fr", []), (2, "thé", "the", "common_word", 0.4, None, ["fr"]), (3, "ünd", "und", "common_word", 0.2, None, []), (4, "dè", "de", "brand", 0.1, "it", [])])


@query("cg_domain", f"SELECT doc_id, tok_idx, surface AS text, round(0.2 + 0.2 * freq, 9) AS prior FROM {_T} t JOIN {DOMAIN.sql()} d ON {strip_sql('t.token')} = d.no_tone WHERE surface <> token AND (contains(coalesce(domain, ''), 'fr') OR list_contains(tags, 'fr'))")
def cg_domain(spark, sf):
    toks = _tokens(spark, sf)
    found = C.from_domain(C.distinct(toks), C.Lexicons(lexicon=DOMAIN.df(spark), domain="fr", keys=[])).select("token", "text", F.round("prior", 9).alias("prior"))
    return toks.select(*_KEYS, "token").join(written(found, "domain"), "token").select(*_KEYS, "text", "prior")


_ASCII = "regexp_matches(token, '^[a-z]+$')"


@query(
    "cg_edit",
    f"""WITH l AS (SELECT surface, no_tone, freq, row_number() OVER (ORDER BY surface) AS entry_ord FROM {FREQ_SQL} WHERE regexp_matches(surface, '^[a-z]+$')),
    c AS (SELECT t.doc_id, t.tok_idx, l.surface, l.freq, l.entry_ord FROM {_T} t JOIN l ON t.token[1:3] = l.no_tone[1:3] WHERE {_ASCII} AND length(token) BETWEEN 3 AND 20 AND abs(length(token) - length(no_tone)) <= 1 AND levenshtein(token, no_tone) = 1)
    SELECT doc_id, tok_idx, surface AS text, round(0.1 * freq, 9) AS prior FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, tok_idx ORDER BY entry_ord) <= 3""",
)
def cg_edit(spark, sf):
    from pyspark.sql import Window

    lexicon = X.as_lexicon(frequencies(spark, sf).where(F.col("surface").rlike("^[a-z]+$"))).withColumn("entry_ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("surface")))
    words = _tokens(spark, sf).where(F.col("token").rlike("^[a-z]+$"))
    found = C.from_edits(C.distinct(words), C.Lexicons(lexicon=written(lexicon, "lexicon"), keys=[])).select("token", "text", F.round("prior", 9).alias("prior"))
    return words.select(*_KEYS, "token").join(found, "token").select(*_KEYS, "text", "prior")


_PROP = f"""(SELECT doc_id, tok_idx, token, token AS text, 'original' AS source, CAST(0.1 AS DOUBLE) AS prior, NULL::DOUBLE AS syl, NULL::DOUBLE AS wf, false AS known FROM {_T} WHERE token <> ''
  UNION ALL SELECT doc_id, tok_idx, token, text, 'syllable_map', 0.2 + 0.2 * freq, freq, NULL, false FROM {_WORD}
  UNION ALL SELECT doc_id, tok_idx, token, text, 'word_lexicon', 0.25 + 0.3 * freq, NULL, freq, true FROM {_WORD})"""
_MERGE = f"""(SELECT doc_id, tok_idx, token, text, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources, count(*) AS evidence, round(max(prior), 9) AS prior, bool_or(known) AS known_word,
  max(syl) AS syl, max(wf) AS wf, max(CASE source WHEN 'original' THEN 0.1 WHEN 'syllable_map' THEN 0.2 ELSE 0.25 END::DOUBLE) AS weight FROM {_PROP} GROUP BY ALL)"""
_MERGE = _MERGE.replace("GROUP BY ALL", "GROUP BY doc_id, tok_idx, token, text")


def _others(spark, sf):
    toks = _tokens(spark, sf)
    return toks, C.others(toks, _lx(spark, sf), [C.from_syllables, C.from_words])


def _merged(spark, sf):
    return C.placed(*_others(spark, sf), _KEYS)


@query("cg_merge", f"SELECT doc_id, tok_idx, text, sources, evidence, prior, known_word FROM {_MERGE}")
def cg_merge(spark, sf):
    return _merged(spark, sf).select("doc_id", "tok_idx", "text", F.array_join("sources", "|").alias("sources"), "evidence", F.round("prior", 9).alias("prior"), "known_word")


_SCORED = f"(SELECT *, token = text AS is_original, round(greatest(0, least(1, weight + CASE WHEN known_word THEN 0.05 ELSE 0 END + 0.3 * coalesce(syl, 0) + 0.15 * coalesce(wf, 0) + CASE WHEN token = text THEN 0.05 ELSE 0 END + 0.02 * least(evidence, 5))), 10) AS score FROM {_MERGE})"


@query("cg_prior", f"SELECT doc_id, tok_idx, text, floor(score * 1000000 + 0.5) / 1000000 AS score FROM {_SCORED}")
def cg_prior(spark, sf):
    # round is half up by decimal digits here and by binary value there; this is the same in both
    return _merged(spark, sf).select("doc_id", "tok_idx", "text", (F.floor(F.round(C.ranking_score(), 10) * 1000000.0 + 0.5) / 1000000.0).alias("score"))


_RANKED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, tok_idx ORDER BY is_original DESC, score DESC, coalesce(wf, 0) DESC, coalesce(syl, 0) DESC, evidence DESC, text) AS INTEGER) AS rank FROM {_SCORED})"


def _ranked(spark, sf, most=32):
    # without the order of entries, which is a hash, ties go by text, as in the SQL
    toks, found = _others(spark, sf)
    found = found.withColumn("edit_distance", F.lit(None).cast("int")).withColumn("ordinal", F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("entry_ord")))
    return C.placed(toks, C.rank_others(found, most), _KEYS)


@query("cg_rank", f"SELECT doc_id, tok_idx, text, rank FROM {_RANKED}")
def cg_rank(spark, sf):
    return _ranked(spark, sf, 10_000).select("doc_id", "tok_idx", "text", "rank")


@query("cg_trim", f"SELECT doc_id, tok_idx, text, rank FROM {_RANKED} WHERE rank <= 2")
def cg_trim(spark, sf):
    return _ranked(spark, sf, 2).select("doc_id", "tok_idx", "text", "rank")


@query("cg_stats", f"SELECT count(*) AS tokens, CAST(sum(n) AS BIGINT) AS candidates, max(n) AS most, round(avg(n), 6) AS mean, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous, CAST(sum(e) AS BIGINT) AS evidence FROM (SELECT count(*) AS n, sum(evidence) AS e FROM {_MERGE} GROUP BY doc_id, tok_idx)")
def cg_stats(spark, sf):
    return C.statistics(*_others(spark, sf))


@query("cg_document")
def cg_document(spark, sf):
    return C.generate(_tokens(spark, sf), _lx(spark, sf)).select("doc_id", "tok_idx", "text", "rank", F.array_join("sources", "|").alias("sources"))


PHRASES = Fixture(
    "phrase string, no_tone string, n int, confidence double, domain string",
    [("số muỗng", "so muong", 2, 0.9, None), ("muỗng gạt ngang", "muong gat ngang", 3, 0.95, "sữa"), ("số muỗng gạt ngang", "so muong gat ngang", 4, 0.97, None), ("mối quan hệ", "moi quan he", 3, 0.96, None), ("quan hệ", "quan he", 2, 0.8, None)],
)
TEXTS = Fixture("doc_id bigint, text string", [(1, "so muong gat ngang"), (2, "MOI QUAN HE."), (3, "moi quan, he"), (4, "Số muỗng 5ml DHA"), (5, "so muong\nmoi quan he"), (6, ""), (7, None), (8, "hello world")])


def _edges(spark):
    toks = K.tokenize(TEXTS.df(spark).withColumn("text", F.lower("text")))
    return K.islands(toks), lattice.propose(K.islands(toks), PHRASES.df(spark))


@query(
    "lat_propose",
    "SELECT CAST(v.doc_id AS BIGINT) AS doc_id, v.output, CAST(v.start_pos AS INTEGER) AS start_pos, CAST(v.n AS INTEGER) AS n, round(v.c * (3.5 + least(2.0, 0.25 * v.n)), 9) AS score, round(least(1.0, 1 - v.c + CASE WHEN v.n = 2 THEN 0.15 ELSE 0 END), 9) AS risk FROM (VALUES (1, 'số muỗng', 0, 2, 0.9::DOUBLE), (1, 'muỗng gạt ngang', 1, 3, 0.95::DOUBLE), (1, 'số muỗng gạt ngang', 0, 4, 0.97::DOUBLE), (2, 'mối quan hệ', 0, 3, 0.96::DOUBLE), (5, 'số muỗng', 0, 2, 0.9::DOUBLE), (5, 'mối quan hệ', 0, 3, 0.96::DOUBLE)) AS v(doc_id, output, start_pos, n, c)",
)
def lat_propose(spark, sf):
    return _edges(spark)[1].select("doc_id", "output", "start_pos", (F.col("end_pos") - F.col("start_pos")).alias("n"), F.round("score", 9).alias("score"), F.round("risk", 9).alias("risk"))


@query("flt_safe_phrase", f"SELECT a.text AS original, b.phrase, a.text = {strip_sql('b.phrase')} AND b.n >= 2 AND b.confidence >= 0.85 AS safe FROM (SELECT unnest(['so muong', 'moi quan he', 'quan he', 'x']) AS text) a CROSS JOIN {PHRASES.sql()} b")
def flt_safe_phrase(spark, sf):
    a = spark.createDataFrame([("so muong",), ("moi quan he",), ("quan he",), ("x",)], "original string")
    rows = a.crossJoin(PHRASES.df(spark))
    return rows.select("original", "phrase", lattice.is_safe(F.col("original"), F.col("phrase"), F.col("n"), F.col("confidence")).alias("safe"))


@query("lat_score", f"SELECT phrase, round(confidence * (3.5 + least(2.0, 0.25 * n)), 9) AS score, round(least(1.0, 1 - confidence + CASE WHEN n = 2 THEN 0.15 ELSE 0 END), 9) AS risk FROM {PHRASES.sql()}")
def lat_score(spark, sf):
    c, n = F.col("confidence"), F.col("n")
    return PHRASES.df(spark).select("phrase", F.round(lattice.span_score(c, n), 9).alias("score"), F.round(lattice.span_risk(c, n), 9).alias("risk"))


@query("lat_decode", "SELECT CAST(v.doc_id AS BIGINT) AS doc_id, round(v.score, 6) AS score, v.path FROM (VALUES (1, 0.97::DOUBLE * 4.5, 'số muỗng gạt ngang'), (2, 0.96::DOUBLE * 4.25, 'mối quan hệ'), (5, 0.9::DOUBLE * 4.0, 'số muỗng'), (5, 0.96::DOUBLE * 4.25, 'mối quan hệ')) AS v(doc_id, score, path)")
def lat_decode(spark, sf):
    words, edges = _edges(spark)
    best = lattice.decode(edges, words.groupBy("doc_id", "island").agg(F.count("*").cast("int").alias("n")))
    return lattice.accepted(best).select("doc_id", F.round("score", 6).alias("score"), F.array_join(F.col("path.output"), " ").alias("path"))


WINDOW = Fixture(
    "win_id bigint, tok_idx bigint, token string, text string, prior double, rank bigint, edit_distance bigint, is_ocr boolean",
    [(1, 0, "số", "số", 0.1, 1, None, False), (1, 1, "mùông", "mùông", 0.1, 1, None, False), (1, 1, "mùông", "muỗng", 0.3, 2, 1, True), (1, 2, "gạt", "gạt", 0.1, 1, None, False), (1, 3, "ngang", "ngang", 0.1, 1, None, False)],
)
NGRAMS = Fixture(
    "kind string, domain string, ngram string, score double",
    [("bigram", None, "số muỗng", 0.9), ("bigram", None, "muỗng gạt", 0.85), ("bigram", None, "gạt ngang", 0.8), ("trigram", None, "số muỗng gạt", 0.9), ("trigram", None, "muỗng gạt ngang", 0.85), ("fourgram", None, "số muỗng gạt ngang", 0.9), ("domain", "product_instruction", "số muỗng gạt ngang", 0.9), ("negative", None, "số mường", 0.05)],
)
KNOWN = Fixture("surface string, no_tone string", [("số", "so"), ("mùông", "muong"), ("muỗng", "muong"), ("gạt", "gat"), ("ngang", "ngang")])
SEQUENCES = Fixture("win_id bigint, seq_id bigint, tokens array<string>, originals array<string>", [(1, 0, ["số", "mùông", "gạt", "ngang"], ["số", "mùông", "gạt", "ngang"]), (1, 1, ["số", "muỗng", "gạt", "ngang"], ["số", "mùông", "gạt", "ngang"])])


def _window(spark):
    return WINDOW.df(spark).withColumn("sources", F.when(F.col("is_ocr"), F.array(F.lit("ocr_confusion"))).otherwise(F.array(F.lit("original"))))


def _scored(spark):
    known = KNOWN.df(spark)
    return scoring.score(SEQUENCES.df(spark), _window(spark), known, known, known, NGRAMS.df(spark), ["win_id"], "product_instruction")


_SEQ = f"(SELECT win_id, seq_id, i AS pos, tokens[i] AS token, originals[i] AS original FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM {SEQUENCES.sql()}))"


@query("sc_word", f"SELECT seq_id, CAST(sum(CASE WHEN token IN (SELECT surface FROM {KNOWN.sql()}) THEN 1 ELSE 0 END) AS DOUBLE) AS word FROM {_SEQ} GROUP BY 1")
def sc_word(spark, sf):
    return _scored(spark).select("seq_id", "word")


@query("sc_syl", f"SELECT seq_id, round(sum(CASE WHEN token IN (SELECT surface FROM {KNOWN.sql()}) THEN 0.3::DOUBLE ELSE 0 END), 9) AS syllable FROM {_SEQ} GROUP BY 1")
def sc_syl(spark, sf):
    return _scored(spark).select("seq_id", F.round("syllable", 9).alias("syllable"))


_GRAMS = f"(SELECT seq_id, token || ' ' || lead(token) OVER w AS b, token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w AS t, token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w || ' ' || lead(token, 3) OVER w AS f FROM {_SEQ} WINDOW w AS (PARTITION BY seq_id ORDER BY pos))"


@query("sc_ngram", f"SELECT g.seq_id, round(sum(coalesce(s.score, 0)), 9) AS ngram FROM (SELECT seq_id, unnest([b, t, f]) AS g FROM {_GRAMS}) g LEFT JOIN (SELECT * FROM {NGRAMS.sql()} WHERE kind IN ('bigram', 'trigram', 'fourgram')) s ON g.g = s.ngram GROUP BY 1")
def sc_ngram(spark, sf):
    return _scored(spark).select("seq_id", F.round("ngram", 9).alias("ngram"))


@query("sc_domain", f"SELECT q.seq_id, coalesce(n.score, 0) AS domain, CAST(0 AS DOUBLE) AS negative FROM {SEQUENCES.sql()} q LEFT JOIN (SELECT * FROM {NGRAMS.sql()} WHERE kind = 'domain') n ON array_to_string(q.tokens, ' ') = n.ngram")
def sc_domain(spark, sf):
    return _scored(spark).select("seq_id", "domain", "negative")


@query("sc_edit", f"SELECT s.seq_id, round(sum(CASE WHEN s.token = s.original THEN 1.0 ELSE coalesce(1.0 / (1 + w.edit_distance), 0) END), 9) AS edit, CAST(sum(CASE WHEN s.token <> s.original AND w.is_ocr THEN 1 ELSE 0 END) AS DOUBLE) AS ocr FROM {_SEQ} s LEFT JOIN {WINDOW.sql()} w ON s.token <> s.original AND w.token = s.original AND w.text = s.token GROUP BY 1")
def sc_edit(spark, sf):
    return _scored(spark).select("seq_id", F.round("edit", 9).alias("edit"), "ocr")


@query("sc_over", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS DOUBLE)), (1, 0)) AS v(seq_id, overcorrection)")
def sc_over(spark, sf):
    return _scored(spark).select("seq_id", "overcorrection")


@query("sc_total", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(8.0 AS DOUBLE), CAST(1.0 AS DOUBLE), 2), (1, 15.94, 1.0, 1)) AS v(seq_id, raw, confidence, rank)")
def sc_total(spark, sf):
    return _scored(spark).select("seq_id", F.round("raw", 6).alias("raw"), "confidence", "rank")


_EDIT_SQL = f"(SELECT s.seq_id, sum(CASE WHEN s.token = s.original THEN 1.0::DOUBLE ELSE coalesce(1.0::DOUBLE / (1 + w.edit_distance), 0) END) AS edit, CAST(sum(CASE WHEN s.token <> s.original AND w.is_ocr THEN 1 ELSE 0 END) AS DOUBLE) AS ocr FROM {_SEQ} s LEFT JOIN {WINDOW.sql()} w ON s.token <> s.original AND w.token = s.original AND w.text = s.token GROUP BY 1)"
_NGRAM_SQL = f"(SELECT g.seq_id, sum(coalesce(s.score, 0)) AS ngram FROM (SELECT seq_id, unnest([b, t, f]) AS g FROM {_GRAMS}) g LEFT JOIN (SELECT * FROM {NGRAMS.sql()} WHERE kind IN ('bigram', 'trigram', 'fourgram')) s ON g.g = s.ngram GROUP BY 1)"
_DOMAIN_SQL = f"(SELECT q.seq_id, coalesce(n.score, 0) AS domain FROM {SEQUENCES.sql()} q LEFT JOIN (SELECT * FROM {NGRAMS.sql()} WHERE kind = 'domain') n ON array_to_string(q.tokens, ' ') = n.ngram)"


@query(
    "sc_explain",
    f"""SELECT q.seq_id, CAST(q.pos - 1 AS INTEGER) AS pos, q.original, q.token AS corrected, k.kind, round(CASE k.kind WHEN 'ocr_confusion' THEN e.ocr WHEN 'phrase_ngram' THEN 1.4 * n.ngram WHEN 'edit_distance' THEN 0.6 * e.edit ELSE 1.2 * d.domain END, 6) AS delta
    FROM {_SEQ} q JOIN {_EDIT_SQL} e USING (seq_id) JOIN {_NGRAM_SQL} n USING (seq_id) JOIN {_DOMAIN_SQL} d USING (seq_id) CROSS JOIN (SELECT unnest(['ocr_confusion', 'phrase_ngram', 'edit_distance', 'domain_context']) AS kind) k
    WHERE q.token <> q.original AND CASE k.kind WHEN 'ocr_confusion' THEN e.ocr WHEN 'phrase_ngram' THEN n.ngram WHEN 'edit_distance' THEN e.edit ELSE d.domain END > 0""",
)
def sc_explain(spark, sf):
    rows = scoring.explanations(_scored(spark), ["win_id"]).select("seq_id", "pos", "original", "corrected", F.explode("evidence").alias("e"))
    return rows.select("seq_id", "pos", "original", "corrected", F.col("e.kind").alias("kind"), F.round("e.delta", 6).alias("delta"))


@query("sq_beam", "SELECT * FROM (VALUES (0, 'số muỗng gạt ngang'), (1, 'số mùông gạt ngang')) AS v(seq_id, tokens)")
def sq_beam(spark, sf):
    return _beam(spark, False)


@query("sq_product", "SELECT * FROM (VALUES (0, 'số mùông gạt ngang'), (1, 'số muỗng gạt ngang')) AS v(seq_id, tokens)")
def sq_product(spark, sf):
    return _beam(spark, True)


def _beam(spark, exhaustive):
    rows = _window(spark).withColumn("doc_id", F.lit(1))
    found = sequences.generate(rows, NGRAMS.df(spark).where("kind = 'bigram'").select("ngram", "score"), "doc_id", exhaustive=exhaustive)
    return found.select("seq_id", F.array_join("tokens", " ").alias("tokens"))


@query("dc_second", "SELECT CAST(1 AS INTEGER) AS pos, 'muỗng' AS best, 'mùông' AS second, CAST(7.94 AS DOUBLE) AS margin, 'accept' AS decision")
def dc_second(spark, sf):
    return D.decide(_scored(spark), ["win_id"]).where("pos = 1").select("pos", "best", "second", F.round("margin", 6).alias("margin"), "decision")


@query("dc_window", "SELECT CAST(v.pos AS INTEGER) AS pos, v.decision, v.reason FROM (VALUES (0, 'reject', 'identity'), (1, 'accept', 'accepted_high_confidence'), (2, 'reject', 'identity'), (3, 'reject', 'identity')) AS v(pos, decision, reason)")
def dc_window(spark, sf):
    return D.decide(_scored(spark), ["win_id"]).select("pos", "decision", "reason")


DECISIONS = Fixture(
    "id bigint, original string, best string, conf double, margin double, protected boolean",
    [(1, "a", None, 0.9, 0.5, False), (2, "a", "b", 0.9, 0.5, True), (3, "a", "a", 0.9, 0.5, False), (4, "a", "b", 0.5, 0.5, False), (5, "a", "b", 0.9, 0.03, False), (6, "a", "b", 0.9, 0.05, False), (7, "a", "b", 0.9, 0.08, False), (8, "a", "b", 0.72, 0.04, False)],
)
_DEC = "CASE WHEN best IS NULL OR protected OR best = original THEN 'reject' WHEN conf < 0.72 OR margin < 0.04 THEN 'flag' WHEN margin < 0.08 THEN 'need_context' ELSE 'accept' END"


@query("dc_token", f"SELECT id, {_DEC} AS decision FROM {DECISIONS.sql()}")
def dc_token(spark, sf):
    d, _ = D.ladder(*(F.col(c) for c in ("original", "best", "conf", "margin", "protected")))
    return DECISIONS.df(spark).select("id", d.alias("decision"))


@query("dc_flag", f"SELECT id, CASE WHEN d = 'need_context' THEN 'no_safe_correction' WHEN d = 'flag' THEN CASE WHEN conf < 0.72 THEN 'low_confidence' ELSE 'ambiguous_diacritics' END END AS flag FROM (SELECT *, {_DEC} AS d FROM {DECISIONS.sql()})")
def dc_flag(spark, sf):
    d, r = D.ladder(*(F.col(c) for c in ("original", "best", "conf", "margin", "protected")))
    return DECISIONS.df(spark).select("id", D.flag_type(d, r).alias("flag"))


@query("dc_margin", f"SELECT id, round(CASE WHEN conf = 0 AND margin = 0 THEN 0 ELSE conf - margin END, 10) AS m FROM {DECISIONS.sql()}")
def dc_margin(spark, sf):
    c, m = F.col("conf"), F.col("margin")
    return DECISIONS.df(spark).select("id", D.margin(c, m, c, m).alias("m"))


@query("dc_sources", f"SELECT doc_id, tok_idx, array_to_string(list_sort(list_distinct(flatten(list(string_split(sources, '|'))))), '|') AS sources FROM {_MERGE} GROUP BY 1, 2")
def dc_sources(spark, sf):
    toks, found = _others(spark, sf)
    return D.placed_sources(toks, found, _KEYS).select("doc_id", "tok_idx", F.array_join("sources", "|").alias("sources"))


_CH = "array(named_struct('start', 0, 'end', 4, 'original', 'abcd', 'replacement', 'X', 'confidence', 0.8D, 'reason', 'r'), named_struct('start', 2, 'end', 6, 'original', 'cdef', 'replacement', 'Y', 'confidence', 0.9D, 'reason', 'r'), named_struct('start', 7, 'end', 8, 'original', 'h', 'replacement', 'ZZ', 'confidence', 0.7D, 'reason', 'r'))"


@query("rb_resolve", "SELECT * FROM (VALUES ('Y', 2), ('ZZ', 7)) AS v(replacement, start)")
def rb_resolve(spark, sf):
    return spark.sql(f"SELECT {_CH} AS c").select(F.explode(rebuild.resolve(F.col("c").cast(rebuild.CHANGE))).alias("c")).select("c.replacement", "c.start")


@query("rb_apply", "SELECT 'abYgZZij' AS out, CAST(0.8 AS DOUBLE) AS confidence")
def rb_apply(spark, sf):
    rows = spark.sql(f"SELECT 'abcdefghij' AS t, {_CH} AS c").withColumn("c", rebuild.resolve(F.col("c").cast(rebuild.CHANGE)))
    return rows.select(rebuild.apply(F.col("t"), F.col("c")).alias("out"), F.round(rebuild.overall_confidence(F.col("c")), 6).alias("confidence"))


@query("lat_merge", "SELECT 'Pgh' AS out")
def lat_merge(spark, sf):
    p = "array(named_struct('start', 0, 'end', 6, 'original', 'abcdef', 'replacement', 'P', 'confidence', 0.9D, 'reason', 'p'), named_struct('start', 5, 'end', 7, 'original', 'fg', 'replacement', 'Q', 'confidence', 0.9D, 'reason', 'p'))"
    rows = spark.sql(f"SELECT 'abcdefgh' AS t, {_CH} AS c, {p} AS p").withColumn("c", rebuild.resolve(F.filter(F.col("c").cast(rebuild.CHANGE), lambda x: x["start"] < 7)))
    return rows.select(rebuild.apply(F.col("t"), rebuild.merge_phrases(F.col("c"), F.col("p").cast(rebuild.CHANGE))).alias("out"))


@query("rb_guard", "SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'too_long' ELSE 'ok' END AS status FROM documents")
def rb_guard(spark, sf):
    return documents(spark, sf).select("doc_id", F.when(F.length("text") > T.MAX_CHARS, "too_long").otherwise("ok").alias("status"))


def fixture_resources(spark):
    words = KNOWN.df(spark)
    rows = words.select(F.xxhash64("surface").alias("entry_ord"), "surface", "no_tone", F.lit("common_word").alias("kind"), F.lit(0.5).alias("freq"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<string>").alias("tags"))
    return P.Resources(rows, rows, None, None, PHRASES.df(spark), NGRAMS.df(spark))


@query("correct_text", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'số muỗng gạt ngang'), (2, 'MỐI QUAN HỆ.'), (3, 'moi quan, he'), (4, 'Số muỗng 5ml DHA'), (5, 'số muỗng' || chr(10) || 'mối quan hệ'), (6, ''), (7, NULL), (8, 'hello world')) AS v(doc_id, corrected)")
def correct_text(spark, sf):
    return P.correct(TEXTS.df(spark), fixture_resources(spark)).select("doc_id", "corrected")


@query("correct_documents")
def correct_documents(spark, sf):
    """Accents stripped from documents of under 300 characters and restored by the whole pipeline, with
    lexicon and n-grams mined from the whole corpus."""
    docs = documents(spark, sf).where("n_chars < 300")
    lexicon = written(X.as_lexicon(frequencies(spark, sf)), "lexicon")
    w = documents(spark, sf).select(T.phrase_tokens(F.col("text")).alias("w"))
    grams = K.ngram_counts(w, "w", 2).where("cnt > 2")
    none = F.lit(None).cast("string")
    ngrams = written(grams.select(F.lit("bigram").alias("kind"), none.alias("domain"), "ngram", F.least(F.lit(1.0), F.col("cnt") / 20).alias("score")), "ngrams")
    stripped = docs.select("doc_id", T.strip_accents_keep_case(F.col("text")).alias("text"))
    out = P.correct(stripped, P.Resources(lexicon, lexicon, None, None, None, ngrams), P.Config(phrase_spans=False))
    return out.select("doc_id", "corrected", F.round("confidence", 6).alias("confidence"), F.size("changes").alias("changes"), F.size("flags").alias("flags"), "status")


_BEST = f"(SELECT no_tone, arg_max(surface, (cnt, surface)) AS form FROM {FREQ_SQL} GROUP BY 1)"
_STRIPPED = f"(SELECT doc_id, {strip_sql('text')} AS text FROM documents WHERE text <> '')"


@query("restore_accents", f"SELECT doc_id, string_agg(coalesce(form, token), '' ORDER BY tok_idx) AS restored FROM {tokens_sql(_STRIPPED)} t LEFT JOIN {_BEST} b ON t.token = b.no_tone GROUP BY 1")
def restore_accents(spark, sf):
    return P.restore_accents(documents(spark, sf), frequencies(spark, sf))

