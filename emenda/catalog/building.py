"""Lexicon and n-gram builds, look-ups, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup as L
from ..operators import tokens as K
from ..plans import evaluation as E
from ..plans import lexicon as X
from ..sources import writers
from .registry import Fixture, documents, lit, query, strip_sql
from .tokens import tokens_sql

_WORDS = "SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS surface FROM documents"
FREQ_SQL = f"""(SELECT no_tone, surface, cnt, cnt / sum(cnt) OVER (PARTITION BY no_tone) AS freq FROM
  (SELECT surface, count(*) AS cnt, {strip_sql('surface')} AS no_tone FROM ({_WORDS}) WHERE regexp_matches(surface, '^\\p{{L}}{{1,7}}$') GROUP BY surface))"""


def frequencies(spark, sf):
    return X.syllable_frequencies(documents(spark, sf))


@query("bl_syllable_freq", f"SELECT no_tone, surface, cnt, round(freq, 9) AS freq FROM {FREQ_SQL}")
def bl_syllable_freq(spark, sf):
    return frequencies(spark, sf).withColumn("freq", F.round("freq", 9))


_SOURCES = {"src0": "uvd", "src1": "underthesea", "src2": "aspell", "src3": "names"}
_MAP = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SOURCES.items()) + " END"
_DICT = f"""(SELECT {_MAP} AS source, w AS surface, lower(w) AS normalized, {strip_sql('w')} AS no_tone, w AS ord FROM
  (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) WHERE regexp_matches(w, '^\\p{{L}}+$'))"""
_MERGED = f"""(SELECT normalized, surface, no_tone, CAST(len(s) AS INTEGER) AS n_sources, CASE WHEN len(s) >= 3 THEN 1.0 WHEN len(s) = 2 THEN 0.98
    WHEN s[1] = 'uvd' THEN 0.90 WHEN s[1] = 'underthesea' THEN 0.95 WHEN s[1] = 'aspell' THEN 0.92 ELSE 0.80 END::DOUBLE AS confidence,
    CASE WHEN len(s) = 1 AND s[1] = 'names' THEN 'name' ELSE 'word' END AS kind
  FROM (SELECT normalized, arg_min(surface, ord) AS surface, arg_min(no_tone, ord) AS no_tone, list_sort(list_distinct(list(source))) AS s FROM {_DICT} GROUP BY normalized))"""


def _dictionary(spark, sf):
    rows = documents(spark, sf).where(F.col("source").isin(*_SOURCES)).select("source", F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike(r"^\p{L}+$"))
    source = F.element_at(F.create_map(*(F.lit(x) for k, v in _SOURCES.items() for x in (k, v))), F.col("source"))
    return rows.select(source.alias("source"), F.col("w").alias("surface"), F.lower("w").alias("normalized"), T.strip_accents(F.col("w")).alias("no_tone"), F.col("w").alias("ord"))


@query("bl_union", f"SELECT source, count(*) AS n FROM {_DICT} GROUP BY 1")
def bl_union(spark, sf):
    rows = _dictionary(spark, sf)
    parts = [rows.where(F.col("source") == s) for s in _SOURCES.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query("bl_merge", f"SELECT * FROM {_MERGED}")
def bl_merge(spark, sf):
    return X.merge_words(_dictionary(spark, sf))


@query("bl_build_words", f"SELECT kind, confidence, count(*) AS n FROM {_MERGED} GROUP BY 1, 2")
def bl_build_words(spark, sf):
    return X.merge_words(_dictionary(spark, sf)).groupBy("kind", "confidence").agg(F.count("*").alias("n"))


@query("bl_notone_index", f"SELECT no_tone, normalized, CAST(row_number() OVER (PARTITION BY no_tone ORDER BY confidence DESC, n_sources DESC, normalized) AS INTEGER) AS rank FROM {_MERGED}")
def bl_notone_index(spark, sf):
    return X.no_tone_index(X.merge_words(_dictionary(spark, sf))).select("no_tone", "normalized", "rank")


@query("bl_populate", f"SELECT no_tone, arg_min(surface, ord) AS surface FROM {_DICT} GROUP BY 1")
def bl_populate(spark, sf):
    return X.first_by(_dictionary(spark, sf), "no_tone", F.col("ord")).select("no_tone", "surface")


@query("bl_trusted", f"SELECT no_tone, arg_max(surface, ord) AS surface FROM {_DICT} GROUP BY 1")
def bl_trusted(spark, sf):
    return X.first_by(_dictionary(spark, sf), "no_tone", F.desc("ord")).select("no_tone", "surface")


@query("bl_stats", f"SELECT coalesce(kind, '*') AS kind, count(*) AS entries, count(DISTINCT surface) AS surfaces, count(DISTINCT no_tone) AS keys, CAST(0 AS BIGINT) AS with_domain FROM {_MERGED} GROUP BY ROLLUP (kind)")
def bl_stats(spark, sf):
    return X.statistics(X.merge_words(_dictionary(spark, sf)).withColumn("domain", F.lit(None).cast("string")))


@query("bl_counts", f"SELECT 'frequencies' AS name, count(*) AS rows FROM {FREQ_SQL} UNION ALL SELECT 'merged', count(*) FROM {_MERGED}")
def bl_counts(spark, sf):
    return writers.counts({"frequencies": frequencies(spark, sf), "merged": X.merge_words(_dictionary(spark, sf))})


_SRC = "CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'curated' WHEN 1 THEN 'domain' WHEN 2 THEN 'lexicon' ELSE 'mined' END"
_WGT = "CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.45 END::DOUBLE"
_PHRASES = f"""(SELECT doc_id AS ord, lang, {_SRC} AS source, {_WGT} AS weight, w[1:1 + CAST(doc_id % 5 AS INTEGER)] AS tokens, ((doc_id % 10) + 1) / 10.0::DOUBLE AS score FROM
  (SELECT doc_id, lang, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)"""
_DEDUP = f"(SELECT * FROM (SELECT *, round(weight * score, 10) AS weighted, array_to_string(tokens, ' ') AS key FROM {_PHRASES}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY weighted DESC, ord) = 1)"


def _phrases(spark, sf):
    w = T.phrase_tokens(F.col("text"))
    source = F.element_at(F.array(*map(F.lit, ("curated", "domain", "lexicon", "mined"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = documents(spark, sf).select("doc_id", "lang", source.alias("source"), w.alias("w")).where(F.size("w") > 0)
    return rows.select(F.col("doc_id").alias("ord"), "lang", "source", F.array_join(F.slice("w", F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), " ").alias("phrase"), ((F.col("doc_id") % 10 + 1) / 10.0).alias("score"))


@query("ng_dedup", f"SELECT key, source, weighted, ord FROM {_DEDUP}")
def ng_dedup(spark, sf):
    return X.dedup_phrases(_phrases(spark, sf)).select("key", "source", "weighted", "ord")


_NGRAMS = f"""(WITH p AS (SELECT tokens, weighted FROM {_DEDUP} WHERE len(tokens) >= 2),
  g AS (SELECT tokens[i : i + n - 1] AS g, n, len(tokens) AS size, weighted FROM (SELECT *, unnest(range(1, len(tokens) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS n FROM p)))
  SELECT CAST(n AS INTEGER) AS n, array_to_string(g, ' ') AS ngram, round(max(greatest(0.05, least(1.0, weighted * CASE WHEN n = size THEN 1.0 WHEN n >= 3 THEN 0.85 ELSE 0.70 END::DOUBLE))), 10) AS score FROM g GROUP BY 1, 2)"""


@query("ng_build", f"SELECT * FROM {_NGRAMS}")
def ng_build(spark, sf):
    return X.build_ngrams(X.dedup_phrases(_phrases(spark, sf)))


@query("snk_ngram_store", f"SELECT CASE n WHEN 2 THEN 'bigram' WHEN 3 THEN 'trigram' ELSE 'fourgram' END AS kind, count(*) AS n, round(sum(score), 6) AS total FROM {_NGRAMS} GROUP BY 1")
def snk_ngram_store(spark, sf):
    return X.as_store(X.build_ngrams(X.dedup_phrases(_phrases(spark, sf)))).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


_TOK = "(SELECT DISTINCT token FROM " + tokens_sql() + " WHERE token_type IN ('VI_WORD', 'FOREIGN_WORD'))"


def _tokens(spark, sf):
    return K.tokenize(documents(spark, sf)).where("token_type in ('VI_WORD', 'FOREIGN_WORD')").select("token").distinct()


@query("jn_surface", f"SELECT token, cnt FROM {_TOK} t JOIN {FREQ_SQL} f ON t.token = f.surface")
def jn_surface(spark, sf):
    return L.by_surface(_tokens(spark, sf), frequencies(spark, sf)).select("token", "cnt")


@query("jn_accentless", f"SELECT token, surface, cnt FROM {_TOK} t JOIN {FREQ_SQL} f ON {strip_sql('t.token')} = f.no_tone")
def jn_accentless(spark, sf):
    return L.by_no_tone(_tokens(spark, sf), frequencies(spark, sf)).select("token", "surface", "cnt")


@query("jn_syllable", f"SELECT token, count(*) AS forms, max(cnt) AS most FROM {_TOK} t JOIN {FREQ_SQL} f ON {strip_sql('t.token')} = f.no_tone GROUP BY 1")
def jn_syllable(spark, sf):
    return L.by_no_tone(_tokens(spark, sf), frequencies(spark, sf)).groupBy("token").agg(F.count("*").alias("forms"), F.max("cnt").alias("most"))


@query("jn_semi_word", f"SELECT token, token IN (SELECT surface FROM {FREQ_SQL}) AS known FROM {_TOK}")
def jn_semi_word(spark, sf):
    return L.flagged(_tokens(spark, sf), frequencies(spark, sf), "token", "surface", "known")


@query("jn_anti_seen", f"SELECT surface, 1 AS src FROM (SELECT DISTINCT surface FROM {_DICT} WHERE source = 'uvd') UNION ALL SELECT surface, 2 FROM (SELECT DISTINCT surface FROM {_DICT} WHERE source = 'names') WHERE surface NOT IN (SELECT surface FROM {_DICT} WHERE source = 'uvd')")
def jn_anti_seen(spark, sf):
    rows = _dictionary(spark, sf)
    a = rows.where("source = 'uvd'").select("surface").distinct().withColumn("src", F.lit(1))
    b = rows.where("source = 'names'").select("surface").distinct().withColumn("src", F.lit(2))
    return L.first_loaded(a, b, key="surface")


@query("jn_prefix", f"SELECT token, count(*) AS n FROM {_TOK} t JOIN {FREQ_SQL} f ON {strip_sql('t.token')}[1:3] = f.no_tone[1:3] GROUP BY 1")
def jn_prefix(spark, sf):
    return L.by_prefix(_tokens(spark, sf), frequencies(spark, sf)).groupBy("token").agg(F.count("*").alias("n"))


@query("jn_index", f"SELECT no_tone, count(*) AS n, array_to_string(list_sort(list(surface)), '|') AS surfaces FROM {FREQ_SQL} GROUP BY 1")
def jn_index(spark, sf):
    return frequencies(spark, sf).groupBy("no_tone").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("surface")), "|").alias("surfaces"))


@query("jn_ngram", f"WITH b AS (SELECT DISTINCT array_to_string(tokens[1:2], ' ') AS key FROM {_PHRASES}) SELECT b.key, coalesce(g.score, 0.0) AS score FROM b LEFT JOIN (SELECT * FROM {_NGRAMS} WHERE n = 2) g ON b.key = g.ngram")
def jn_ngram(spark, sf):
    rows = _phrases(spark, sf).select(F.array_join(F.slice(F.split("phrase", " "), 1, 2), " ").alias("key")).distinct()
    return L.ngram_score(rows, X.as_store(X.build_ngrams(X.dedup_phrases(_phrases(spark, sf)))), "bigram", F.col("key"), "score").select("key", "score")


INTERVALS = Fixture("id bigint, a bigint, b bigint, c bigint, d bigint", [(1, 0, 5, 4, 9), (2, 0, 5, 5, 9), (3, 0, 9, 2, 4), (4, 2, 4, 0, 9), (5, 3, 3, 3, 3)])


@query("jn_overlap", f"SELECT id, a < d AND c < b AS overlap, a <= c AND d <= b AS cover FROM {INTERVALS.sql()}")
def jn_overlap(spark, sf):
    c = [F.col(x) for x in "abcd"]
    return INTERVALS.df(spark).select("id", L.overlaps(*c).alias("overlap"), L.covers(*c).alias("cover"))


@query("jn_span_theta", f"SELECT t.doc_id, count(*) AS n FROM {tokens_sql()} t JOIN (SELECT doc_id, 10 AS a, 200 AS b FROM documents) s ON s.doc_id = t.doc_id AND s.a <= t.start AND t.\"end\" <= s.b GROUP BY 1")
def jn_span_theta(spark, sf):
    from ..operators.spans import mark_tokens

    d = documents(spark, sf)
    marked = mark_tokens(K.tokenize(d), d.select("doc_id", F.lit(10).alias("start"), F.lit(200).alias("end")))
    return marked.where("protected").groupBy("doc_id").agg(F.count("*").alias("n"))


_GOLD = f"(SELECT doc_id, lang, {strip_sql('text')} AS input, lower(text) AS expected FROM documents)"
_OUT = "CASE WHEN doc_id % 3 = 0 THEN expected ELSE input END"
_EVAL = f"""(SELECT *, output = expected AS exact, output = expected AS accepted, output <> input AS changed, NOT should AND output <> input AS over, should AND output = input AS under FROM
  (SELECT *, {_OUT} AS output, doc_id % 2 = 0 AS should FROM {_GOLD}))"""


def gold(spark, sf):
    return documents(spark, sf).select("doc_id", "lang", T.strip_accents(F.col("text")).alias("input"), F.lower("text").alias("expected"))


def _evaluated(spark, sf, wer=False):
    rows = gold(spark, sf).withColumn("output", F.expr(_OUT)).withColumn("should_change", F.expr("doc_id % 2 = 0"))
    rows = rows.withColumn("allowed_outputs", F.array().cast("array<string>")).withColumn("protected_substrings", F.array(F.substring("expected", 1, 3)))
    return E.evaluate(rows, wer)


#: No accented letter of expected is in input, so each is an edit; so is each word that has one.
_EDITS = f"(length(expected) - length(translate(expected, {lit(T.ACCENTED)}, '')))"
_WORDLIST = "list_filter(string_split_regex(expected, '\\s+'), lambda x: x <> '')"
_RATED = f"""(SELECT *, contains(input, expected[1:3]) AND NOT contains(output, expected[1:3]) AS violation, CASE WHEN length(expected) = 0 THEN 0 ELSE {_EDITS} / length(expected) END AS cer_before,
  CASE WHEN length(expected) = 0 OR output = expected THEN 0 ELSE {_EDITS} / length(expected) END AS cer_after FROM {_EVAL})"""
_SUMS = ", ".join(f"CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS {c}" for c in ("exact", "accepted", "changed", "over", "under", "violation"))
_REPORT = f"count(*) AS examples, {_SUMS}, round(avg(cer_before), 6) AS cer_before, round(avg(cer_after), 6) AS cer_after, round(CASE WHEN avg(cer_before) > 0 THEN (avg(cer_before) - avg(cer_after)) / avg(cer_before) * 100 ELSE 0 END, 6) AS improvement FROM {_RATED}"


@query("ev_one", f"SELECT doc_id, exact, accepted, changed, over, under, contains(input, expected[1:3]) AND NOT contains(output, expected[1:3]) AS violation FROM {_EVAL}")
def ev_one(spark, sf):
    return _evaluated(spark, sf).select("doc_id", "exact", "accepted", "changed", "over", "under", "violation")


@query("ev_counts", f"SELECT lang, count(*) AS examples, CAST(sum(CAST(exact AS INTEGER)) AS BIGINT) AS exact, CAST(sum(CAST(over AS INTEGER)) AS BIGINT) AS over, CAST(sum(CAST(under AS INTEGER)) AS BIGINT) AS under FROM {_EVAL} GROUP BY 1")
def ev_counts(spark, sf):
    rows = _evaluated(spark, sf)
    c = lambda x: F.sum(F.col(x).cast("bigint")).alias(x)
    return rows.groupBy("lang").agg(F.count("*").alias("examples"), c("exact"), c("over"), c("under"))


_ASCII = f"(SELECT * FROM (SELECT doc_id, lang, regexp_replace({strip_sql('text')}, '[^\\x00-\\x7F]', '', 'g') AS expected FROM documents) WHERE length(expected) > 0)"
#: The output has no e, so each is an edit, and nothing else is.
_CER = f"(SELECT doc_id, lang, round((length(expected) - length(replace(expected, 'e', ''))) / length(expected), 6) AS cer FROM {_ASCII})"


def _cer(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang", F.regexp_replace(T.strip_accents(F.col("text")), r"[^\x00-\x7F]", "").alias("expected")).where("length(expected) > 0")
    out = F.expr("replace(expected, 'e', if(doc_id % 2 = 0, 'x', ''))")
    return d.select("doc_id", "lang", F.round(E.cer(out, F.col("expected")), 6).alias("cer"))


@query("ev_cer", f"SELECT * FROM {_CER}")
def ev_cer(spark, sf):
    return _cer(spark, sf)


@query(
    "ev_wer",
    f"SELECT doc_id, round(r, 6) AS before, round(CASE WHEN output = expected THEN 0 ELSE r END, 6) AS after FROM (SELECT *, CASE WHEN len({_WORDLIST}) = 0 THEN 0 ELSE len(list_filter({_WORDLIST}, lambda x: x <> translate(x, {lit(T.ACCENTED)}, {lit(T.BASES)}))) / len({_WORDLIST}) END AS r FROM {_EVAL})",
)
def ev_wer(spark, sf):
    return _evaluated(spark, sf, True).select("doc_id", F.round("wer_before", 6).alias("before"), F.round("wer_after", 6).alias("after"))


@query("ev_report", f"SELECT lang, {_REPORT} GROUP BY 1")
def ev_report(spark, sf):
    return E.report(_evaluated(spark, sf), "lang")


@query("ev_worst", f"SELECT doc_id, cer FROM {_CER} ORDER BY cer DESC, doc_id LIMIT 5")
def ev_worst(spark, sf):
    return E.worst(_cer(spark, sf).withColumnRenamed("cer", "cer_after"), "doc_id").select("doc_id", F.col("cer_after").alias("cer"))


@query("snk_report", f"SELECT {_REPORT}")
def snk_report(spark, sf):
    return E.report(_evaluated(spark, sf))


@query("snk_gate", f"SELECT examples, accepted, violation, accepted / examples >= 0.2 AND over / examples <= 0.5 AND violation <= 0 AS passed, accepted / examples >= 0.2 AND over / examples <= 0.5 AS lenient FROM (SELECT {_REPORT})")
def snk_gate(spark, sf):
    found = E.report(_evaluated(spark, sf))
    strict = E.gate(found, 0.2, 0.5)
    return E.gate(strict.withColumnRenamed("passed", "strict"), 0.2, 0.5, 1 << 40).select("examples", "accepted", "violation", F.col("strict").alias("passed"), F.col("passed").alias("lenient"))


@query("snk_lexicon", f"SELECT kind, count(*) AS n FROM {_MERGED} GROUP BY 1")
def snk_lexicon(spark, sf):
    rows = writers.lexicon_jsonl(X.merge_words(_dictionary(spark, sf)).withColumn("source", F.lit("merged")))
    return rows.select(F.get_json_object("json", "$.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))

