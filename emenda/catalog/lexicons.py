"""Lexicon builds, checks and packages over rows mined from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup as L
from ..plans import builders as B
from ..plans import validation as V
from .building import _TOK, FREQ_SQL, _tokens, frequencies
from .registry import documents, query, strip_sql

_W = "(SELECT doc_id AS ord, lang, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM documents)"
_WORD = f"(SELECT ord, coalesce(w[1], '') AS surface, CASE WHEN ord % 6 = 0 THEN NULL ELSE w[1] END AS normalized, CASE ord % 5 WHEN 0 THEN 'unit_word' WHEN 1 THEN 'chemical' WHEN 2 THEN 'brand' WHEN 3 THEN 'word' END AS type, CASE WHEN ord % 7 = 0 THEN NULL ELSE (ord % 13) / 10 END AS freq, CASE WHEN ord % 3 = 0 THEN lang END AS domain FROM {_W})"
_PHRASE = f"(SELECT ord, array_to_string(w[1:CAST(ord % 4 AS INTEGER)], ' ') AS phrase, CASE WHEN ord % 6 = 0 THEN '' ELSE lang END AS normalized, CASE WHEN ord % 9 = 0 THEN NULL ELSE CAST(ord % 4 AS INTEGER) END AS n, CASE WHEN ord % 7 = 0 THEN NULL ELSE (ord % 13) / 10 END AS freq, lang AS domain FROM {_W})"
_CONFUSION = f"(SELECT ord, CASE WHEN ord % 8 = 0 THEN '' ELSE w[1] END AS noisy, CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 5 = 0 THEN list_concat(w[2:3], [' ']) ELSE w[2:1 + CAST(ord % 3 AS INTEGER)] END AS corrections, CASE WHEN ord % 7 = 0 THEN NULL ELSE (ord % 13) / 10 END AS confidence FROM {_W})"
_ABBREVIATION = f"(SELECT ord, w[1][1:2] AS abbreviation, CASE WHEN ord % 3 = 0 THEN 'n' END AS normalized, CASE WHEN ord % 5 = 0 THEN list_concat(w[1:1], ['']) ELSE w[1:CAST(ord % 4 AS INTEGER)] END AS expansions, CASE WHEN ord % 10 = 0 THEN true END AS ambiguous FROM {_W})"
_SYLLABLE = f"(SELECT no_tone AS base, list(surface ORDER BY surface) AS forms, list(freq ORDER BY surface) AS freqs FROM {FREQ_SQL} GROUP BY 1)"


def _raw(spark, sf):
    w = documents(spark, sf).select(F.col("doc_id").alias("ord"), "lang", T.phrase_tokens(F.col("text")).alias("w"))
    first, upto = F.get("w", F.lit(0)), lambda a, n: F.slice("w", F.lit(a), n.cast("int"))
    ord_ = F.col("ord")
    share = F.when(ord_ % 7 != 0, (ord_ % 13) / 10)
    none = F.lit(None).cast("array<string>")
    kind = F.when(ord_ % 5 == 0, "unit_word").when(ord_ % 5 == 1, "chemical").when(ord_ % 5 == 2, "brand").when(ord_ % 5 == 3, "word")
    syllable = frequencies(spark, sf).groupBy(F.col("no_tone").alias("base")).agg(F.sort_array(F.collect_list(F.struct("surface", "freq"))).alias("f"))
    return {
        "syllables": syllable.select(F.lit(0).cast("bigint").alias("ord"), "base", F.col("f.surface").alias("forms"), F.map_from_entries("f").alias("freq")),
        "words": w.select("ord", F.coalesce(first, F.lit("")).alias("surface"), F.when(ord_ % 6 != 0, first).alias("normalized"), kind.alias("type"), share.alias("freq"), F.when(ord_ % 3 == 0, F.col("lang")).alias("domain")),
        "phrases": w.select("ord", F.array_join(upto(1, ord_ % 4), " ").alias("phrase"), F.when(ord_ % 6 == 0, "").otherwise(F.col("lang")).alias("normalized"), F.when(ord_ % 9 != 0, (ord_ % 4).cast("int")).alias("n"), share.alias("freq"), F.col("lang").alias("domain"), none.alias("tags")),
        "confusions": w.select(
            "ord", F.when(ord_ % 8 == 0, "").otherwise(first).alias("noisy"),
            F.when(ord_ % 11 == 0, none).when(ord_ % 5 == 0, F.concat(upto(2, F.lit(2)), F.array(F.lit(" ")))).otherwise(upto(2, ord_ % 3)).alias("corrections"), share.alias("confidence"),
        ),
        "abbreviations": w.select(
            "ord", F.substring(first, 1, 2).alias("abbreviation"), F.when(ord_ % 3 == 0, "n").alias("normalized"),
            F.when(ord_ % 5 == 0, F.concat(upto(1, F.lit(1)), F.array(F.lit("")))).otherwise(upto(1, ord_ % 4)).alias("expansions"), none.alias("tags"), F.when(ord_ % 10 == 0, True).alias("ambiguous"),
        ),
    }


_NO = "NULL::VARCHAR"
_BUILT = f"""(
  SELECT 'syllables' AS builder, CAST(0 AS BIGINT) AS ord, 'syllable/' || f AS entry_id, f AS surface, f AS normalized, base AS no_tone, 'syllable' AS kind, NULL::INTEGER AS n, {_NO} AS vals, NULL::BOOLEAN AS ambiguous, q AS confidence, q AS frequency, {_NO} AS domain, 'syllable' AS tags
    FROM (SELECT base, unnest(forms) AS f, unnest(freqs) AS q FROM {_SYLLABLE})
  UNION ALL SELECT 'words', ord, 'word/' || surface, surface, lower(surface), {strip_sql('surface')}, CASE type WHEN 'unit_word' THEN 'unit' WHEN 'chemical' THEN 'domain_term' WHEN 'brand' THEN 'brand' ELSE 'word' END, NULL, NULL, NULL, coalesce(freq, 1), coalesce(freq, 1), domain, coalesce(type, 'word') FROM {_WORD} WHERE surface <> ''
  UNION ALL SELECT 'phrases', ord, 'phrase/' || phrase, phrase, {strip_sql('phrase')}, {strip_sql('phrase')}, NULL, coalesce(n, 0), NULL, NULL, coalesce(freq, 0.5), coalesce(freq, 0.5), domain, '' FROM {_PHRASE} WHERE phrase <> ''
  UNION ALL SELECT 'confusions', ord, 'ocr/' || noisy, noisy, NULL, {strip_sql('noisy')}, NULL, NULL, array_to_string(corrections, '|'), NULL, coalesce(confidence, 0.7), NULL, NULL, NULL FROM {_CONFUSION} WHERE noisy <> '' AND len(corrections) > 0
  UNION ALL SELECT 'abbreviations', ord, 'abbrev/' || abbreviation, abbreviation, coalesce(normalized, lower(abbreviation)), NULL, NULL, NULL, array_to_string(expansions, '|'), coalesce(ambiguous, len(expansions) > 1), 1.0, NULL, NULL, '' FROM {_ABBREVIATION} WHERE abbreviation <> '' AND len(expansions) > 0)"""


@query("bl_builders", f"SELECT builder, ord, entry_id, surface, normalized, no_tone, kind, coalesce(n, -1) AS n, vals, ambiguous, round(confidence, 6) AS confidence, round(frequency, 6) AS frequency, domain, tags FROM {_BUILT}")
def bl_builders(spark, sf):
    raw, out = _raw(spark, sf), None
    for name, builder in B.BUILDERS.items():
        out = builder(raw[name]) if out is None else out.unionByName(builder(raw[name]))
    return out.select(
        "builder", "ord", "entry_id", "surface", "normalized", "no_tone", "kind", F.coalesce("n", F.lit(-1)).alias("n"), F.array_join("values", "|").alias("vals"), "ambiguous", F.round("confidence", 6).alias("confidence"), F.round("frequency", 6).alias("frequency"),
        "domain", F.array_join("tags", "|").alias("tags"),
    )


@query("jn_unit", f"SELECT token, ord FROM {_TOK} t JOIN {_BUILT} b ON t.token = b.surface WHERE b.kind = 'unit'")
def jn_unit(spark, sf):
    return L.by_surface(_tokens(spark, sf), B.words(_raw(spark, sf)["words"]).where("kind = 'unit'")).select("token", "ord")


_ASKED = f"(SELECT DISTINCT phrase AS token FROM {_PHRASE} WHERE ord % 2 = 0)"


@query("jn_phrase", f"SELECT a.token, p.ord, p.confidence FROM {_ASKED} a JOIN {_BUILT} p ON a.token = p.surface WHERE p.builder = 'phrases'")
def jn_phrase(spark, sf):
    """Phrases by their text: all entries of each."""
    raw = _raw(spark, sf)["phrases"]
    asked = raw.where("ord % 2 = 0").select(F.col("phrase").alias("token")).distinct()
    return L.by_surface(asked, B.phrases(raw)).select("token", "ord", "confidence")


_KIND = "coalesce(kind, CASE builder WHEN 'phrases' THEN 'phrase' WHEN 'confusions' THEN 'ocr_confusion' ELSE 'abbreviation' END)"
_STATS = f"""SELECT 'total' AS what, 'entries' AS name, count(*) AS n FROM {_BUILT} UNION ALL SELECT 'total', 'surfaces', count(DISTINCT surface) FROM {_BUILT} UNION ALL SELECT 'total', 'keys', count(DISTINCT CASE WHEN no_tone <> '' THEN no_tone END) FROM {_BUILT}
  UNION ALL SELECT 'kind', {_KIND}, count(*) FROM {_BUILT} GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM {_BUILT} WHERE domain <> '' GROUP BY 2"""


@query(
    "bl_pipeline",
    f"""{_STATS} UNION ALL SELECT 'errors', builder, count(*) FROM (
      SELECT builder FROM {_BUILT} WHERE builder = 'phrases' AND n < 1 UNION ALL SELECT builder FROM {_BUILT} WHERE builder = 'confusions' AND confidence > 1
      UNION ALL SELECT 'abbreviations' FROM (SELECT unnest(expansions) AS v FROM {_ABBREVIATION} WHERE abbreviation <> '' AND len(expansions) > 0) WHERE v = '') GROUP BY 2""",
)
def bl_pipeline(spark, sf):
    built = B.build(_raw(spark, sf), "1", "documents")
    return built.stats.union(built.errors.groupBy("builder").agg(F.count("*").alias("n")).select(F.lit("errors").alias("what"), F.col("builder").alias("name"), "n"))


@query("snk_package", f"SELECT builder, ord, entry_id, CASE builder WHEN 'phrases' THEN 'PhraseEntry' WHEN 'confusions' THEN 'OcrConfusionEntry' WHEN 'abbreviations' THEN 'AbbreviationEntry' ELSE 'LexiconEntry' END AS type, surface, kind, domain, round(confidence, 6) AS confidence, round(frequency, 6) AS frequency FROM {_BUILT}")
def snk_package(spark, sf):
    rows = B.package_rows(B.build(_raw(spark, sf), "1").entries)
    get = lambda path: F.get_json_object("json", f"$.{path}")
    number = lambda path: F.round(get(path).cast("double"), 6)
    return rows.select("builder", "ord", get("entry_id").alias("entry_id"), get("type").alias("type"), get("surface").alias("surface"), get("kind").alias("kind"), get("domain").alias("domain"), number("score.confidence").alias("confidence"), number("score.frequency").alias("frequency"))


_EMPTY = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing field ''{c}''' WHEN {c} = '' THEN '''{c}'' is empty' END"
_RANGE = lambda c: f"CASE WHEN {c} < 0 OR {c} > 1 THEN '''{c}'' is not between 0 and 1: ' || {c} END"
_SOME = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing field ''{c}''' WHEN len({c}) = 0 THEN '''{c}'' is empty' END"
_ITEMS = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x, i: CASE WHEN trim(x) = '' THEN '''{c}'' ' || (i - 1) || ' is empty' END), lambda x: x IS NOT NULL)"


def _messages(kind: str, table: str, parts: list[str], more: str = "[]") -> str:
    return f"SELECT '{kind}' AS kind, ord, array_to_string(list_concat(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), {more}), '; ') AS errors FROM {table}"


@query(
    "bl_validate",
    f"""SELECT * FROM ({_messages('word', _WORD, [_EMPTY('surface'), _EMPTY('normalized'), _RANGE('freq')])}
    UNION ALL {_messages('phrase', _PHRASE, [_EMPTY('phrase'), _EMPTY('normalized'), "CASE WHEN n IS NULL THEN 'missing field ''n''' WHEN n < 1 THEN '''n'' is not positive' END", _RANGE('freq')])}
    UNION ALL {_messages('abbreviation', _ABBREVIATION, [_EMPTY('abbreviation'), _SOME('expansions')], _ITEMS('expansions'))}
    UNION ALL {_messages('ocr_confusion', _CONFUSION, [_EMPTY('noisy'), _SOME('corrections'), _RANGE('confidence')], _ITEMS('corrections'))}
    UNION ALL SELECT 'syllable', len(forms), '' FROM {_SYLLABLE})""",
)
def bl_validate(spark, sf):
    raw, out = _raw(spark, sf), None
    for kind, name in (("word", "words"), ("phrase", "phrases"), ("abbreviation", "abbreviations"), ("ocr_confusion", "confusions"), ("syllable", "syllables")):
        rows = V.entry_errors(raw[name], kind)
        ord_ = F.size("forms").cast("bigint") if kind == "syllable" else F.col("ord")
        rows = rows.select(F.lit(kind).alias("kind"), ord_.alias("ord"), F.array_join("errors", "; ").alias("errors"))
        out = rows if out is None else out.unionByName(rows)
    return out
