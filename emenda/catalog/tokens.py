"""Sources, tokens and protected spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spans as S
from ..operators import tokens as K
from ..sources import readers, writers
from .registry import Fixture, documents, lit, query, strip_sql, table

_D = f"\\p{{Nd}}{T.OTHER_DIGITS}"
_S = r"\t\x0B\x0C\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = f"\\n+|[{_D}]+|\\p{{L}}+|[{_S}]+|[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]+|[^\\n{_D}\\p{{L}}\\p{{C}}\\p{{Z}}{_S}]+"


def tokens_sql(source: str = "documents", text: str = "text") -> str:
    """(doc_id, tok_idx, token, token_type, start, end)."""
    return f"""(SELECT doc_id, tok_idx, token,
      CASE WHEN regexp_matches(token, '^\\n') THEN 'NEWLINE' WHEN regexp_matches(token, {lit(f'^[{_D}]')}) THEN 'NUMBER'
           WHEN regexp_matches(token, '^\\p{{L}}') THEN CASE WHEN regexp_matches(token, {lit(T.VIETNAMESE)}) THEN 'VI_WORD' ELSE 'FOREIGN_WORD' END
           WHEN regexp_matches(token, {lit(f'^[{_S}]')}) THEN 'SPACE' WHEN regexp_matches(token, '^[\\p{{C}}\\p{{Z}}]') THEN 'UNKNOWN' ELSE 'PUNCT' END AS token_type,
      CAST(sum(length(token)) OVER w - length(token) AS BIGINT) AS start, CAST(sum(length(token)) OVER w AS BIGINT) AS "end"
    FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, l[i] AS token FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all({text}, {lit(_TOKENS)}) AS l FROM {source})))
    WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING))"""


@query("src_text", "SELECT doc_id, trim(text) AS text FROM documents WHERE trim(text) <> ''")
def src_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.trim("text").alias("text")).where("text <> ''")


@query(
    "src_lines",
    "SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE trim(l[i]) <> ''",
)
def src_lines(spark, sf):
    return readers.lines(table(spark, sf, "conversations")).select("conv_id", "turn", "line_no", "line")


RAW_WORDS = Fixture(
    "ord bigint, surface string, type string, freq double, domain string",
    [(1, "muỗng", "word", 0.9, None), (2, "gạt", None, None, None), (3, "ngang", "word", 0.5, "product_instruction"), (4, "ml", "unit", None, None), (5, None, "word", 0.1, None)],
)


@query("src_words", f"SELECT surface, {strip_sql('surface')} AS no_tone, CASE coalesce(type, 'word') WHEN 'unit' THEN 'unit_word' ELSE 'common_word' END AS kind, coalesce(freq, 1.0) AS freq, domain FROM {RAW_WORDS.sql()} WHERE surface IS NOT NULL")
def src_words(spark, sf):
    return readers.lexicon_words(RAW_WORDS.df(spark))


@query("src_units", f"SELECT surface, {strip_sql('surface')} AS no_tone, 'unit_word' AS kind, coalesce(freq, 1.0) AS freq, coalesce(domain, 'measurement') AS domain FROM {RAW_WORDS.sql()} WHERE surface IS NOT NULL")
def src_units(spark, sf):
    return readers.lexicon_units(RAW_WORDS.df(spark))


RAW_SYLLABLES = Fixture("base string, forms array<string>", [("muong", ["muỗng", "mường", "muống"]), ("gat", ["gạt"])])


@query("src_syllables", f"SELECT base, surface, CASE surface WHEN 'muỗng' THEN 0.8 ELSE 0.5 END::DOUBLE AS freq FROM (SELECT base, unnest(forms) AS surface FROM {RAW_SYLLABLES.sql()})")
def src_syllables(spark, sf):
    return readers.syllable_forms(RAW_SYLLABLES.df(spark).withColumn("freqs", F.create_map(F.lit("muỗng"), F.lit(0.8))))


RAW_ABBREVIATIONS = Fixture("abbreviation string, expansions array<string>, ambiguous boolean", [("cc", ["chung cư", "cao cấp"], None), ("tp", ["thành phố"], None), ("vs", ["vệ sinh"], True)])


@query("src_abbrev", f"SELECT surface, coalesce(ambiguous, len(e) > 1) AS ambiguous, CAST(i - 1 AS INTEGER) AS exp_ord, e[i] AS expansion FROM (SELECT abbreviation AS surface, ambiguous, expansions AS e, unnest(range(1, len(expansions) + 1)) AS i FROM {RAW_ABBREVIATIONS.sql()})")
def src_abbrev(spark, sf):
    return readers.abbreviations(RAW_ABBREVIATIONS.df(spark)).select("surface", "ambiguous", "exp_ord", "expansion")


RAW_CONFUSIONS = Fixture("ord bigint, noisy string, corrections array<string>, confidence double", [(1, "mùông", ["muồng"], 0.5), (2, "mùông", ["muỗng", "muống"], None), (3, "rn", ["m"], 0.9)])


@query(
    "src_confusions",
    f"SELECT noisy, coalesce(confidence, 0.7) AS confidence, CAST(i - 1 AS INTEGER) AS corr_ord, corrections[i] AS correction FROM (SELECT *, unnest(range(1, len(corrections) + 1)) AS i FROM {RAW_CONFUSIONS.sql()} QUALIFY row_number() OVER (PARTITION BY noisy ORDER BY ord DESC) = 1)",
)
def src_confusions(spark, sf):
    return readers.confusions(RAW_CONFUSIONS.df(spark))


RAW_PHRASES = Fixture("phrase string, n int, freq double, domain string", [("Số muỗng", 2, 0.9, None), ("muỗng gạt ngang", 2, 0.95, "product_instruction"), ("mối quan hệ", 3, None, None), ("một", 1, 0.4, None)])


@query("src_phrases", f"SELECT phrase, trim({strip_sql('phrase')}) AS no_tone, CAST(n AS INTEGER) AS n, coalesce(freq, 0.5) AS confidence, domain FROM {RAW_PHRASES.sql()}")
def src_phrases(spark, sf):
    return readers.phrases(RAW_PHRASES.df(spark))


@query("src_lex_phrases", f"SELECT phrase, trim({strip_sql('phrase')}) AS no_tone, CAST(len(string_split(phrase, ' ')) AS INTEGER) AS n, coalesce(freq, 0.5) AS confidence, domain FROM {RAW_PHRASES.sql()} WHERE len(string_split(phrase, ' ')) >= 2")
def src_lex_phrases(spark, sf):
    return readers.phrases(RAW_PHRASES.df(spark), recount=True)


@query("src_chem_list", "SELECT DISTINCT trim(l) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#')")
def src_chem_list(spark, sf):
    return readers.term_list(documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")))


RAW_LINES = Fixture("line string", [("3",), ("muỗng/AB",), ("gạt",), ('{"text": "ngang"}',), ("x@y.example",), ("Nguyễn",), ("Smith",), ("",)])
_RAW = "SELECT '{s}' AS source, w AS surface, lower(w) AS normalized, {k} AS no_tone FROM (SELECT {e} AS w FROM {t}{c}) WHERE w IS NOT NULL AND w <> '' AND NOT regexp_matches(w, '\\S+@\\S+\\.\\S+') AND length(regexp_replace(w, '[^0-9]', '', 'g')) / length(w) <= 0.5 AND length(regexp_replace(w, '[\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\-'']', '', 'g')) / length(w) <= 0.3"


def _raw(source: str, expr: str, where: str = "") -> str:
    return _RAW.format(s=source, k=strip_sql("lower(w)"), e=expr, t=RAW_LINES.sql(), c=where)


@query("src_raw_uvd1", _raw("uvd", "trim(line)"))
def src_raw_uvd1(spark, sf):
    return readers.raw_words(RAW_LINES.df(spark), "uvd", "plain")


@query("src_raw_aspell", _raw("aspell", "trim(split_part(line, '/', 1))", " WHERE NOT regexp_matches(line, '^\\s*\\d+\\s*$')"))
def src_raw_aspell(spark, sf):
    return readers.raw_words(RAW_LINES.df(spark), "aspell", "affix")


@query("src_raw_underthesea", _raw("underthesea", "trim(json_extract_string(line, '$.text'))", " WHERE starts_with(line, '{')"))
def src_raw_underthesea(spark, sf):
    return readers.raw_words(RAW_LINES.df(spark), "underthesea", "jsonl")


@query("src_raw_names", _raw("names", "trim(line)") + " AND regexp_matches(w, '[^\\x00-\\x7F]')")
def src_raw_names(spark, sf):
    return readers.raw_words(RAW_LINES.df(spark), "names", "names")


RAW_GOLD = Fixture("line string", [('{"id": "a", "input": "so muong", "expected": "số muỗng", "allowed_outputs": ["số muống"]}',), (" ",), ('{"id": "b", "input": "DHA", "expected": "DHA", "should_change": false, "protected_substrings": ["DHA"]}',)])


@query("src_gold_jsonl", f"SELECT json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.input') AS input, json_extract_string(line, '$.expected') AS expected, CAST(coalesce(json_array_length(line, '$.allowed_outputs'), 0) AS INTEGER) AS n_allowed, CAST(json_extract_string(line, '$.should_change') AS BOOLEAN) AS should_change FROM {RAW_GOLD.sql()} WHERE trim(line) <> ''")
def src_gold_jsonl(spark, sf):
    return readers.gold(RAW_GOLD.df(spark)).select("id", "input", "expected", F.size("allowed_outputs").alias("n_allowed"), "should_change")


@query("tok_tokenize", f"SELECT * FROM {tokens_sql()}")
def tok_tokenize(spark, sf):
    return K.tokenize(documents(spark, sf))


@query("tok_class", "SELECT token_type, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS chars FROM " + tokens_sql() + " GROUP BY 1")
def tok_class(spark, sf):
    return K.tokenize(documents(spark, sf)).groupBy("token_type").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"))


@query("tok_reconstruct", "SELECT doc_id, text FROM documents WHERE text <> ''")
def tok_reconstruct(spark, sf):
    return K.reconstruct(K.tokenize(documents(spark, sf)))


_WORDS = "('VI_WORD', 'FOREIGN_WORD', 'UNKNOWN')"


def islands_sql(source: str = "documents") -> str:
    return f"""(SELECT doc_id, tok_idx, token, island, CAST(row_number() OVER (PARTITION BY doc_id, island ORDER BY tok_idx) - 1 AS INTEGER) AS word_pos FROM (
    SELECT *, CAST(sum(CASE WHEN token_type IN ('VI_WORD', 'FOREIGN_WORD', 'UNKNOWN', 'SPACE') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
    FROM {tokens_sql(source)}) WHERE token_type IN {_WORDS})"""


@query("tok_islands", f"SELECT * FROM {islands_sql()}")
def tok_islands(spark, sf):
    return K.island_words(documents(spark, sf)).select("doc_id", "tok_idx", "token", "island", "word_pos")


@query(
    "tok_spans",
    f"""WITH w AS (SELECT * FROM {islands_sql()})
    SELECT a.doc_id, a.island, a.word_pos AS start_pos, CAST(b.word_pos - a.word_pos + 1 AS INTEGER) AS n, a.tok_idx AS first_tok, b.tok_idx AS last_tok
    FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.island = b.island AND b.word_pos BETWEEN a.word_pos + 1 AND a.word_pos + 7""",
)
def tok_spans(spark, sf):
    return K.span_places(documents(spark, sf))


@query(
    "tok_ngrams",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT w[i : i + n - 1] AS g, n FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT w, unnest([2, 3, 4]) AS n FROM w)))
    SELECT array_to_string(g, ' ') AS ngram, count(*) AS cnt FROM g GROUP BY 1 HAVING count(*) > 1""",
)
def tok_ngrams(spark, sf):
    w = documents(spark, sf).select(T.phrase_tokens(F.col("text")).alias("w"))
    return K.ngram_counts(w, "w", 4).where("cnt > 1")


@query("tok_phrase_rebuild", "SELECT doc_id, upper(text) AS out FROM documents WHERE text <> '' AND NOT contains(text, 'ß')")
def tok_phrase_rebuild(spark, sf):
    rows = K.token_lists(documents(spark, sf).where("text <> '' and not contains(text, 'ß')"))
    rows = rows.withColumn("w", F.transform(F.filter("tokens", lambda x: x.rlike(r"(?U)\S")), lambda x: F.upper(x)))
    return rows.select("doc_id", K.rebuild_phrase(F.col("tokens"), F.col("w")).alias("out"))


_AMBIGUOUS = "length(token) > 7 AND token_type IN ('VI_WORD', 'FOREIGN_WORD')"


@query(
    "tok_windows",
    f"""WITH t AS (SELECT doc_id, tok_idx, {_AMBIGUOUS} AS amb, max(tok_idx) OVER (PARTITION BY doc_id) + 1 AS n FROM {tokens_sql()}),
    a AS (SELECT doc_id, greatest(tok_idx - 2, 0) AS a, least(tok_idx + 3, n, greatest(tok_idx - 2, 0) + 5) AS b FROM t WHERE amb),
    f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM a),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) - 1 AS win FROM f)
    SELECT doc_id, CAST(win AS BIGINT) AS win_id, CAST(min(a) AS INTEGER) AS start_tok, CAST(max(b) AS INTEGER) AS end_tok FROM g GROUP BY 1, 2""",
)
def tok_windows(spark, sf):
    toks = K.tokenize(documents(spark, sf))
    return K.windows(toks.select("doc_id", "tok_idx", F.when(F.expr(_AMBIGUOUS), 2).otherwise(1).alias("n_candidates"), F.lit(False).alias("protected")))


_EMAIL = r"[\p{L}\p{N}\p{M}_.+-]+@[\p{L}\p{N}\p{M}_-]+(?:\.[\p{L}\p{N}\p{M}_-]+)+"


def _hits_sql(kind: str, pattern: str) -> str:
    """Matches with offsets: all gaps and matches before them."""
    return f"""SELECT doc_id, '{kind}' AS kind, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, h[i] AS value
    FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, {lit(pattern)}) AS g, regexp_extract_all(text, {lit(pattern)}) AS h FROM documents WHERE regexp_matches(text, {lit(pattern)})))"""


@query("prot_regex", _hits_sql("email", _EMAIL) + " UNION ALL " + _hits_sql("percent", r"\d+(?:[.,]\d+)?\s?%") + " UNION ALL " + _hits_sql("number", r"\d+(?:[.,]\d+)*"))
def prot_regex(spark, sf):
    ms = [S.RegexMatcher("email", 7, (_EMAIL,)), *(m for m in S.DEFAULT_MATCHERS if m.name in ("percent", "number"))]
    rows = documents(spark, sf).select("doc_id", F.explode(S.candidates(F.col("text"), ms)).alias("s"))
    return rows.select("doc_id", "s.kind", "s.start", "s.value")


@query("prot_lexicon", "SELECT doc_id, CAST(length(text) - length(replace(text, 'Licensed under', '')) AS INTEGER) // 14 AS n FROM documents WHERE contains(text, 'Licensed under')")
def prot_lexicon(spark, sf):
    m = S.lexicon_matcher("licence", 5, ("Licensed under",))
    return documents(spark, sf).select("doc_id", F.size(m.find(F.col("text"))).alias("n")).where("n > 0")


@query("prot_resolve")
def prot_resolve(spark, sf):
    rows = S.protect(documents(spark, sf)).select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.kind", "s.start", "s.end", "s.value")


@query("prot_mask")
def prot_mask(spark, sf):
    return S.protect(documents(spark, sf)).select("doc_id", "masked")


@query("prot_restore", "SELECT doc_id, text FROM documents")
def prot_restore(spark, sf):
    return S.protect(documents(spark, sf)).select("doc_id", S.restore(F.col("masked"), F.col("spans")).alias("text"))


SPANS = Fixture("doc_id bigint, start bigint, end_ bigint", [(0, 0, 10), (1, 5, 25), (2, 3, 3), (3, 12, 40), (3, 30, 60)])


@query("prot_mark", f"SELECT t.doc_id, t.tok_idx, EXISTS (SELECT 1 FROM {SPANS.sql()} s WHERE s.doc_id = t.doc_id AND s.start <= t.start AND t.\"end\" <= s.end_) AS protected FROM {tokens_sql()} t")
def prot_mark(spark, sf):
    toks = K.tokenize(documents(spark, sf))
    return S.mark_tokens(toks, SPANS.df(spark).withColumnRenamed("end_", "end")).select("doc_id", "tok_idx", "protected")


@query("prot_token_rule", "SELECT token_type, token_type IN ('NUMBER', 'UNIT') AS protected, token_type IN ('NUMBER', 'UNIT', 'PUNCT', 'SPACE', 'NEWLINE', 'PROTECTED') AS identity_only, count(*) AS n FROM " + tokens_sql() + " GROUP BY 1, 2, 3")
def prot_token_rule(spark, sf):
    t = F.col("token_type")
    return K.tokenize(documents(spark, sf)).groupBy(t, t.isin("NUMBER", "UNIT").alias("protected"), t.isin(*K.IDENTITY_ONLY).alias("identity_only")).agg(F.count("*").alias("n"))


@query("flt_words", f"SELECT doc_id, count(*) AS n FROM {tokens_sql()} WHERE token_type IN {_WORDS} GROUP BY 1")
def flt_words(spark, sf):
    return K.tokenize(documents(spark, sf)).where(F.col("token_type").isin(*K.WORDS)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("snk_json", "SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR) AS json FROM documents")
def snk_json(spark, sf):
    return writers.as_json(documents(spark, sf), "doc_id")


@query("snk_debug", f"SELECT doc_id, tok_idx, printf('%3d %s %s%s', tok_idx, token, token_type, CASE WHEN length(token) = 3 THEN ' [protected]' ELSE '' END) AS line FROM {tokens_sql()}")
def snk_debug(spark, sf):
    return writers.token_lines(K.tokenize(documents(spark, sf)).withColumn("protected", F.length("token") == 3))


@query("snk_text", "SELECT doc_id, '[0:' || n_chars || '] ''' || source || ''' -> ''' || lang || ''' (50.00%)' AS line FROM documents")
def snk_text(spark, sf):
    return documents(spark, sf).select("doc_id", writers.change_line(F.lit(0), F.col("n_chars"), F.col("source"), F.col("lang"), F.lit(0.5)).alias("line"))
