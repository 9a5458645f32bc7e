"""Text functions over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import VI_SQL, Fixture, documents, key_sql, lit, query, strip_sql

_INV, _ODD = lit(T.INVISIBLE), lit(T.ODD_SPACES)


def _ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), {_ODD}, ' ', 'g')"


CASES = Fixture(
    "id bigint, text string",
    [
        (1, "Số MÙÔNG gạt"), (2, "MUỖNG GẠT NGANG"), (3, "xin chào"), (4, "Đường"), (5, "123 !?"), (6, ""), (7, "été café"), (8, "a​b‍c﻿­"), (9, "x\r\ny\rz w　v"),
        (10, "ð Ð ŏ – “q” ‘s’"), (11, "  Nhiều   khoảng\t\ttrắng "), (12, "façade naïve señor"), (13, "user@example.com"), (14, "https://a.example"), (15, "!!!???###"), (16, "12345a"), (17, "ß Straße"),
    ],
)


def _cases(expr: str) -> str:
    return f"SELECT id, {expr} FROM {CASES.sql()}"


@query("fn_nfc", "SELECT doc_id, nfc_normalize(text) AS out FROM documents")
def fn_nfc(spark, sf):
    return documents(spark, sf).select("doc_id", T.nfc(F.col("text")).alias("out"))


@query("fn_nfc_cases", _cases("nfc_normalize(text) AS out"))
def fn_nfc_cases(spark, sf):
    return CASES.df(spark).select("id", T.nfc(F.col("text")).alias("out"))


@query("fn_rm_invisible", f"SELECT doc_id, regexp_replace(text, {_INV}, '', 'g') AS out, CAST(length(text) - length(regexp_replace(text, {_INV}, '', 'g')) AS BIGINT) AS removed FROM documents")
def fn_rm_invisible(spark, sf):
    out = T.remove_invisible(F.col("text"))
    return documents(spark, sf).select("doc_id", out.alias("out"), F.regexp_count("text", F.lit(T.INVISIBLE)).cast("bigint").alias("removed"))


@query("fn_rm_invisible_cases", _cases(f"regexp_replace(text, {_INV}, '', 'g') AS out"))
def fn_rm_invisible_cases(spark, sf):
    return CASES.df(spark).select("id", T.remove_invisible(F.col("text")).alias("out"))


@query("fn_ws", f"SELECT doc_id, {_ws('text')} AS out, CAST(length(text) - length(replace(text, chr(13), '')) AS BIGINT) AS returns FROM documents")
def fn_ws(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize_whitespace(F.col("text")).alias("out"), F.regexp_count("text", F.lit("\r")).cast("bigint").alias("returns"))


@query("fn_normalize", _cases(_ws(f"regexp_replace(nfc_normalize(text), {_INV}, '', 'g')") + " AS out"))
def fn_normalize(spark, sf):
    return CASES.df(spark).select("id", T.normalize(F.col("text")).alias("out"))


@query("fn_normalize_documents", "SELECT doc_id, " + _ws(f"regexp_replace(nfc_normalize(text), {_INV}, '', 'g')") + " AS out FROM documents")
def fn_normalize_documents(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("out"))


def _look(x: str) -> str:
    return f"translate({x}, {lit(''.join(T.LOOKALIKES))}, {lit(''.join(T.LOOKALIKES.values()))})"



@query("fn_lookalike", _cases(_look("text") + " AS out"))
def fn_lookalike(spark, sf):
    return CASES.df(spark).select("id", T.fix_lookalikes(F.col("text")).alias("out"))


@query("fn_strip", f"SELECT doc_id, {strip_sql('text')} AS out FROM documents")
def fn_strip(spark, sf):
    return documents(spark, sf).select("doc_id", T.strip_accents(F.col("text")).alias("out"))


@query("fn_strip_case", f"SELECT doc_id, translate(text, {lit(T.ACCENTED)}, {lit(T.BASES)}) AS out FROM documents")
def fn_strip_case(spark, sf):
    return documents(spark, sf).select("doc_id", T.strip_accents_keep_case(F.col("text")).alias("out"))


@query("fn_norm_text", f"SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN regexp_replace({strip_sql(_look('nfc_normalize(text)'))}, '\\s+', ' ', 'g') ELSE '' END AS out FROM documents")
def fn_norm_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize_text(F.col("text")).alias("out"))


@query("fn_norm_key", f"SELECT doc_id, {key_sql('text')} AS out FROM documents")
def fn_norm_key(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize_key(F.col("text")).alias("out"))


@query("fn_is_vi", f"SELECT doc_id, regexp_matches(text, {VI_SQL}) AS vi, CAST(length(regexp_replace(text, '[^' || {lit(T.VIETNAMESE[1:])}, '', 'g')) AS BIGINT) AS letters FROM documents")
def fn_is_vi(spark, sf):
    return documents(spark, sf).select("doc_id", T.contains_vietnamese(F.col("text")).alias("vi"), F.regexp_count("text", F.lit(T.VIETNAMESE)).cast("bigint").alias("letters"))


_PATTERN = """CASE WHEN l = '' THEN 'unknown' WHEN upper(l) = l AND lower(l) <> l THEN 'upper' WHEN lower(l) = l AND upper(l) <> l THEN 'lower'
WHEN upper(l[1]) = l[1] AND lower(l[2:]) = l[2:] THEN 'title' ELSE 'mixed' END"""


@query("fn_case_detect", f"SELECT id, {_PATTERN} AS pattern FROM (SELECT id, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS l FROM {CASES.sql()})")
def fn_case_detect(spark, sf):
    return CASES.df(spark).select("id", T.case_pattern(F.col("text")).alias("pattern"))


@query("fn_case_up_low", "SELECT doc_id, lower(text) AS low, lower(upper(text)) = lower(text) AS same FROM documents WHERE NOT contains(text, 'ß')")
def fn_case_up_low(spark, sf):
    return documents(spark, sf).where("not contains(text, 'ß')").select("doc_id", F.lower("text").alias("low"), (F.lower(F.upper("text")) == F.lower("text")).alias("same"))


@query("fn_case_mask", f"SELECT id, text AS original, lower(text) AS working, {_PATTERN} AS pattern FROM (SELECT *, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS l FROM {CASES.sql()})")
def fn_case_mask(spark, sf):
    return CASES.df(spark).select("id", T.case_mask(F.col("text")).alias("m")).select("id", "m.original", "m.working", "m.pattern")


@query("fn_case_restore", f"SELECT id, text AS out FROM {CASES.sql()} WHERE id IN (1, 2, 3, 4, 5, 6)")
def fn_case_restore(spark, sf):
    c = F.col("text")
    return CASES.df(spark).where("id in (1, 2, 3, 4, 5, 6)").select("id", T.restore_case(F.lower(c), c, T.case_pattern(c)).alias("out"))


@query("fn_lev", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
k AS (SELECT w FROM w WHERE length(w) BETWEEN 4 AND 6)
SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.w, b.w) AS INTEGER) AS d FROM k a JOIN k b ON a.w[1:3] = b.w[1:3] AND a.w < b.w""")
def fn_lev(spark, sf):
    w = documents(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w")).distinct().where("length(w) between 4 and 6")
    a, b = w.select(F.col("w").alias("a")), w.select(F.col("w").alias("b"))
    return a.join(b, (F.substring("a", 1, 3) == F.substring("b", 1, 3)) & (F.col("a") < F.col("b"))).select("a", "b", F.levenshtein("a", "b").alias("d"))


@query("fn_lev_seq", "SELECT doc_id, CAST(len(string_split(text, ' ')) // 3 + 1 AS INTEGER) AS distance FROM documents")
def fn_lev_seq(spark, sf):
    """Every third word replaced by one of no text, and one more put in front: each is an edit."""
    words = F.split("text", " ")
    other = F.concat(F.array(F.lit("\x01")), F.transform(words, lambda w, i: F.when(i % 3 == 2, F.concat(F.lit("\x02"), i.cast("string"))).otherwise(w)))
    return documents(spark, sf).select("doc_id", T.word_distance(words, other).alias("distance"))


@query("fn_ascii", "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM documents")
def fn_ascii(spark, sf):
    return documents(spark, sf).select("doc_id", T.is_ascii(F.col("text")).alias("ascii"))


@query(
    "fn_garbage",
    f"""SELECT id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 60 THEN 'too_long' WHEN regexp_matches(text, '\\S+@\\S+\\.\\S+') THEN 'email'
    WHEN regexp_matches(text, '(?i)https?://|www\\.') THEN 'url' WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'control'
    WHEN length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\-'']', '', 'g')) / length(text) > 0.3 THEN 'symbols'
    WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.5 THEN 'digits' END AS reason
    FROM {CASES.sql()} WHERE id NOT IN (8, 9)""",
)
def fn_garbage(spark, sf):
    return CASES.df(spark).where("id not in (8, 9)").select("id", T.garbage_reason(F.col("text")).alias("reason"))


@query("fn_phrase_tokens", "SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n, array_to_string(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')[1:5], ' ') AS head FROM documents")
def fn_phrase_tokens(spark, sf):
    w = T.phrase_tokens(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(w).alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


KINDS = Fixture("kind string", [("word",), ("unit",), ("chemical",), ("brand",), ("other",)])


@query("fn_kind", f"SELECT kind, CASE kind WHEN 'unit' THEN 'unit_word' ELSE 'common_word' END AS store, CASE kind WHEN 'unit' THEN 'unit_word' WHEN 'chemical' THEN 'domain_term' WHEN 'brand' THEN 'brand' ELSE 'common_word' END AS builder FROM {KINDS.sql()}")
def fn_kind(spark, sf):
    return KINDS.df(spark).select("kind", T.infer_kind(F.col("kind")).alias("store"), T.infer_kind(F.col("kind"), True).alias("builder"))


@query("fn_placeholder", "SELECT doc_id, '⟪' || upper(lang) || '_' || doc_id || '⟫' AS mark FROM documents")
def fn_placeholder(spark, sf):
    return documents(spark, sf).select("doc_id", T.placeholder(F.col("lang"), F.col("doc_id")).alias("mark"))


@query("st_dup", "SELECT doc_id, len(w) <> len(list_distinct(w)) AS dup FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def st_dup(spark, sf):
    w = F.split("text", " ")
    return documents(spark, sf).select("doc_id", (F.size(w) != F.size(F.array_distinct(w))).alias("dup"))
