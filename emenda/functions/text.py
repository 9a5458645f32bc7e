"""Text functions as columns: Unicode clean-up, accents, case and keys.

Everything but NFC and the distances of long texts and of word lists runs in the JVM.  The character tables are derived from Unicode data, and are the
same in the SQL that the queries are compared with.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .chars import distance

_TONES = {chr(c) for c in (0x300, 0x301, 0x303, 0x309, 0x323)}
_QUALITY = {chr(0x302): "aeo", chr(0x306): "a", chr(0x31B): "ou"}


def accent_map() -> dict[str, str]:
    """Precomposed letters of the Vietnamese alphabet to their base letters, both cases."""
    out = {"đ": "d", "Đ": "D"}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(cp)
        base, *marks = unicodedata.normalize("NFD", c)
        quality = [m for m in marks if m in _QUALITY]
        if (
            marks and base.lower() in "aeiouy" and all(m in _TONES or m in _QUALITY for m in marks)
            and len(quality) <= 1 and len(marks) - len(quality) <= 1 and all(base.lower() in _QUALITY[m] for m in quality)
        ):
            out[c] = base
    return out


ACCENTS = accent_map()
ACCENTED, BASES = "".join(ACCENTS), "".join(ACCENTS.values())
LOOKALIKES = {"ð": "đ", "Ð": "Đ", "ɗ": "đ", "ŏ": "ơ", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"'}
VIETNAMESE = "[À-ÝĂăĐđĨĩŨũƠơƯưà-ýẠ-ỹ]"
#: Digits that Unicode doesn't count as decimal: superscripts, circled digits and the like.
OTHER_DIGITS = "".join(chr(c) for c in range(0x110000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd")
INVISIBLE = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}\x{AD}\x{61C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
ODD_SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
MAX_CHARS = 20_000


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode normal form C; Spark has no function for it. One text at a time is a string of Python, and where no
    text changes the column is handed back as it is."""
    changed = {}
    for i, t in enumerate(texts):
        if t.is_valid and not unicodedata.is_normalized("NFC", text := t.as_py()):
            changed[i] = unicodedata.normalize("NFC", text)
    if not changed:
        return texts
    return pa.array((changed.get(i) or t.as_py() for i, t in enumerate(texts)), texts.type)


def nfc_changes(before: Column, after: Column) -> Column:
    """Positions at which two texts differ, those beyond the shorter one included."""
    a, b = F.split(before, ""), F.split(after, "")
    size = lambda c: F.when(F.length(c) == 0, 0).otherwise(F.length(c))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.greatest(size(before), size(after)) - F.when((size(before) == 0) | (size(after) == 0), 0).otherwise(same)


def remove_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def normalize_whitespace(text: Column) -> Column:
    """Line ends as \\n and unusual spaces as plain ones; nothing is trimmed or collapsed."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), ODD_SPACES, " ")


def normalize(text: Column, unicode: bool = True, invisible: bool = True, whitespace: bool = True) -> Column:
    text = nfc(text) if unicode else text
    text = remove_invisible(text) if invisible else text
    return normalize_whitespace(text) if whitespace else text


def fix_lookalikes(text: Column) -> Column:
    return F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def strip_accents_keep_case(text: Column) -> Column:
    return F.translate(text, ACCENTED, BASES)


def strip_accents(text: Column) -> Column:
    """The no-tone key of a text: Vietnamese accents removed, lower case."""
    return F.lower(strip_accents_keep_case(text))


def normalize_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_accents(text), r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    clean = F.regexp_replace(strip_accents(fix_lookalikes(nfc(text))), r"(?U)\s+", " ")
    return F.when(text.rlike(r"(?U)\S"), clean).otherwise("")


def contains_vietnamese(text: Column) -> Column:
    return text.rlike(VIETNAMESE)


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def case_pattern(text: Column) -> Column:
    """upper, lower, title, mixed or unknown, by the letters of the text."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    first, rest = F.substring(letters, 1, 1), letters.substr(F.lit(2), F.length(letters))
    return (
        F.when(F.length(letters) == 0, "unknown")
        .when((F.upper(letters) == letters) & (F.lower(letters) != letters), "upper")
        .when((F.lower(letters) == letters) & (F.upper(letters) != letters), "lower")
        .when((F.upper(first) == first) & (F.lower(rest) == rest), "title")
        .otherwise("mixed")
    )


def case_mask(text: Column) -> Column:
    return F.struct(text.alias("original"), F.lower(text).alias("working"), case_pattern(text).alias("pattern"))


def restore_case(text: Column, original: Column, pattern: Column) -> Column:
    """text in the case of original: by pattern, or position by position where it is mixed."""
    chars, model = F.split(text, ""), F.split(original, "")
    upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    mixed = F.array_join(F.transform(chars, lambda c, i: F.when(upper(F.get(model, i)), F.upper(c)).otherwise(F.lower(c))), "")
    title = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))
    return F.when(pattern == "upper", F.upper(text)).when(pattern == "lower", F.lower(text)).when(pattern == "title", title).when(pattern == "mixed", mixed).otherwise(text)


def garbage_reason(text: Column) -> Column:
    """Why a dictionary line is no word, or null."""
    n = F.length(text)
    symbols = F.regexp_count(text, F.lit(r"(?U)[^\w\s\-']"))
    digits = F.regexp_count(text, F.lit(r"\p{Nd}"))
    return (
        F.when(F.trim(text) == "", "empty").when(n > 60, "too_long").when(text.rlike(r"\S+@\S+\.\S+"), "email")
        .when(text.rlike(r"(?i)https?://|www\."), "url").when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control")
        .when(symbols / n > 0.3, "symbols").when(digits / n > 0.5, "digits")
    )


def phrase_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"(?U)\s+"), lambda w: w != "")


def infer_kind(kind: Column, builder: bool = False) -> Column:
    """Entry kind of a raw type; builders know two more types than the runtime store."""
    out = F.when(kind == "unit", "unit_word")
    if builder:
        out = out.when(kind == "chemical", "domain_term").when(kind == "brand", "brand")
    return out.otherwise("common_word")


def placeholder(kind: Column, index: Column) -> Column:
    return F.concat(F.lit("⟪"), F.upper(kind), F.lit("_"), index.cast("string"), F.lit("⟫"))


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two word lists, null where either is."""
    return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(IntegerType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two texts, for long ones: in proportion to their length where bounds meet, as they do where all
    edits replace characters by others of their own, or all leave some out; else its time is that of one integer of so many bits
    as one text has characters, for every character of the other."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")
