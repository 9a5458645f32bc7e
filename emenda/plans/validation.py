"""Checks of lexicon entries: rows of raw entries with the messages of what is wrong with each.

Raw rows have typed columns, so that a missing field and a null one are the same; a field of another
type fails when the file is read.  Every check is a column, so a lexicon of any size takes one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns of raw entries by type.
SCHEMAS = {
    "syllable": "base string, forms array<string>, freq map<string,double>",
    "word": "surface string, normalized string, type string, freq double, domain string",
    "unit": "surface string, normalized string, type string, freq double, domain string",
    "abbreviation": "abbreviation string, normalized string, expansions array<string>, tags array<string>, ambiguous boolean",
    "phrase": "phrase string, normalized string, n int, freq double, domain string, tags array<string>",
    "ocr_confusion": "noisy string, corrections array<string>, confidence double",
    "foreign_words": "word string",
}


def nonempty(value: Column) -> Column:
    """Whether value is a string of at least one character."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def probability(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def _text(field: str) -> Column:
    return F.when(F.col(field).isNull(), f"missing field '{field}'").when(~nonempty(F.col(field)), f"'{field}' is empty")


def _share(field: str) -> Column:
    return F.when(F.col(field).isNotNull() & ~probability(F.col(field)), F.concat(F.lit(f"'{field}' is not between 0 and 1: "), F.col(field).cast("string")))


def _list(field: str) -> Column:
    return F.when(F.col(field).isNull(), f"missing field '{field}'").when(F.size(field) == 0, f"'{field}' is empty")


def _elements(field: str, blank: bool) -> Column:
    """A message for every element that is null or empty, or blank as well."""
    bad = lambda x: x.isNull() | ((F.trim(x) if blank else x) == "")
    found = F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda x, i: F.when(bad(x), F.concat(F.lit(f"'{field}' "), i.cast("string"), F.lit(" is empty"))))
    return F.array_compact(found)


def _syllable() -> list[Column]:
    forms, freq = F.coalesce("forms", F.array().cast("array<string>")), F.col("freq")
    strips = F.transform(forms, lambda f: F.when(F.col("base").isNotNull() & (F.col("base") != "") & (T.strip_accents(f) != F.col("base")), F.concat(F.lit("form '"), f, F.lit("' has another base"))))
    ranges = F.transform(F.map_entries(F.coalesce(freq, F.expr("map()").cast("map<string,double>"))), lambda e: F.when(~probability(e["value"]), F.concat(F.lit("frequency of '"), e["key"], F.lit("' is not between 0 and 1"))))
    covered = F.transform(forms, lambda f: F.when(freq.isNotNull() & F.try_element_at(freq, f).isNull(), F.concat(F.lit("form '"), f, F.lit("' has no frequency"))))
    twice = F.transform(forms, lambda f, i: F.when(F.array_position(forms, f) <= i, F.concat(F.lit("form '"), f, F.lit("' is repeated"))))
    return [F.array(_text("base"), _list("forms")), strips, ranges, covered, twice]


def _checks(kind: str) -> list[Column]:
    if kind == "syllable":
        return _syllable()
    if kind in ("word", "unit"):
        return [F.array(_text("surface"), _text("normalized"), _share("freq"))]
    if kind == "abbreviation":
        return [F.array(_text("abbreviation"), _list("expansions")), _elements("expansions", False)]
    if kind == "phrase":
        n = F.when(F.col("n").isNull(), "missing field 'n'").when(F.col("n") < 1, "'n' is not positive")
        return [F.array(_text("phrase"), _text("normalized"), n, _share("freq"))]
    if kind == "ocr_confusion":
        return [F.array(_text("noisy"), _list("corrections"), _share("confidence")), _elements("corrections", True)]
    if kind == "foreign_words":
        return [F.array(F.when(F.coalesce(F.trim("word"), F.lit("")) == "", "word is empty"))]
    raise ValueError(f"unknown lexicon type: {kind}")


def entry_errors(raw: DataFrame, kind: str) -> DataFrame:
    """raw with errors, the messages about each row in the order of its fields."""
    return raw.withColumn("errors", F.flatten(F.array(*(F.array_compact(c) for c in _checks(kind)))))


def file_errors(raw: DataFrame, kind: str, order: str = "ord") -> DataFrame:
    """(ord, error) of all rows, each message with its row's number before it; a file without rows here
    is valid."""
    rows = entry_errors(raw, kind).select(order, F.posexplode("errors").alias("i", "error"))
    return rows.select(order, "i", F.format_string("[%d] %s", F.col(order), F.col("error")).alias("error"))
