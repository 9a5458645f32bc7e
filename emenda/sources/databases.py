"""Lexicon tables in SQLite files, and lexicons of JSON files, a database, or both.

A database file is read by the executors with Python's own sqlite3, table by table and in batches; like
any source its path must be one that they all reach."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import readers

_BATCH = 10_000
#: Select and schema of the tables of a lexicon database.
TABLES = {
    "syllables": ("SELECT base, surface, freq FROM lexicon_syllables", "base string, surface string, freq double"),
    "words": (
        "SELECT surface, type, freq, domain, normalized, no_tone, kind, source, confidence, tags FROM lexicon_words",
        "surface string, type string, freq double, domain string, normalized string, no_tone string, kind string, source string, confidence double, tags string",
    ),
    "units": ("SELECT surface, freq, domain FROM lexicon_units", "surface string, freq double, domain string"),
    "abbreviations": ("SELECT abbreviation, normalized, expansions, ambiguous, tags FROM lexicon_abbreviations", "abbreviation string, normalized string, expansions string, ambiguous int, tags string"),
    "foreign": ("SELECT word FROM lexicon_foreign_words", "word string"),
    "phrases": ("SELECT phrase, normalized, n, freq, domain FROM lexicon_phrases", "phrase string, normalized string, n int, freq double, domain string"),
    "confusions": ("SELECT noisy, normalized_noisy, corrections, confidence FROM lexicon_ocr_confusions", "noisy string, normalized_noisy string, corrections string, confidence double"),
}
_ENTRY = "kind_of string, ord bigint, entry_id string, surface string, normalized string, no_tone string, kind string, confidence double, frequency double, domain string, tags array<string>, `values` array<string>, ambiguous boolean, n int"


def query(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a select in their order, with ord; a file or table that is not there fails."""
    names = [c.strip().split(" ")[0].strip("`") for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                con = sqlite3.connect(f"file:{p}?mode=ro", uri=True)
                try:
                    cursor, at = con.execute(sql), 0
                    while found := cursor.fetchmany(_BATCH):
                        frame = pd.DataFrame(found, columns=names, dtype=object)
                        frame.insert(0, "ord", range(at, at + len(found)))
                        at += len(found)
                        yield frame
                finally:
                    con.close()

    return spark.createDataFrame([(os.path.abspath(path),)], "path string").coalesce(1).mapInPandas(rows, f"ord bigint, {schema}")


def _or(c: Column, other: Column) -> Column:
    """c, where it is neither null nor zero nor empty."""
    return F.when(c.isNull() | (c.cast("string").isin("", "0", "0.0")), other).otherwise(c)


def _select(rows: DataFrame, kind_of: str, prefix: str, surface: str, **given: Column) -> DataFrame:
    columns = {"kind_of": F.lit(kind_of), "ord": F.col("ord"), "entry_id": F.concat(F.lit(f"{prefix}/"), F.col(surface)), "surface": F.col(surface)} | given
    fields = [c.rsplit(" ", 1) for c in _ENTRY.split(", ")]
    return rows.select(*(columns.get(n.strip("`"), F.lit(None)).cast(t).alias(n.strip("`")) for n, t in fields))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a lexicon database in one table, of every entry_id the first.

    Zero counts as missing in numbers (then 1, the frequency, .5 for phrases and .7 for confusions), and
    what is a unit among the words is one of the units too."""
    t = {name: query(spark, path, *TABLES[name]) for name in TABLES}
    texts = lambda c: F.from_json(c, "array<string>")
    w, freq = t["words"], _or(F.col("freq"), F.lit(1.0))
    key, normal = _or(F.col("no_tone"), T.strip_accents(F.col("surface"))), _or(F.col("normalized"), F.col("surface"))
    conf = _or(F.col("confidence"), freq)
    kinds = _or(F.col("kind"), _or(F.col("type"), F.lit("word")))
    tagged = lambda name: F.coalesce(texts(_or(F.col("tags"), F.lit(None).cast("string"))), F.array(F.lit(name), F.lit("trusted")))
    parts = [
        _select(t["syllables"], "syllable", "syllable", "surface", normalized=F.col("surface"), no_tone=F.col("base"), kind=F.lit("syllable"), confidence=F.col("freq"), frequency=F.col("freq"), tags=F.array(F.lit("syllable"), F.lit("trusted"))),
        _select(w, "word", "word", "surface", normalized=normal, no_tone=key, kind=kinds, confidence=conf, frequency=freq, domain=F.col("domain"), tags=tagged("word")),
        _select(w.where("kind = 'unit'"), "unit", "unit", "surface", normalized=normal, no_tone=key, kind=F.lit("unit"), confidence=conf, frequency=freq, domain=_or(F.col("domain"), F.lit("measurement")), tags=tagged("unit")),
        _select(
            t["units"].withColumn("ord", F.col("ord") + (1 << 40)), "unit", "unit", "surface", normalized=F.col("surface"), no_tone=T.strip_accents(F.col("surface")), kind=F.lit("unit"), confidence=freq, frequency=freq,
            domain=_or(F.col("domain"), F.lit("measurement")), tags=F.array(F.lit("unit"), F.lit("trusted")),
        ),
        _select(
            t["abbreviations"], "abbreviation", "abbrev", "abbreviation", normalized=_or(F.col("normalized"), F.lower("abbreviation")), confidence=F.lit(1.0), values=F.coalesce(texts("expansions"), F.array().cast("array<string>")),
            ambiguous=(F.coalesce("ambiguous", F.lit(0)) != 0) | (F.size(F.coalesce(texts("expansions"), F.array().cast("array<string>"))) > 1), tags=F.coalesce(texts("tags"), F.array().cast("array<string>")),
        ),
        _select(t["foreign"], "foreign", "foreign", "word", normalized=F.col("word")),
        _select(
            t["phrases"], "phrase", "phrase", "phrase", normalized=_or(F.col("normalized"), F.col("phrase")), no_tone=T.strip_accents(F.col("phrase")), n=_or(F.col("n"), F.lit(2)), confidence=_or(F.col("freq"), F.lit(0.5)),
            frequency=_or(F.col("freq"), F.lit(0.5)), domain=F.col("domain"),
        ),
        _select(t["confusions"], "confusion", "ocr", "noisy", no_tone=T.strip_accents(F.col("noisy")), values=F.coalesce(texts("corrections"), F.array().cast("array<string>")), confidence=_or(F.col("confidence"), F.lit(0.7))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy("entry_id").orderBy("ord"))
    return out.withColumn("__first", first).where("__first = 1").drop("__first")


def phrase_rows(spark: SparkSession, path: str) -> DataFrame:
    """Phrases (phrase, no_tone, n, confidence, domain) of a database for n-gram builds: n from the words,
    of two words at least.  A database that can't be read has none."""
    try:
        con = sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)
        con.execute("SELECT phrase, freq, domain FROM lexicon_phrases LIMIT 1")
        con.close()
    except sqlite3.Error:
        return spark.createDataFrame([], "phrase string, no_tone string, n int, confidence double, domain string")
    rows = query(spark, path, "SELECT phrase, freq, domain FROM lexicon_phrases", "phrase string, freq double, domain string").withColumn("n", F.lit(0))
    return readers.phrases(rows, recount=True)


def hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entries of JSON files and of a database: of syllables, words and units the first's entry of an id
    stays, abbreviations and confusions are the second's where it has them, and phrases come twice."""
    a, b = first.withColumn("__rank", F.lit(0)), second.withColumn("__rank", F.lit(1))
    both = a.unionByName(b)
    later = F.col("kind_of").isin("abbreviation", "confusion")
    order = Window.partitionBy("entry_id").orderBy(F.when(later, -F.col("__rank")).otherwise(F.col("__rank")), "ord")
    return both.withColumn("__first", F.row_number().over(order)).where((F.col("__first") == 1) | (F.col("kind_of") == "phrase")).drop("__rank", "__first")


def json_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the JSON files of a folder, as lexicon() gives them; files that are missing are empty."""
    def rows(name: str, schema: str) -> DataFrame:
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            return spark.createDataFrame([], f"ord bigint, {schema}")
        return readers.json_array(spark, path, schema).withColumn("ord", F.monotonically_increasing_id())

    from ..plans import builders
    from ..plans.validation import SCHEMAS

    kinds = {"syllables": "syllable", "words": "word", "phrases": "phrase", "confusions": "confusion", "abbreviations": "abbreviation"}
    files = {"syllables": ("syllables.vi.json", "syllable"), "words": ("words.vi.json", "word"), "phrases": ("phrases.vi.json", "phrase"), "confusions": ("ocr_confusions.vi.json", "ocr_confusion"), "abbreviations": ("abbreviations.vi.json", "abbreviation")}
    names = [c.rsplit(" ", 1)[0].strip("`") for c in _ENTRY.split(", ")]
    out = None
    for builder, (file, kind) in files.items():
        part = builders.BUILDERS[builder](rows(file, SCHEMAS[kind])).withColumn("kind_of", F.lit(kinds[builder])).select(*names)
        out = part if out is None else out.unionByName(part)
    units = readers.lexicon_units(rows("units.vi.json", SCHEMAS["unit"]))
    unit = units.withColumn("ord", F.monotonically_increasing_id())
    out = out.unionByName(_select(unit, "unit", "unit", "surface", normalized=F.col("surface"), no_tone=F.col("no_tone"), kind=F.lit("unit"), confidence=F.col("freq"), frequency=F.col("freq"), domain=F.col("domain"), tags=F.array(F.lit("unit"))))
    path = os.path.join(folder, "foreign_words.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            foreign = [(i, str(w)) for i, w in enumerate(json.load(f))]
        out = out.unionByName(_select(spark.createDataFrame(foreign, "ord bigint, word string"), "foreign", "foreign", "word", normalized=F.col("word")))
    return out


def load(spark: SparkSession, mode: str, folder: str | None = None, database: str | None = None, fallback: bool = True) -> DataFrame:
    """The lexicon by mode json, sqlite or hybrid.  A database that is not there is an error, or with
    fallback leaves the JSON files alone."""
    if mode not in ("json", "sqlite", "hybrid"):
        raise ValueError(f"unknown lexicon mode: {mode}")
    if mode == "json":
        return json_lexicon(spark, folder)
    if not database or not os.path.exists(database):
        if fallback and folder:
            return json_lexicon(spark, folder)
        raise FileNotFoundError(f"no lexicon database at {database}")
    return lexicon(spark, database) if mode == "sqlite" else hybrid(json_lexicon(spark, folder), lexicon(spark, database))
